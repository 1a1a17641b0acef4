"""Token counts by rank-synchronous merging of ragged arrays.

The distinct words of a batch are cut into pre-tokens as the tokenizer does; their byte symbols
lie in one flat array with a row number each. In every round each row finds the lowest rank among its
neighbouring pairs and merges that pair wherever it stands, all rows at once. Rows without a pair
that merges are done, and their surviving symbols are counted. Merging all places of a row's
lowest pair in one round equals merging them one by one, since a merge only makes pairs of
higher rank; the tables are checked for that when they are loaded.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import chunks, ends, kept_between_tasks, split_words, text_column
from tailspark.llm.tokens import model_path

LIMIT = 2048
KNOWN_WORDS = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_LOADED: dict[str, "RankMerger"] = kept_between_tasks()


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class RankMerger:
    """Merge table of a byte-level BPE tokenizer file with word ends, and its text rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pieces)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)))
        symbols = _byte_symbols()
        self.inner = np.array([vocabulary[c] for c in symbols], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in symbols], np.int64)
        self.size = len(vocabulary)
        left, right, made = [], [], []
        rank_of: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            new = vocabulary[a + b]
            if rank_of.get(vocabulary[a], -1) >= rank or rank_of.get(vocabulary[b], -1) >= rank or new in rank_of:
                raise ValueError("a merge uses a symbol that a later merge makes")
            rank_of[new] = rank
            left.append(vocabulary[a])
            right.append(vocabulary[b])
            made.append(new)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], np.array(made, np.int64)
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> "RankMerger":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs; the number of merges for a pair that does not merge."""
        wanted = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], len(self.keys))

    def merged_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece (not empty) after all merges."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        stop = ends(lengths)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        symbols[stop[1:] - 1] = self.last[raw[stop[1:] - 1]]
        row = np.repeat(np.arange(len(pieces)), lengths)
        out, none = lengths.copy(), len(self.keys)
        pair = self.ranks(symbols[:-1], symbols[1:])
        pair[row[1:] != row[:-1]] = none
        while len(symbols) > 1:
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            padded = np.append(pair, none)
            lowest = np.minimum.reduceat(padded, first)
            sizes = np.diff(np.append(first, len(row)))
            out[row[first]] = sizes
            live = np.repeat(lowest < none, sizes)
            if not live.any():
                break
            hit = live & (padded == np.repeat(lowest, sizes))
            # of overlapping places, as in a run of one symbol, every second one merges
            at = np.flatnonzero(hit)
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.made[padded[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            keep = live & ~gone
            symbols, row, padded, changed = symbols[keep], row[keep], padded[keep], changed[keep]
            if len(symbols) < 2:
                out[row] = 1
                break
            pair = padded[:-1].copy()
            anew = np.flatnonzero(changed[:-1] | changed[1:])
            pair[anew] = self.ranks(symbols[anew], symbols[anew + 1])
            pair[row[1:] != row[:-1]] = none
        return out

    def pieces(self, word: str) -> list[bytes]:
        """Pre-tokens of a word or text: normalised, lower-cased and cut."""
        plain = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
        return [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(plain)]

    def count_text(self, text: str) -> int:
        """Tokens of one text that may hold special tokens, each of which is one token."""
        total, at = 0, 0
        for m in [*self.special_pattern.finditer(text), None]:
            found = self.pieces(text[at : m.start() if m else len(text)])
            total += int(self.merged_counts(found).sum()) if found else 0
            if m:
                total, at = total + 1, m.end()
        return total

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            cut = [self.pieces(w) for w in part]
            distinct = {p: j for j, p in enumerate(dict.fromkeys(p for c in cut for p in c))}
            counts = self.merged_counts(list(distinct)).tolist() if distinct else []
            self.known.update((w, sum(counts[distinct[p]] for p in c)) for w, c in zip(part, cut))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self._learn([w for w in distinct if w not in self.known])
        each = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))
        of_word = each[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        total = ends(of_word)
        out = np.diff(total[ends(counts)])
        odd = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            out[i] = self.count_text(texts[int(i)].as_py())
        return out


def _counted(path: str, limit: int):
    def run(batches):
        merger = RankMerger.load(path)
        for batch in batches:
            for part in chunks(batch, size=8_000_000):
                texts = part.column("text")
                n = merger.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(n),
                        pa.array(n > limit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text, ...).

    n_bytes is the length in UTF-8; a missing text counts as empty, with 0 of both. Rows repeat as
    they do in `docs`; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(_counted(tokenizer or model_path(), limit), SCHEMA)
