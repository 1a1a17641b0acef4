"""Token ids of whole texts by the `tokenizers` library, at the speed of its distinct words.

The tokenizer drops white space and never joins symbols across it, so a text's ids are those of
its words in turn. Words are coded once per worker; letters-only words, which the tokenizer takes
as one piece each, go to the library many at a time. Texts that hold the opening of a special
token are given to the library whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tailspark.llm.common import ends, kept_between_tasks, split_words

MODEL = "word_bpe_49k.json"
KNOWN_WORDS = 400_000
_LOADED: dict[str, "WordCoder"] = kept_between_tasks()
_RUNS = re.compile("[a-z]+|[^a-z]+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCoder:
    """Ids of texts. `path` names a tokenizer that drops white space and marks word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.pieces: dict[str, bytes] = {}  # ids as 32-bit numbers
        self._forget()

    def _forget(self) -> None:
        """Words by number; the ids of word i are flat[stop[i]:stop[i + 1]]."""
        self.words: dict[str, int] = {}
        self.flat, self.stop = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def load(cls, path: str) -> "WordCoder":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _cut(word: str) -> list[str]:
        """Parts of a word that the tokenizer never joins. An apostrophe may open a contraction."""
        if word.isascii():
            return [word] if "'" in word else _RUNS.findall(word.lower())
        core = word.rstrip(".,;:!?")
        # a letter whose lower case holds a combining mark, such as U+0130, may join what follows
        return [core, word[len(core) :]] if len(core) < len(word) and core.isalpha() and core.lower().isalpha() else [word]

    def _learn(self, words: list[str]) -> None:
        if len(self.pieces) > KNOWN_WORDS:
            self.pieces.clear()
        pieces = self.pieces
        cut = [self._cut(w) for w in words]
        new = {p for parts in cut for p in parts}.difference(pieces)
        plain = [p for p in new if p.isalpha() and p.lower().isalpha()]
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            ids = self.whole(" ".join(part))
            at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(at) == len(part):
                raw = ids.tobytes()
                pieces.update((p, raw[x:y]) for p, x, y in zip(part, [0, *at], at))
        for p in new.difference(pieces):
            pieces[p] = self.whole(p).tobytes()
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        ids, stops, total = [], [], 4 * int(self.stop[-1])
        for parts in cut:
            for p in parts:
                x = pieces[p]
                ids.append(x)
                total += len(x)
            stops.append(total)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        self.stop = np.concatenate([self.stop, np.array(stops, np.int64) // 4])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and how many each text has."""
        odd = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words) > KNOWN_WORDS:
            self._forget()
        get = self.words.get
        number = np.array([get(w, -1) for w in distinct], np.int64)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            first = len(self.words)
            self._learn([distinct[i] for i in missing])
            number[missing] = np.arange(first, first + len(missing))
        at = number[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        starts, of_word = self.stop[at], self.stop[at + 1] - self.stop[at]
        total = ends(of_word)
        ids = self.flat[np.repeat(starts - total[:-1], of_word) + np.arange(total[-1])]
        sizes = np.diff(total[ends(counts)])
        if odd.any():
            parts = np.split(ids, ends(sizes)[1:-1])
            values = texts.to_pylist()
            parts = [self.whole(values[i]) if odd[i] else p for i, p in enumerate(parts)]
            sizes = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
        return ids, sizes
