"""Quality rules: surface counts and n-gram perplexity with bands per language.

Spark counts the symbol 4-grams of all texts, per language. From these counts a modified
Kneser-Ney model is made and stored in arrays sorted by the grams' hashes. Each text gets its
perplexity under the model of its own language. A language's band is the shortest interval of log
perplexity that holds half of its texts, widened on both sides by `margin`; texts outside are
rejected. Junk moves that interval only when it comes near to half of the texts, and its width does
not scale the margin, so neither junk nor a mix of kinds opens the band.

Unusual ASCII marks are outside the vocabulary: grams with one are not counted, so such a mark
costs a text what any unknown symbol costs.

Beyond ASCII each byte of UTF-8 is a symbol of its own, so no two characters share their symbols,
in any script. A language's model has an entry for each run of four bytes that its texts hold, which UTF-8
bounds by its structure; models of several languages travel together only up to `model_entries`
entries, and further languages are scored in passes of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailspark.llm.common import (
    chunks, ends, fold, fresh, let_go, mix, split_words, stage, text_column, word_hashes,
)

ORDER, BITS = 4, 8
SIZE = 1 << BITS
UNKNOWN = 36
MARGIN = 0.8  # of log perplexity: a text may cost e**0.8 = 2.2 times as much a symbol as the middle ones
GRID = 64  # quantiles that the shortest half is taken from
MODEL_ENTRIES = 8_000_000
SLOT_BITS = 22  # places for the chances that a task has looked up

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("log_perplexity", T.DoubleType())]
)


# --- symbols and grams -------------------------------------------------------------


def _alphabet() -> np.ndarray:
    """Symbol of each byte of UTF-8: 0 white space, 1-26 a-z, 27 digits, 28-35 common marks, UNKNOWN other
    ASCII, 128-255 the bytes of all other characters, each for itself."""
    table = np.arange(SIZE, dtype=np.uint8)
    table[:128] = UNKNOWN
    table[[32, 9, 10, 11, 12, 13]] = 0
    table[97:123] = np.arange(1, 27)
    table[48:58] = 27
    for i, mark in enumerate(".,;:!?'\"-()"):
        table[ord(mark)] = 28 + min(i, 7)
    return table


_TABLE = _alphabet()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the texts and the number of each one's text.

    A text is lower-cased, runs of white space count as one symbol, and one such symbol stands
    before and after it; grams do not cross texts.
    """
    parts = [f"\n{t.lower()}\n".encode("utf-8", "surrogatepass") for t in texts]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    symbols = _TABLE[np.frombuffer(b"".join(parts), np.uint8)]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep].astype(np.uint32), owner[keep]
    n = len(symbols) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    code = symbols[:n].copy()
    for j in range(1, ORDER):
        code = (code << np.uint32(BITS)) | symbols[j : j + n]
    whole = owner[:n] == owner[ORDER - 1 :]
    return code[whole], owner[:n][whole]


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, int)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


CHUNK = 1_000_000


def _by_language(languages: pa.Array, texts: pa.Array):
    """(language, positions, texts) for each language; a missing language is the empty one."""
    languages = ["" if x is None else str(x) for x in languages.to_pylist()]
    texts = texts.to_pylist()
    places: dict[str, list[int]] = {}
    for i, language in enumerate(languages):
        places.setdefault(language, []).append(i)
    for language, at in places.items():
        yield language, at, [texts[i] for i in at]


def _in_vocabulary(codes: np.ndarray) -> np.ndarray:
    """Grams without the symbol of unusual marks, which is outside the vocabulary."""
    inside = np.ones(len(codes), bool)
    for j in range(ORDER):
        inside &= (codes >> np.uint32(BITS * j)) & np.uint32(SIZE - 1) != UNKNOWN
    return inside


def _counted(batches):
    let_go()
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in chunks(batch, size=CHUNK):
            for language, _, texts in _by_language(part.column("lang"), part.column("text")):
                code, _ = grams(texts)
                codes, counts = np.unique(code, return_counts=True)
                inside = _in_vocabulary(codes)
                codes, counts = codes[inside], counts[inside]
                old = seen.get(language)
                if old is not None:
                    codes, counts = _merged(np.concatenate([old[0], codes]), np.concatenate([old[1], counts]))
                seen[language] = codes, counts
    for language, (codes, counts) in seen.items():
        for i in range(0, len(codes), 50_000):
            piece = codes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language] * len(piece), pa.string()),
                    pa.array(piece.astype(np.int64)),
                    pa.array(counts[i : i + 50_000].astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts; a missing language counts as the empty one."""
    return docs.select(text_column().alias("text"), "lang").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )


# --- the model ---------------------------------------------------------------------


class _Sorted:
    """Values by key: hashes in rising order, and the values in that order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        wanted = mix(keys.astype(np.uint64))
        if not len(self.hashes):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, self.values[at], missing)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from a count of 1, 2 and 3 or more (index 0 is unused)."""
    n = [float((counts == i).sum()) for i in range(5)]
    if not n[1] or not n[2]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    found = [0.0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    return np.array([min(max(d, 0.05), i) if i else 0.0 for i, d in enumerate(found)])


class KneserNey:
    """Interpolated modified Kneser-Ney over symbol 4-grams, from all grams and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.orders = []
        codes = codes.astype(np.int64)
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        for n in range(ORDER, 0, -1):
            taken = _discounts(counts)[np.minimum(counts, 3).astype(int)]
            contexts, at = np.unique(codes >> BITS, return_inverse=True)
            total = np.bincount(at, counts)
            free = np.bincount(at, taken) / total
            self.orders.append((n, _Sorted(codes, (counts - taken) / total[at]), _Sorted(contexts, free)))
            # the next lower order counts the distinct symbols before each gram
            codes, counts = np.unique(codes & ((1 << (BITS * (n - 1))) - 1), return_counts=True)
            counts = counts.astype(np.float64)
        self.orders.reverse()

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of each gram's last symbol after the others."""
        codes = codes.astype(np.int64)
        p = np.full(len(codes), 1.0 / SIZE)
        for n, own, free in self.orders:
            gram = codes & ((1 << (BITS * n)) - 1)
            p = own.get(gram, 0.0) + free.get(gram >> BITS, 1.0) * p
        return np.log(p)


def _starts_character(codes: np.ndarray) -> np.ndarray:
    """Grams whose last symbol starts a character (no byte 10xxxxxx), so each character counts once."""
    return codes & np.uint32(0xC0) != 0x80


class _LookedUp:
    """The chances a task has looked up, of all its languages: SLOT_BITS bits of a hash name the place, which holds
    the whole gram with its language, so a gram whose place another one took is looked up anew."""

    def __init__(self):
        self.keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.values = np.empty(1 << SLOT_BITS, np.float32)

    def get(self, model: KneserNey, number: int, codes: np.ndarray) -> np.ndarray:
        keys = codes.astype(np.int64) | (number << (ORDER * BITS))
        places = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        values = self.values[places]
        missed = np.flatnonzero(self.keys[places] != keys)
        if len(missed):
            _, first, back = np.unique(codes[missed], return_index=True, return_inverse=True)
            new = missed[first]
            found = model.log_probability(codes[new]).astype(np.float32)
            values[missed] = found[back]
            # of several grams with one place the last is kept
            self.keys[places[new]], self.values[places[new]] = keys[new], found
        return values


# --- surface counts ----------------------------------------------------------------


def _repeated(hashes: np.ndarray) -> int:
    """Words in windows of three that occur at least twice."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    windows = fold([hashes[:n], hashes[1 : n + 1], hashes[2:]], 3)
    order = np.argsort(windows)
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 2, bool)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for j in range(3):
        twice[hit + j] = True
    return int(twice.sum())


_BLANK = " \t\n\v\f\r"


def _duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def surface(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words, counts = split_words(texts)
    at = ends(counts)
    lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))])
    hashes = word_hashes(words)
    symbols = pc.count_substring_regex(texts, pattern="[#*$%&|<>]").to_numpy(zero_copy_only=False)
    return [
        counts.astype(np.int64),
        lengths[at[1:]] - lengths[at[:-1]],
        symbols.astype(np.int64),
        np.array([_duplicate_lines(t) for t in texts.to_pylist()], np.int64),
        np.array([_repeated(hashes[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64),
    ]


# --- scoring -----------------------------------------------------------------------


def _scored(models: dict[str, tuple[np.ndarray, np.ndarray]], text: str, lang: str, out: str, keep: list[str]):
    """The columns `keep` of each batch and the struct `out`. models: grams and counts of each language."""

    def run(batches):
        let_go()
        made: dict[str, tuple[KneserNey, int]] = {}
        known = _LookedUp()
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                whole = pc.fill_null(part.column(text), "")
                numbers = np.full(part.num_rows, np.nan)
                for language, at, texts in _by_language(part.column(lang), whole):
                    if language not in made:
                        made[language] = KneserNey(*models[language]), len(made)
                    code, owner = grams(texts)
                    values = known.get(*made[language], code)
                    total = np.bincount(owner, values, len(texts))
                    # a character's cost is that of all its bytes
                    n = np.bincount(owner[_starts_character(code)], minlength=len(texts))
                    with np.errstate(invalid="ignore"):
                        numbers[at] = np.where(n > 0, -total / n, np.nan)
                columns = [pa.array(c) for c in surface(whole)]
                columns.append(pa.array(numbers, from_pandas=True))
                stats = pa.StructArray.from_arrays(columns, names=STATS.names)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], stats], names=[*keep, out])

    return run


def _groups(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Languages in groups of at most `most` model entries; a larger one stands alone."""
    groups, room = [], 0
    for language, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if not groups or n > room:
            groups.append([])
            room = most
        groups[-1].append(language)
        room -= n
    return groups


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def with_scores(
    docs: DataFrame, text: str, lang: str, out: str, keep: list[str], model_entries: int = MODEL_ENTRIES
) -> DataFrame:
    """Columns `keep` of `docs` and the struct `out` (STATS) for each row. `text` is a string column."""
    language = _language(lang)
    counted = stage(gram_counts(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))), "grams")
    sizes = [(r["lang"], r["n"]) for r in counted.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, STATS)])
    groups = _groups(sizes, model_entries)
    known = [language for group in groups for language in group]
    passes = []
    for i, group in enumerate(groups):
        table = counted.filter(F.col("lang").isin(group)).toArrow()
        names = np.array(table.column("lang").to_pylist(), object)
        codes, counts = (table.column(c).to_numpy() for c in ("gram", "n"))
        models = {g: (codes[names == g].astype(np.uint32), counts[names == g]) for g in group}
        rows = docs.filter(language.isin(group)) if len(groups) > 1 else docs
        if i == 0:  # languages without any gram, as of empty texts only, need no model of their own
            empty = np.empty(0, np.uint32), np.empty(0, np.int64)
            models = _Default(models, empty)
            if len(groups) > 1:
                rows = docs.filter(language.isin(group) | ~language.isin(known))
        passes.append(rows.mapInArrow(_scored(models, text, lang, out, keep), schema))
    if not passes:
        empty = np.empty(0, np.uint32), np.empty(0, np.int64)
        return docs.mapInArrow(_scored(_Default({}, empty), text, lang, out, keep), schema)
    scored = passes[0]
    for other in passes[1:]:
        scored = scored.unionByName(other)
    return scored


class _Default(dict):
    """A dict that gives `default` for unknown keys, without keeping it."""

    def __init__(self, items, default):
        super().__init__(items)
        self.default = default

    def __missing__(self, key):
        return self.default

    def __reduce__(self):
        return _Default, (dict(self), self.default)


def bands(scored: DataFrame, lang: str, out: str, margin: float = MARGIN) -> DataFrame:
    """(lang, low, high) of log perplexity, from the texts that pass the base rules. Quantiles are exact to 0.001, so a
    group keeps few values."""
    value = F.round(F.col(f"{out}.log_perplexity"), 3)
    half = GRID // 2
    quantiles = (
        scored.filter(F.col(f"{out}.log_perplexity").isNotNull() & ~base_failed(out))
        .groupBy(_language(lang).alias("band_lang"))
        .agg(F.percentile(value, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])).alias("q"))
    )
    halves = F.array(
        *[F.struct((F.col("q")[i + half] - F.col("q")[i]).alias("width"), F.col("q")[i].alias("a"), F.col("q")[i + half].alias("b")) for i in range(half + 1)]
    )
    shortest = quantiles.select("band_lang", F.array_min(halves).alias("s"))
    return shortest.select("band_lang", (F.col("s.a") - margin).alias("band_low"), (F.col("s.b") + margin).alias("band_high"))


def base_failed(out: str) -> Column:
    return (F.col(f"{out}.n_words") < 50) | (100 * F.col(f"{out}.n_repeat_words") > 50 * F.col(f"{out}.n_words"))


def judged(docs: DataFrame, keep: list[str] | None = None, margin: float = MARGIN) -> tuple[DataFrame, str]:
    """The columns `keep` of `docs` (all, unless given) and one struct column, whose name comes
    second: the surface counts, log_perplexity, base_failed and kept.

    A missing text counts as empty: it has no word and fails the base rules. A missing language is
    a language of its own. A text without any 4-gram has no perplexity and goes by the base rules
    alone. Equal rows get equal verdicts. Columns of any other name pass through.
    """
    out, low, high, key = fresh(docs, "quality", "band_low", "band_high", "band_lang")
    keep = docs.columns if keep is None else keep
    needed = keep if "lang" in keep else [*keep, "lang"]
    # only the columns that are needed go through Python
    sent = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(["text", *needed])])
    scored = stage(with_scores(sent, "text", "lang", out, needed), "scored")
    # one written row a language: its true size lets Spark send it to the rows, which need no shuffle by language then
    limits = stage(bands(scored, "lang", out, margin).toDF(key, low, high), "bands")
    value = F.col(f"{out}.log_perplexity")
    inside = F.coalesce(value.between(F.col(low), F.col(high)), F.lit(True))
    judged_ = scored.join(limits, _language("lang") == F.col(key), "left").withColumn(
        out,
        F.col(out).withField("base_failed", base_failed(out)).withField("kept", ~base_failed(out) & inside),
    )
    return judged_.select(*[F.col(f"`{c}`") for c in keep], out), out
