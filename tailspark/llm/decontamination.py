"""Benchmark decontamination: a broadcast hash set of test n-grams, looked up by every token window.

Words are runs of ASCII letters and digits and of all other code points from U+0080 on, with A-Z in
lower case. A window is `n` consecutive words of a benchmark item; an item of fewer words is one
window. The distinct windows become a sorted array of 64-bit hashes behind a bit table, which
goes to every task. A task hashes all windows of its texts, looks them up, compares the words of
each hit with the window's own, and marks the words that hits cover.

The set's size is checked: a benchmark of more than `SET_ROWS` windows (or `SET_BYTES` of them) is
cut into parts of that size, and the texts are scanned once for each part, their marks carried
along. No row is shuffled, so hot passages and hot ids cost nothing but their own bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tailspark.llm.common import MIX, chunks, ends, fresh, let_go, mix, stage, text_column

WINDOW = 10
SET_ROWS, SET_BYTES = 1_000_000, 128_000_000
SEGMENT = 1_000_000  # bytes whose prefix sums are held at once
FOUND = "struct<n_words: bigint, spans: array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items: array<string>>"
SPAN = pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# a 64-bit number for each byte, and a base whose powers weigh the places; it is odd, so it has an inverse
BYTES = mix(LOWER.astype(np.uint64) * MIX + np.uint64(1))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ..., at least `n` of them."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, SEGMENT + 1), np.uint64(base))
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base]


class Words:
    """The words of a batch of texts, flat: places in the bytes, hashes, and the text each belongs to."""

    def __init__(self, texts: pa.Array):
        held = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, 8 * held.offset) if len(held) else np.zeros(1, np.int64)
        data = held.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside = IN_WORD[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        outside = np.concatenate([[True], ~inside, [True]])
        self.starts = np.flatnonzero(inside & (outside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inside & (outside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text; the last is the end
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """One per word, from differences of prefix sums over segments of whole words."""
        found = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(found):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SEGMENT, "right")))
            low, high = int(self.starts[i]), int(self.ends[j - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTES[self.data[low:high]] * _powers(BASE, high - low)[: high - low], out=sums[1:])
            s, e = self.starts[i:j] - low, self.ends[i:j] - low
            found[i:j] = mix((sums[e] - sums[s]) * _powers(INVERSE, high - low)[s])
            i = j
        return found

    def normal(self) -> tuple[np.ndarray, np.ndarray]:
        """The words in lower case with one space after each (none at a text's end without one), and each byte's place there."""
        after = self.ends[self.ends < len(self.data)]
        after = after[~self.inside[after]]
        keep = self.inside.copy()
        keep[after] = True
        place = ends(keep)
        bytes_ = LOWER[self.data[keep]]
        bytes_[place[after]] = 32
        return bytes_, place


def _windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` words, across texts too."""
    total = np.full(max(0, len(hashes) - n + 1), np.uint64(n))
    for k in range(n):
        total = total * np.uint64(BASE) + hashes[k : k + len(total)]
    return mix(total)


class HashSet:
    """Distinct windows by hash, their words for verification, and the items that hold each."""

    def __init__(self, windows: pa.Array, items: pa.Array):
        coded, named = windows.dictionary_encode(), items.dictionary_encode()
        self.items = named.dictionary
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.item = named.indices.to_numpy()[order]
        distinct = coded.dictionary
        self.stop = ends(np.bincount(code, minlength=len(distinct)))
        held = distinct.cast(pa.large_binary())
        self.at = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1).copy()
        self.bytes = np.frombuffer(held.buffers()[2], np.uint8).copy()
        words = Words(distinct)
        hashes = words.hashes()
        self.lookups = {}
        for n in np.unique(words.counts).tolist():
            which = np.flatnonzero(words.counts == n)
            of = _windows(hashes, n)[words.first[which]]
            order = np.argsort(of)
            bits = max(16, int(16 * len(of)).bit_length())
            shift = np.uint64(64 - bits)
            table = np.zeros(1 << bits, bool)
            table[of >> shift] = True
            _, runs = np.unique(of, return_counts=True)
            self.lookups[n] = table, shift, of[order], which[order], int(runs.max())

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and window of every verified occurrence."""
        found = []
        hashes = words.hashes() if len(words.starts) else np.empty(0, np.uint64)
        for n, (table, shift, sorted_, which, runs) in self.lookups.items():
            if len(hashes) < n:
                continue
            of = _windows(hashes, n)
            likely = np.flatnonzero(table[of >> shift])
            likely = likely[words.text[likely] == words.text[likely + n - 1]]
            at = np.searchsorted(sorted_, of[likely])
            for step in range(runs):  # windows that share a hash stand side by side
                here = np.minimum(at + step, len(sorted_) - 1)
                same = sorted_[here] == of[likely]
                found.append((likely[same], np.full(same.sum(), n), which[here[same]]))
        if not found or not sum(len(f[0]) for f in found):
            none = np.empty(0, np.int64)
            return none, none, none
        first, n, window = (np.concatenate(x) for x in zip(*found))
        true = self._verified(words, first, n, window)
        return first[true], n[true], window[true]

    def _verified(self, words: Words, first: np.ndarray, n: np.ndarray, window: np.ndarray, step: int = 20_000) -> np.ndarray:
        """Whether the words are the window's, byte for byte."""
        normal, place = words.normal()
        low, high = place[words.starts[first]], place[words.ends[first + n - 1]]
        own, size = self.at[window], self.at[window + 1] - self.at[window]
        true = high - low == size
        some = np.flatnonzero(true)
        for i in range(0, len(some), step):
            part = some[i : i + step]
            stop = ends(size[part])
            inner = np.arange(stop[-1]) - np.repeat(stop[:-1], size[part])
            differs = normal[np.repeat(low[part], size[part]) + inner] != self.bytes[np.repeat(own[part], size[part]) + inner]
            true[part] = np.add.reduceat(differs.astype(np.int64), stop[:-1]) == 0
        return true


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends(counts).astype(np.int32)), values)


def _scanned(texts: pa.Array, known: HashSet, before: pa.Array | None) -> pa.Array:
    """FOUND for each text; `before`: what earlier parts of the set found."""
    words = Words(texts)
    rows = len(words.counts)
    first, n, window = known.hits(words)
    change = np.bincount(first, minlength=len(words.starts) + 1) - np.bincount(first + n, minlength=len(words.starts) + 1)
    text = words.text[first]
    pairs = np.unique(text * len(known.stop) + window)
    text, window = pairs // len(known.stop), pairs % len(known.stop)
    held = known.stop[window + 1] - known.stop[window]
    item = known.item[np.repeat(known.stop[window], held) + np.arange(held.sum()) - np.repeat(ends(held)[:-1], held)]
    names, owner = known.items.take(pa.array(item)), np.repeat(text, held)
    if before is not None:
        old = before.field("spans")
        spans, of = old.flatten(), np.repeat(np.arange(rows), pc.list_value_length(old).to_numpy())
        base = words.first[of]
        change += np.bincount(base + spans.field("first").to_numpy(), minlength=len(change))
        change -= np.bincount(base + spans.field("last").to_numpy() + 1, minlength=len(change))
        old = before.field("items")
        names = pa.concat_arrays([names, old.flatten()])
        owner = np.concatenate([owner, np.repeat(np.arange(rows), pc.list_value_length(old).to_numpy())])
    covered = np.cumsum(change)[:-1] > 0
    head = np.zeros(len(covered), bool)
    head[words.first[:-1][words.counts > 0]] = True
    gap = ~covered
    opens = np.flatnonzero(covered & (head | np.concatenate([[True], gap[:-1]])[: len(covered)]))
    closes = np.flatnonzero(covered & np.concatenate([head | gap, [True]])[1:])
    of = words.text[opens]
    spans = pa.StructArray.from_arrays(
        [
            pa.array(opens - words.first[of]), pa.array(closes - words.first[of]),
            pa.array(words.starts[opens] - words.offsets[of]), pa.array(words.ends[closes] - words.offsets[of]),
        ],
        fields=list(SPAN),
    )
    coded = names.dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs = np.unique(owner * width + coded.indices.to_numpy())
    items = coded.dictionary.take(pa.array(pairs % width)) if len(pairs) else pa.array([], pa.string())
    return pa.StructArray.from_arrays(
        [
            pa.array(words.counts.astype(np.int64)),
            _lists(np.bincount(of, minlength=rows), spans),
            _lists(np.bincount(pairs // width, minlength=rows), items),
        ],
        names=["n_words", "spans", "items"],
    )


def _scan(shared, out: str, text: str, kept: list[str], chained: bool):
    def run(batches):
        let_go()
        known = shared.value
        for batch in batches:
            for part in chunks(batch, text):
                before = part.column(out) if chained else None
                found = _scanned(part.column(text), known, before)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], found], names=[*kept, out])

    return run


def _items(n: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                normal, place = words.normal()
                # every run of n words that stays inside its item; of a shorter item all words
                size = np.minimum(words.counts, n)
                many = np.where(words.counts > 0, words.counts - size + 1, 0)
                of = np.repeat(np.arange(len(many)), many)
                first = words.first[of] + np.arange(many.sum()) - np.repeat(ends(many)[:-1], many)
                low, high = place[words.starts[first]].tolist(), place[words.ends[first + size[of] - 1]].tolist()
                raw = normal.tobytes()
                windows = pa.array([raw[a:b] for a, b in zip(low, high)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(of)), windows], names=["item", "window"])

    return run


def windows_of(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item, window), distinct: each item's windows in normal form. Rows that share an item_id are one item, as are
    those without one, whose name is empty."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_column().alias("text"))
    return rows.mapInArrow(_items(n), "item string, window string").distinct()


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, keep: list[str] | None = None, set_rows: int = SET_ROWS) -> tuple[DataFrame, str]:
    """The columns `keep` of `docs` (all, unless given) and one struct column FOUND, whose name comes second: the number
    of words, the spans of hit words (numbers of the first and last word, byte offsets in UTF-8) and the items
    with occurring windows.

    Missing and empty texts have no words, and neither have such items. Equal rows get equal results; ids play no
    part. Columns of any other name pass through.
    """
    out, text = fresh(docs, "found", "text")
    kept = docs.columns if keep is None else keep
    pairs = stage(windows_of(items, n), "windows")
    size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    parts = max(1, math.ceil(size[0] / set_rows), math.ceil(size[1] / SET_BYTES))
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias(text))
    result = StructType.fromDDL(f"`{out}` {FOUND}").fields
    through = [StructField(c, rows.schema[c].dataType) for c in (kept if parts == 1 else [*kept, text])]
    if not size[0]:
        none = F.from_json(F.lit('{"spans": [], "items": []}'), FOUND)
        counted = none.withField("n_words", F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long"))
        return rows.select(*[F.col(f"`{c}`") for c in kept], counted.alias(out)), out
    found = rows
    for number in range(parts):
        # one part at a time passes the driver, at most about `set_rows` windows
        part = pairs.filter(F.pmod(F.xxhash64("item", "window"), F.lit(parts)) == number).toArrow()
        if not part.num_rows:
            continue
        columns = [part.column(c).combine_chunks() for c in ("window", "item")]
        shared = spark.sparkContext.broadcast(HashSet(*columns))
        names = [f.name for f in through]
        found = found.mapInArrow(_scan(shared, out, text, names, out in found.columns), StructType(through + result))
        if parts > 1:
            found = stage(found, "scanned")
    return found.select(*[F.col(f"`{c}`") for c in kept], out), out


def n_hit(found: str) -> Column:
    spans = F.col(f"{found}.spans")
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)


def report(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`."""
    found, out = scan(docs, items, n, keep=["doc_id"])
    names = F.col(f"{out}.items")
    return found.select(
        "doc_id", F.col(f"{out}.n_words").alias("n_words"), n_hit(out).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256"), (n_hit(out) > 0).alias("contaminated"),
    )


def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the bytes of their spans."""

    def one(text, found):
        raw, parts, at = text.encode("utf-8"), [], 0
        for s in found:
            parts.append(raw[at : s["start"]])
            at = s["end"]
        return b"".join([*parts, raw[at:]]).decode("utf-8")

    return texts.combine(spans, one)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, whole: bool = False, most: float = 1.0) -> DataFrame:
    """`docs` without the hit spans, or with `whole` without every document that has one.

    A document of whose words more than the share `most` is hit goes in either case. What stood around a span stays, so
    the words beside it do not join. n_chars, if any, is counted anew where a span goes; other columns stay.
    """
    found, out = scan(docs, items, n)
    hit = n_hit(out)
    if whole:
        return found.filter(hit == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    left = found.filter(hit <= F.lit(most) * F.col(f"{out}.n_words"))
    touched = F.size(f"{out}.spans") > 0
    clean = left.filter(~touched)
    cut = left.filter(touched).withColumn("text", F.pandas_udf(without, "string")(F.col("text").cast("string"), F.col(f"{out}.spans")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(cut).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.v = x.v
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items k USING (doc_id)
"""
