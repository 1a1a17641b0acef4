"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are near duplicates when one becomes the other by at most one edit: a word replaced,
inserted or left out. A line's variants are itself with one word left out; each is a hashed key
of the words before and after the gap. Lines that share a variant with the same gap differ in
that word alone; a line that equals another's variant lacks one of its words. Joining equal keys
so finds all pairs within the bound, and the pairs are verified on their words.

The variants of every line would be as many as its words. A single edit leaves the first or the
last half of the shorter line untouched, so only lines that share such a half with another line
(the survivors) get variants, and only with gaps outside the shared half.

Key groups are reduced to their earliest line, never paired out, so a frequent line or a line
with very many near copies costs one row a member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import fresh, stage, text_column

MIN_WORDS, EDIT_WORDS = 5, 10
BLOCK = 64
FILTER_BITS = 2**25
OTHER_SPACE = "\t\x0B\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(line: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII white space. Most lines need no look at each character."""
    plain = F.octet_length(line) == F.length(line)
    for space in OTHER_SPACE:
        plain = plain & ~F.contains(line, F.lit(space))
    clean = F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER + OTHER_SPACE, LOWER + " " * len(OTHER_SPACE)))
    return F.array_remove(F.split(clean, " "), "")


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once a row, not at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefixes(words: Column) -> Column:
    """Hashes of the first 0, 1, ..., n words. Built from blocks, so a very long line stays near linear."""

    def from_blocks(blocks: Column) -> Column:
        hashes = F.transform(blocks, lambda b: F.xxhash64(b))
        sums = _let(
            hashes,
            lambda h: F.transform(F.sequence(F.lit(0), F.size(h)), lambda b: F.xxhash64(F.slice(h, F.lit(1), b))),
        )

        def all_prefixes(before: Column) -> Column:
            def prefix(i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                rest = F.slice(F.coalesce(F.get(blocks, block), F.array().cast("array<string>")), F.lit(1), i % BLOCK)
                return F.xxhash64(F.get(before, block), rest, i)

            return F.transform(F.sequence(F.lit(0), F.size(words)), prefix)

        return _let(sums, all_prefixes)

    last = F.floor((F.size(words) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(words, b * BLOCK + 1, BLOCK))
    return _let(cut, from_blocks)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, version, pos, words) of each line with MIN_WORDS words or more. version: hash of the whole text."""
    text = text_column()
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
        .select("doc", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        # out of an array of one, so that filters on the words do not cut the line a second time
        .select("doc", "version", "pos", F.explode(F.array(_words(F.col("line")))).alias("words"))
    )


def _keyed(lines: DataFrame, min_words: int) -> DataFrame:
    """Narrow rows: the two halves of a 128-bit hash of the line, its number of words and its place."""
    return lines.filter(F.size("words") >= min_words).select(
        "doc", "version", "pos", F.size("words").alias("n"), F.xxhash64("words").alias("h1"),
        F.xxhash64(F.lit(1), "words").alias("h2"), "words",
    )


def _halves(n: Column, words: Column) -> Column:
    """The hashed first and last halves that a line shares with any line one edit away."""
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    return F.flatten(
        F.transform(
            sizes,
            lambda h: F.array(
                F.xxhash64(F.lit("first"), h, F.slice(words, F.lit(1), h)),
                F.xxhash64(F.lit("last"), h, F.slice(words, n - h + 1, h)),
            ),
        )
    )


def _place() -> Column:
    return F.struct("doc", "pos")


def _holding(texts: DataFrame, at: DataFrame) -> DataFrame:
    """The rows of `texts` whose version may occur in `at`: a bit set of FILTER_BITS by version, whatever the size of both."""
    per_bucket = 32_768  # the size of Spark's bitmaps
    bucket = F.pmod(F.shiftright("version", 15), F.lit(FILTER_BITS // per_bucket))
    bit = F.pmod("version", F.lit(per_bucket)).cast("int")
    bits = at.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return texts.join(F.broadcast(bits), bucket == F.col("_bucket")).filter(F.getbit(byte, bit % 8) == 1).drop("_bucket", "_bits")


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """(doc, version, pos) of each line that repeats an earlier one.

    Earlier goes by doc_id, then line number, whatever the row; rows without doc_id come last, as if they
    shared one. So lines with the same number in rows that share a doc_id stand at one place: equal ones are none
    earlier than the other, of different ones the one with the smaller hash is. Lines of `min_words` words
    or more go if an earlier line has the same words; lines of `edit_words` or more also if an
    earlier line of `edit_words` or more is one word edit away. Earlier lines count whether or not
    they go themselves. Missing and empty texts have no line that counts.
    """
    last = F.lit(2**63 - 1)
    lines = lines_of(docs).withColumn("doc", F.coalesce("doc", last))
    half = F.when(F.col("n") >= edit_words, _halves(F.col("n"), F.col("words")))
    keyed = stage(_keyed(lines, min_words).withColumn("halves", half).drop("words"), "keyed")
    first = F.min(F.struct("doc", "pos", "version"))
    classes = stage(keyed.groupBy("h1", "h2", "n", "halves").agg(first.alias("place"), F.count("*").alias("copies")), "lines")
    # lines that share a half with a different line
    in_halves = classes.filter("halves is not null").select("h1", F.posexplode("halves").alias("part", "key"))
    shared = in_halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a != b")
    survivors = (
        in_halves.join(shared.select("key"), "key")
        .groupBy("h1")
        .agg(F.max(F.col("part") % 2 == 0).alias("first"), F.max(F.col("part") % 2 == 1).alias("last"))
    )
    at = stage(
        classes.filter("halves is not null").join(survivors, "h1").select("place.*", "h1", "h2", "n", "first", "last"), "places"
    )
    text = text_column()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    lined = stage(
        _holding(texts, at).join(at, ["doc", "version"])
        .select("doc", "pos", "h1", "h2", "n", "first", "last", _words(F.get(F.split("text", "\n"), F.col("pos"))).alias("words"))
        .filter((F.xxhash64("words") == F.col("h1")) & (F.xxhash64(F.lit(1), "words") == F.col("h2")))
        .dropDuplicates(["h1", "h2"]),
        "survivors",
    )
    n = F.col("n")
    # a shared first half leaves gaps in the rest of the line, a shared last half those before it
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n + 1) / 2).cast("int")
    start, stop = F.when(F.col("first") & ~F.col("last"), low).otherwise(0), F.when(F.col("first"), n).otherwise(high)

    def keys(s: Column) -> Column:
        p, q = s["p"], s["q"]
        left_out = F.transform(
            F.sequence(start, F.least(stop, n - 1)),
            lambda i: F.struct(F.xxhash64(F.get(p, i), F.get(q, n - 1 - i)).alias("key"), F.lit(True).alias("gap")),
        )
        whole = F.transform(
            F.sequence(start, stop),
            lambda i: F.struct(F.xxhash64(F.get(p, i), F.get(q, n - i)).alias("key"), F.lit(False).alias("gap")),
        )
        return F.concat(left_out, whole)

    both = F.struct(
        _prefixes(F.col("words")).alias("p"), _let(F.reverse("words"), _prefixes).alias("q")
    )
    variants = stage(
        lined.select("doc", "pos", "h1", F.explode(_let(both, keys)).alias("v")).select("doc", "pos", "h1", "v.key", "v.gap"), "variants"
    )
    place = F.struct("doc", "pos", "h1")
    gapped, full = F.when(F.col("gap"), place), F.when(~F.col("gap"), place)
    # a line has a key at most once with a gap and once without
    firsts = (
        variants.groupBy("key")
        .agg(F.min(gapped).alias("gapped"), F.min(full).alias("full"), F.count(F.when(F.col("gap"), 1)).alias("gaps"))
        .filter("gaps > 1 or full is not null and gapped is not null")
        .drop("gaps")
    )
    # the earliest line that each survivor meets: any in its gap's group, or across gapped and full
    meets = F.when(F.col("gap"), F.least("gapped", "full")).otherwise(F.col("gapped"))
    pairs = (
        variants.join(firsts, "key")
        .select(place.alias("place"), meets.alias("other"))
        .filter("other < place")
        .groupBy("place").agg(F.min("other").alias("other"))
    )
    # verify on the words: one edit at most
    words = lined.select(place.alias("other"), F.col("words").alias("other_words"))
    own = lined.select("h1", place.alias("place"), "h2", "words")
    near = stage(
        pairs.join(own, "place").join(words, "other").filter(within_one("words", "other_words"))
        .select("h1", "h2").distinct(),
        "near",
    )
    verdict = classes.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("copies > 1 or near")
    return (
        keyed.select("doc", "version", "pos", "h1", "h2")
        .join(verdict.select("h1", "h2", "place", "near"), ["h1", "h2"])
        .filter(F.col("near") | (F.struct("place.doc", "place.pos") < _place()))
        .select("doc", "version", "pos")
    )


def within_one(a: str, b: str) -> Column:
    """One word edit or none apart: what the common first words and the common last words leave over."""
    a, b = F.col(a), F.col(b)
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x == y)
    back = F.zip_with(
        F.slice(F.reverse(a), F.lit(1), least), F.slice(F.reverse(b), F.lit(1), least), lambda x, y: x == y
    )

    def run(flags: Column) -> Column:
        first = F.array_position(flags, False)
        return F.when(first == 0, F.size(flags)).otherwise(first - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return (longest - least <= 1) & (run(same) + run(back) >= longest - 1)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): the numbers of the lines that go, from 0, for each row of `docs`."""
    gone = (
        dropped_lines(docs, min_words, edit_words).groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )
    text = text_column()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.size(F.split(text, "\n")).alias("n_lines")
    )
    same = (F.coalesce("doc_id", F.lit(2**63 - 1)) == gone["doc"]) & (rows["version"] == gone["version"])
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.join(gone, same, "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped")
    )


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """`docs` without the lines that repeat earlier ones; all columns stay and n_chars, if any, is counted anew.

    A row that loses nothing is left as it is. A row whose lines all go leaves the table.
    """
    gone = (
        dropped_lines(docs, min_words, edit_words).groupBy("doc", "version").agg(F.collect_set("pos").alias("dropped"))
    )
    doc, version, dropped, kept = fresh(docs, "doc", "version", "dropped", "kept")
    gone = gone.toDF(doc, version, dropped)
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)) == F.col(doc)) & (
        F.xxhash64(text_column()) == F.col(version)
    )
    lines = F.split(F.col("text").cast("string"), "\n")
    rest = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col(dropped), s["i"]))
    joined = docs.join(gone, same, "left").withColumn(kept, F.when(F.col(dropped).isNotNull(), rest))
    left = joined.filter(F.col(kept).isNull() | (F.size(kept) > 0))
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.col(kept), lambda s: s["x"]), "\n"))
    out = left.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = f"""
WITH l AS (
  SELECT doc_id, x.i - 1 AS pos, list_filter(string_split_regex(translate(x.line, '{UPPER}', '{LOWER}'), '[ \\t\\x0B\\f\\r]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda line, i: {{'i': i, 'line': line}})) AS x FROM documents)
), keyed AS (
  SELECT doc_id, pos, len(words) AS n, list_aggregate(words, 'string_agg', ' ') AS line, words FROM l WHERE len(words) >= {MIN_WORDS}
), classes AS (
  SELECT line, any_value(words) AS words, any_value(n) AS n, min((doc_id, pos)) AS place FROM keyed GROUP BY line
), variants AS (
  SELECT line, n, place, i, list_aggregate(words[1:i - 1] || words[i + 1:], 'string_agg', ' ') AS v
  FROM (SELECT line, n, place, words, unnest(range(1, n + 1)) AS i FROM classes WHERE n >= {EDIT_WORDS})
), replaced AS (
  SELECT line, min(first) AS other FROM (SELECT line, min(place) OVER (PARTITION BY n, i, v) AS first FROM variants) GROUP BY line
), crossed AS (
  SELECT v.line AS long, v.place AS long_place, c.line AS short, c.place AS short_place
  FROM variants v JOIN classes c ON c.line = v.v AND c.n >= {EDIT_WORDS}
), gone AS (
  SELECT line FROM classes JOIN replaced USING (line) WHERE other < place
  UNION SELECT long FROM crossed WHERE short_place < long_place
  UNION SELECT short FROM crossed WHERE long_place < short_place
), dropped AS (
  SELECT k.doc_id, k.pos FROM keyed k JOIN classes c USING (line)
  WHERE c.place < (k.doc_id, k.pos) OR k.line IN (SELECT line FROM gone)
)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10))) AS n_lines, coalesce(g.n, 0) AS n_dropped,
       coalesce(g.list, '') AS dropped
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS list FROM dropped GROUP BY doc_id
) g USING (doc_id)
"""
