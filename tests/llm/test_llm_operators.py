"""Every operator of the subpackage against a brute-force version, and on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailspark.llm import (
    arrowfiles, licences, linedup, minhash, mixing, packing, perplexity, syncmers, tokencount, tokens, transcripts,
)
from tailspark.llm.common import bounds_of, split_words, with_bucket

WORDS = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, kept string, key string, block string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["an", "er", "th", "ou", "ti", "en"], rng.integers(1, 4))) for _ in range(n))


BASE = sentence(1, 120)
ODD = [
    (0, BASE, "en", "a"),
    (1, BASE, "en", "a"),
    (1, BASE, "en", "a"),
    (2, BASE.replace("er", "ER", 1) + " more", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n\n ", "fr", None),
    (6, "one", "fr", "c"),
    (7, sentence(2, 80) + "\n" + sentence(3, 12) + "\n" + sentence(3, 12), "en", "c"),
    (8, sentence(3, 12).replace(" ", "  ", 1) + "\n" + sentence(4, 60), "en", "c"),
    (9, " ".join([sentence(3, 12).split()[0] + "x", *sentence(3, 12).split()[1:]]) + "\n" + sentence(5, 70), "en", "c"),
    (10, "x " * 200, "en", "d"),
    (11, "".join(f"{w}%%% " for w in sentence(6, 90).split()), "en", "d"),
    (12, "é́ Under the MIT-License. 日本語 <|endoftext|> it's 12\x00 a b", "xx", "d"),
    (None, sentence(7, 60), "en", "a"),
    (None, None, "en", "a"),
    (13, sentence(8, 9000), "en", "a"),
    (-5, "Licensed under the Apache License, Version 2.0 (the \"License\"); cc by nc cc-by-nc", "en", "a"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", "k", "k") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.model_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# --- op1 ---------------------------------------------------------------------------


def test_fingerprints(odd):
    rows = syncmers.fingerprints(odd).collect()
    order = sorted(ODD, key=lambda r: r[1] or "", reverse=True)
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    want = []
    for i, (r, text) in enumerate(zip(order, texts)):
        changed = syncmers.edited(text, texts[(i + 1) % len(texts)])
        want.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert len(rows) == len(ODD)
    key = lambda x: (x[0] is not None, x)
    some = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows if r["doc_id"] is not None]
    assert sorted(some, key=key) == sorted([w for w in want if w[0] is not None], key=key)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"]
    assert by_id[13]["near_edited"] > 0.5 > by_id[13]["near_next"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_fingerprints_small_tables(spark, empty):
    assert syncmers.fingerprints(empty).collect() == []
    (row,) = syncmers.fingerprints(table(spark, [(7, "abcdef", "en", "s")])).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_syncmers_are_the_runs_with_an_edge_minimum():
    text = sentence(9, 40)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at, hashes = syncmers.anchors(points)
    inner = {text[i : i + syncmers.S]: syncmers._runs(points.astype(np.uint64) + np.uint64(1), syncmers.S)[i] for i in range(len(text) - syncmers.S + 1)}
    want = []
    for i in range(len(text) - syncmers.K + 1):
        runs = [inner[text[j : j + syncmers.S]] for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(runs) in (runs[0], runs[-1]):
            want.append(i)
    assert at.tolist() == want and len(set(hashes.tolist())) == len({text[i : i + syncmers.K] for i in want})


def test_fingerprints_of_equal_and_edited_texts():
    text = sentence(10, 400)
    own = syncmers.sketch(text)
    assert syncmers.likeness(own, syncmers.sketch(text)) == 1.0
    assert syncmers.likeness(own, syncmers.sketch(text[:1500] + "ZZ" + text[1500:])) > 0.9
    assert syncmers.likeness(own, syncmers.sketch(sentence(11, 400))) < 0.2


# --- op2, op3, op7 -----------------------------------------------------------------


def test_packing(odd, empty, library):
    rows = packing.pack_documents(odd).collect()
    assert packing.pack_documents(empty).collect() == []
    place = {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in place.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= packing.WINDOW
    want = [(r[0], np.array([*ids_of(library, r[1]), packing.END_ID], "<u4")) for r in ODD]
    for doc in {r[0] for r in ODD}:
        own = [ids for d, ids in want if d == doc]
        got = [r for r in rows if r["doc_id"] == doc]
        assert sum(r["length"] for r in got) == sum(map(len, own))
        crcs = {zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) for ids in own for r in got if r["doc_tokens"] == len(ids)}
        assert {r["ids_crc32"] for r in got} <= crcs


def test_sum_of_squares_rule():
    def squares(levels):
        return sum(int(n) ** 2 for n in levels.count[1 : levels.window])

    rng, window = np.random.default_rng(0), 16
    levels = packing.Levels(window)
    for size in rng.integers(1, window, 300).tolist():
        options = {}
        for level in [0, *[h for h in range(1, window - size + 1) if levels.count[h]]]:
            count = levels.count.copy()
            if level:
                count[level] -= 1
            count[level + size] += 1
            options[level] = sum(int(n) ** 2 for n in count[1:window])
        level = levels.place(size)
        assert options[level] == min(options.values())
        at = levels.take(level) if level else 0
        levels.put(level + size, at)


def test_packing_cuts_and_fills():
    sizes = np.random.default_rng(1).integers(1, 5000, 500)
    pieces = packing.pack(sizes, 2048)
    windows = {p[3] for p in pieces}
    assert len(windows) == -(-sizes.sum() // 2048)
    for doc, size in enumerate(sizes):
        own = sorted((p[1], p[2]) for p in pieces if p[0] == doc)
        assert [s for s, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) == size


def test_token_counts(odd, empty, library):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(odd).collect())
    want = sorted(
        (r[0] is None, r[0] or 0, len((r[1] or "").encode()), n := len(ids_of(library, r[1])), n > 2048) for r in ODD
    )
    assert got == want and tokencount.token_counts(empty).collect() == []


ODD_TEXTS = [
    "", "a<|endoftext|>b <|ENDOFTEXT|><|startoftext|>", "it's I'LL don't x'y ''s", "é́ İstanbul ǅ ﬁ ΣΑΣ",
    "12 3a4, a1b2!!'s ?!'ll", " a b　c\x1c\x85d", "日本語テスト 中文。한국어", "\x00 ﻿ a‍b 👩‍👧 🇫🇷",
    "aaaaaaaaaaaaaaaaaa hahahahaha", "!" * 50, "Ⅷ ² ½ ſ K Å",
]


def test_both_coders_equal_the_library(library):
    texts = ODD_TEXTS + [r[1] or "" for r in ODD]
    want = [ids_of(library, t) for t in texts]
    ids, sizes = tokens.WordCoder.load(tokens.model_path()).encode(pa.array(texts))
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert tokencount.RankMerger.load(tokens.model_path()).count(pa.array(texts)).tolist() == list(map(len, want))


@pytest.mark.parametrize("warm", [False, True])
def test_ids_where_lower_case_is_longer(library, warm):
    longer = [chr(i) for i in range(0x250, 0x1F000) if len(chr(i).lower()) > 1] + ["İ"]
    rng = np.random.default_rng(8)
    letters = [*longer, *longer, *"aZéÉßIı", "\u0307", "\u0301", "ﬁ", "ǅ", "Σ"]
    words = ["".join(rng.choice(letters, rng.integers(1, 5))) + str(rng.choice(["", ".", ",", "?!", "...", "'s", "-", ";:"])) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(20_000)] + ["ALİ, geldi.", "BİRİNCİ. bölüm", "İstanbul, Ankara"]
    coder = tokens.WordCoder(tokens.model_path())
    for part in [texts, texts] if warm else [texts]:
        ids, sizes = coder.encode(pa.array(part))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_arrow_files(spark, odd, empty, library, tmp_path):
    manifest = arrowfiles.write_sequences(odd, str(tmp_path / "seq"), length=64)
    rows = {}
    for r in arrowfiles.read_documents(manifest).collect():
        rows.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, {}
    for r in order:
        ids = np.array([*ids_of(library, r[1]), arrowfiles.END_ID], "<u4")
        want.setdefault(r[0], []).append((at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert {k: sorted(v) for k, v in rows.items()} == want
    first = manifest.orderBy("bucket").first()
    file = arrowfiles.SequenceFile(first["path"])
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == 64 and mask[: min(64, first["n_tokens"])].all()
    assert arrowfiles.read_documents(arrowfiles.write_sequences(empty, str(tmp_path / "none"))).collect() == []


# --- op4 ---------------------------------------------------------------------------


def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows):
    lines = []
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            words = WORDS.findall(lower(line))
            if len(words) >= linedup.MIN_WORDS:
                lines.append((doc, pos, words))
    gone = set()
    for (d, p, w), (e, q, v) in itertools.product(lines, lines):
        earlier = (e is None, e or 0, q) < (d is None, d or 0, p)
        if earlier and (w == v or min(len(w), len(v)) >= linedup.EDIT_WORDS and one_edit(w, v)):
            gone.add((d, p))
    return gone


def test_lines(spark, odd, empty):
    got = {(r["doc_id"], p) for r in linedup.line_report(odd).collect() for p in r["dropped"]}
    assert got == brute_lines([(r[0], r[1]) for r in ODD])
    assert linedup.line_report(empty).collect() == [] and linedup.deduplicate_lines(empty).collect() == []


def test_lines_near_each_other(spark):
    rng = np.random.default_rng(3)
    rows = []
    for doc in range(60):
        words = sentence(50 + doc % 4, 10 + doc % 3).split()
        for _ in range(rng.integers(0, 2)):
            i = int(rng.integers(0, len(words)))
            words[i : i + 1] = [["new"], [], [words[i], "add"]][rng.integers(0, 3)]
        rows.append((doc, " ".join(words) + "\n" + sentence(900 + doc, 11), "en", "s"))
    long = sentence(77, 700).split()
    rows += [(100, " ".join(long), "en", "s"), (101, " ".join(long[:400] + ["z"] + long[401:]), "en", "s"), (102, " ".join(long[:64] + long[65:]), "en", "s")]
    got = {(r["doc_id"], p) for r in linedup.line_report(table(spark, rows)).collect() for p in r["dropped"]}
    assert got == brute_lines([(r[0], r[1]) for r in rows]) and len(got) > 10


def test_lines_of_rows_without_id_or_with_one(spark):
    one, two = sentence(60, 14), sentence(61, 14)
    near = one.split()
    near[5] = "other"
    rows = [(None, one + "\n" + sentence(62, 8)), (None, sentence(63, 8) + "\n" + " ".join(near)), (None, two), (None, two)]
    rows += [(5, two + "\n" + sentence(64, 9)), (5, sentence(65, 9) + "\n" + two)]
    report = linedup.line_report(table(spark, [(i, t, "en", "s") for i, t in rows]))
    texts = {t: i for i, (_, t) in enumerate(rows)}
    got = sorted((r["doc_id"] is None, r["n_lines"], tuple(r["dropped"])) for r in report.collect())
    assert len(texts) == 5
    # of one's lines the later place goes, as does every copy of two after the first place of doc 5
    assert got == [(False, 2, ()), (False, 2, (1,)), (True, 1, (0,)), (True, 1, (0,)), (True, 2, ()), (True, 2, (1,))]
    many = [(None if i % 3 else i, sentence(i % 90, 12) + f" {i}\n" + sentence(i % 40, 20), "en", "s") for i in range(600)]
    left = linedup.deduplicate_lines(table(spark, many))
    lines = [x for r in left.collect() for x in r["text"].split("\n")]
    assert len({x for x in lines if not x[-1].isdigit()}) == 40 and len(lines) < 150


def test_the_bit_set_keeps_every_version(spark):
    texts = spark.range(5000).selectExpr("id as doc", "xxhash64(id) as version")
    at = texts.filter("doc % 50 = 0").select("version")
    kept = {r["doc"] for r in linedup._holding(texts, at).collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 200


def test_lines_rebuild(odd):
    out = linedup.deduplicate_lines(odd)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert 1 not in rows and rows[8]["text"] == sentence(4, 60) and rows[8]["n_chars"] == len(sentence(4, 60))
    assert rows[0]["text"] == BASE and rows[3]["text"] is None and rows[4]["text"] == ""


# --- op5 ---------------------------------------------------------------------------


def brute_base(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(windows) < 2000 else set()
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
    )


def brute_log_probability(grams):
    """Modified Kneser-Ney by its definition, for every gram seen."""
    levels, counts = {}, dict(grams)
    for n in range(perplexity.ORDER, 0, -1):
        levels[n] = counts
        lower_counts = {}
        for g in counts:
            lower_counts[g[1:]] = lower_counts.get(g[1:], 0) + 1
        counts = lower_counts

    def discount(n, c):
        of = [sum(1 for x in levels[n].values() if x == i) for i in range(5)]
        if not of[1] or not of[2]:
            return 0.5
        y = of[1] / (of[1] + 2 * of[2])
        c = min(c, 3)
        d = 1.5 if c == 3 and not of[3] else c - (c + 1) * y * of[c + 1] / of[c]
        return min(max(d, 0.05), c)

    def p(g):
        if not g:
            return 1 / perplexity.SIZE
        table_, own = levels[len(g)], levels[len(g)].get(g, 0)
        same = {k: v for k, v in table_.items() if k[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        free = sum(discount(len(g), v) for v in same.values()) / total
        return (own - discount(len(g), own) if own else 0) / total + free * p(g[1:])

    return {g: np.log(p(g)) for g in grams}


def unpacked(code):
    return tuple((int(code) >> (perplexity.BITS * (perplexity.ORDER - 1 - i))) & (perplexity.SIZE - 1) for i in range(perplexity.ORDER))


def test_kneser_ney():
    code, _ = perplexity.grams([sentence(i, 30) for i in range(8)])
    codes, counts = np.unique(code, return_counts=True)
    want = brute_log_probability({unpacked(c): int(n) for c, n in zip(codes, counts)})
    got = perplexity.KneserNey(codes, counts).log_probability(codes)
    assert np.allclose(got, [want[unpacked(c)] for c in codes])


def test_probabilities_sum_to_one():
    code, _ = perplexity.grams([sentence(i, 200) for i in range(4)])
    model = perplexity.KneserNey(*np.unique(code, return_counts=True))
    every = (int(code[5]) >> perplexity.BITS << perplexity.BITS) + np.arange(perplexity.SIZE)
    assert np.exp(model.log_probability(every)).sum() == pytest.approx(1.0)


def test_quality(spark, odd, empty):
    found, out = perplexity.judged(odd, keep=["doc_id", "text"])
    rows = found.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        q = r[out]
        base = brute_base(r["text"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(q[n] for n in names[:4]) == base[:4]
        if base[0] < 2000:
            assert q["n_repeat_words"] == base[4]
        assert q["base_failed"] == (q["n_words"] < 50 or 2 * q["n_repeat_words"] > q["n_words"])
        assert not (q["base_failed"] and q["kept"])
    assert perplexity.judged(empty)[0].collect() == []


def test_junk_is_rejected_and_clean_text_kept(spark):
    rows = [(i, sentence(i, 150), "en" if i % 2 else "fr", "s") for i in range(60)]
    rows += [(100 + i, "".join(f"{w}%%% " for w in sentence(200 + i, 150).split()), "en", "s") for i in range(3)]
    found, out = perplexity.judged(table(spark, rows))
    assert {r["doc_id"]: r[out]["kept"] for r in found.collect()} == {r[0]: r[0] < 100 for r in rows}


def test_a_third_of_junk_does_not_open_the_band(spark):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz  "))
    noise = ["".join(np.random.default_rng(i).choice(letters, 800)) for i in range(30)]
    for junk in (noise, noise[:1] * 30):
        rows = [(i, sentence(i, 150), "en", "s") for i in range(60)] + [(100 + i, t, "en", "s") for i, t in enumerate(junk)]
        rows += [(200, noise[-1], "en", "s")]
        found, out = perplexity.judged(table(spark, rows))
        kept = {r["doc_id"]: r[out]["kept"] for r in found.collect()}
        assert all(kept[i] for i in range(60)) and not kept[200]
        assert junk[0] == junk[1] or not any(kept[100 + i] for i in range(30))


def test_bands_of_mixed_and_hot_languages(spark):
    stats = lambda v: (100, 0, 0, 0, 0, v)
    kinds = [1.3 + i / 100 for i in range(60)]  # quartiles 0.3 apart
    groups = {"mixed": kinds + [3.2] * 10, "two": [1.4] * 30 + [1.8] * 30 + [3.0] * 25, "low": [1.5 + i / 1000 for i in range(60)] + [0.2] * 30}
    scored = spark.createDataFrame([(k, stats(v)) for k, vs in groups.items() for v in vs], f"lang string, q struct<{', '.join(f'{n}: bigint' for n in perplexity.STATS.names[:-1])}, log_perplexity: double>")
    band = {r[0]: (r[1], r[2]) for r in perplexity.bands(scored, "lang", "q").collect()}
    assert band["mixed"][0] < 1.3 and 1.9 < band["mixed"][1] < 3.2
    assert band["two"][0] < 1.4 and 1.8 < band["two"][1] < 3.0
    assert 0.2 < band["low"][0] < 1.5


def test_language_groups_change_nothing(spark):
    rows = [(i, sentence(i, 60), f"l{i % 3}", "s") for i in range(12)] + [(20, "", "l9", "s")]
    docs = table(spark, rows)
    score = lambda n: sorted((r["doc_id"], round(r["q"]["log_perplexity"] or 0, 6)) for r in perplexity.with_scores(docs, "text", "lang", "q", ["doc_id"], n).collect())
    assert score(10**9) == score(1)


def test_no_two_characters_share_their_symbols():
    characters = [chr(p) for p in (*range(0x80, 0x3000), *range(0x4E00, 0x5200), 0x10000, 0x1F600, 0x1F603) if chr(p) == chr(p).lower()]
    code, owner = perplexity.grams([c * 4 for c in characters])
    each = np.split(code, np.flatnonzero(np.diff(owner)) + 1)
    assert len({c.tobytes() for c in each}) == len(characters)


def test_another_script_costs_more_beyond_latin_1(spark):
    script = lambda seed, shift: "".join(c if c == " " else chr(0x430 + 3 * (ord(c) - 97) + shift) for c in sentence(seed, 150))
    # as many code points on, so that their remainders by three are the same
    rows = [(i, script(i, 0), "ru", "s") for i in range(60)] + [(100 + i, script(100 + i, shift), "ru", "s") for i, shift in enumerate((0x600, 0x900, 0x3000))]
    found = perplexity.with_scores(table(spark, rows), "text", "lang", "q", ["doc_id"]).collect()
    cost = {r["doc_id"]: r["q"]["log_perplexity"] for r in found}
    assert max(cost[i] for i in range(60)) < min(cost[i] for i in range(100, 103))


def test_look_up_survives_taken_places(monkeypatch):
    code, _ = perplexity.grams([sentence(i, 30) for i in range(8)])
    model = perplexity.KneserNey(*np.unique(code, return_counts=True))
    monkeypatch.setattr(perplexity, "SLOT_BITS", 4)
    known = perplexity._LookedUp()
    other = perplexity.KneserNey(np.empty(0, np.uint32), np.empty(0, np.int64))
    for _ in range(2):
        assert np.allclose(known.get(model, 0, code), model.log_probability(code), atol=1e-5)
        assert np.allclose(known.get(other, 1, code), -np.log(perplexity.SIZE), atol=1e-5)


# --- op6 ---------------------------------------------------------------------------


def test_licences(odd, empty):
    words = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = licences.digest(licences.scan(odd)).collect()
    want = []
    for doc, text, *_ in ODD:
        w = words.findall(lower(text or ""))
        places, labels = [], set()
        for label, phrase in licences.PHRASES:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        want.append((doc is None, doc or 0, len(w), len(places), min(places, default=-1), max(places, default=-1), ",".join(sorted(labels))))
    have = [
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_base"], -1 if r["first_word"] is None else r["first_word"],
         -1 if r["last_word"] is None else r["last_word"], r["base_labels"]) for r in got
    ]
    assert sorted(have) == sorted(want)
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licences.scan(empty).collect() == []


def test_licence_templates(spark):
    mit = dict((t[0], t[1]) for t in licences.TEMPLATES)["mit"]
    edited = mit.replace("associated documentation", "related docs").replace("publish", "print")
    broken = mit.replace("granted", "denied")
    rows = [(0, mit, "en", "s"), (1, "Hello. " + edited, "en", "s"), (2, broken, "en", "s"), (3, "all rights  reserved", "en", "s")]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in licences.digest(licences.scan(table(spark, rows))).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and 0.8 < got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3] == ("proprietary", 1.0)


def test_licence_key_phrases_are_enough(spark):
    """Key phrases are found though no document holds the template's other words, also where a text begins or ends."""
    texts = [t + " end" for _, _, keys in licences.TEMPLATES if len(keys) == 1 for t in keys]
    texts += ["Under the terms of the GNU General Public License", "Work licensed under the GNU General Public License version 3"]
    want = [label for label, _, keys in licences.TEMPLATES if len(keys) == 1] + ["gpl", "gpl"]
    mit = dict((t[0], t[1]) for t in licences.TEMPLATES)["mit"].split(" without limitation ")[0]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, "x " + mit])]
    got = {r["doc_id"]: r["matches"] for r in licences.scan(table(spark, rows)).collect()}
    for i, label in enumerate([*want, "mit"]):
        whole = [m for m in got[i] if not m["base"]]
        assert [m["label"] for m in whole] == [label], texts[i : i + 1]
        assert whole[0]["start"] == {len(texts) - 1: 2, len(texts): 1}.get(i, 0)
        assert 0 < whole[0]["score"] <= 1
    numbers, counts = np.array([0, 1, 0, 1, 0]), np.array([3, 2])  # a place never reaches into the next text
    doc, start, score = licences.find(numbers, counts, licences.Template("t", (9, 0, 1), ((1, 3),), False), np.zeros(10))
    assert (doc.tolist(), start.tolist()) == ([0], [-1]) and abs(score[0] - 2 / 3) < 1e-9


def brute_licences(words):
    """Labels whose key phrases all stand in order, looked for at every place, without index or votes."""

    def stop_of(i, phrase):
        spare, k = len(phrase) // licences.PER_WORD, 0
        while k < len(phrase):
            if i >= len(words):
                return None
            if words[i] == phrase[k]:
                k += 1
            elif k and spare:
                spare -= 1
            else:
                return None
            i += 1
        return i

    found = set()
    for label, whole, keys in licences.TEMPLATES:
        wanted = [(f" {whole} ".index(f" {key} "), key.split()) for key in keys]
        offsets = [whole[:at].count(" ") for at, _ in wanted]
        for first in range(len(words)):
            end, good = stop_of(first, wanted[0][1]), True
            if end is None:
                continue
            for offset, (_, key) in zip(offsets[1:], wanted[1:]):
                place = first + offset - offsets[0]
                stops = [stop_of(i, key) for i in range(max(end, place - licences.SLACK), min(len(words), place + licences.SLACK + 1))]
                end = next((x for x in stops if x is not None), None)
                if end is None:
                    good = False
                    break
            if good:
                found.add(label)
    return found


def test_licences_with_words_put_in(spark):
    """Insertions anywhere: nothing that brute force does not find, and at least 0.9 of what it finds."""
    rng = random.Random(11)
    prose = "tavo the of melin software copy karu license any and sende use in lopi this".split()
    texts = []
    for n in range(12):
        for label, whole, keys in licences.TEMPLATES:
            w = whole.split()
            for _ in range(rng.randrange(0, 1 + len(w) // 8)):
                w.insert(rng.randrange(1, len(w) + 1), rng.choice(prose))
            if n % 3 == 0:  # words left out at the end
                w = w[: rng.randrange(len(w) // 2, len(w) + 1)]
            texts.append(rng.choices(prose, k=rng.randrange(0, 400)) + w + rng.choices(prose, k=rng.randrange(0, 400)))
    texts += [rng.choices(prose, k=500) for _ in range(40)]
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate(texts)]
    got = {r["doc_id"]: {m["label"] for m in r["matches"] if not m["base"]} for r in licences.scan(table(spark, rows)).collect()}
    want = {i: brute_licences(w) for i, w in enumerate(texts)}
    assert all(got[i] <= want[i] for i in want)
    hits, all_places = sum(len(got[i]) for i in want), sum(map(len, want.values()))
    verbatim = sum(len(t) > 0 for t in want.values())
    assert all_places > 80 and verbatim > 70 and hits >= 0.9 * all_places, (hits, all_places)


def test_a_licence_word_put_in_is_found_and_a_replaced_one_is_not(spark):
    mit = dict((t[0], t[1]) for t in licences.TEMPLATES)["mit"]
    between = mit.replace("to any person", "to really any person").replace("and associated", "and all the associated")
    inside = mit.replace("hereby granted", "hereby now granted")
    far = mit.replace("to any person", "x " * 40 + "to any person")
    rows = [(i, t, "en", "s") for i, t in enumerate([between, inside, far, mit.replace("granted", "denied"), (mit + " ") * 3])]
    got = {r["doc_id"]: r["matches"] for r in licences.scan(table(spark, rows)).collect()}
    assert [(m["label"], m["start"], m["score"]) for m in got[0]] == [("mit", 0, 1.0)] and got[0][0]["length"] == len(between.split())
    assert [(m["label"], m["start"]) for m in got[1]] == [("mit", 0)]
    assert got[2] == [] and got[3] == []
    n = len(mit.split())
    assert [m["start"] for m in got[4]] == [0, n, 2 * n]


def test_a_file_looks_up_its_own_rarest_words():
    doc = np.array([0, 0, 0, 0, 1, 1])
    words = np.array([0, 1, 2, 0, 0, 2])
    seen = licences.rarest(doc, words, np.array([9, 5, 1]), 2)
    assert seen.tolist() == [False, True, True, False, True, True]
    assert licences.rarest(doc, words, np.array([1, 5, 9]), 2).tolist() == [True, True, False, True, True, True]
    assert licences.rarest(doc[:0], words[:0], np.array([1, 5, 9])).tolist() == []
    # votes in blocks of any size are the same
    t = licences.Template("t", tuple(range(6)), ((0, 2),), False)
    places, found = np.array([3, 4, 5, 90, 91, 200, 201, 202, 203]), np.array([0, 1, 2, 0, 1, 2, 3, 4, 5])
    whole = licences.agreed(places, found, t).tolist()
    assert whole == [0, 1, 6, 7]
    block, licences.BLOCK = licences.BLOCK, 1
    try:
        assert licences.agreed(places, found, t).tolist() == whole
    finally:
        licences.BLOCK = block


# --- op8 ---------------------------------------------------------------------------


def brute_near(rows, words, percent):
    sets, parent = {}, {}
    for doc, text in rows:
        if doc is None:
            continue
        w = WORDS.findall(lower(text or ""))
        found = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(doc, []).append(found)
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for s, t in itertools.product(sets[a], sets[b]):
            if s and t and 100 * len(s & t) >= percent * len(s | t) and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, odd, empty, words):
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(odd, words).collect() if r["doc_id"] is not None}
    assert got == brute_near([(r[0], r[1]) for r in ODD], words, 80)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.deduplicate(empty).collect() == []


def test_near_duplicates_of_a_large_family(spark):
    """Copies near a base but mostly not near each other: stars alone would miss links."""
    rng = np.random.default_rng(5)
    rows, base = [], sentence(40, 150).split()
    for doc in range(90):
        words = list(base)
        for i in rng.choice(150, int(rng.integers(3, 22)), replace=False):
            words[i] = f"w{doc}x{i}"
        rows.append((int(1000 - doc), " ".join(words), "en", "s"))
    rows += [(i, sentence(500 + i, 100), "en", "s") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, rows), 2).collect()}
    assert got == brute_near([(r[0], r[1]) for r in rows], 2, 80)
    assert len(set(got.values())) > 21


def test_circulant_signature():
    s = np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)
    t = np.concatenate([s[:400], np.random.default_rng(3).integers(0, 2**63, 100).astype(np.uint64)])
    a, b = minhash.signature(s, 1000), minhash.signature(t, 1000)
    assert abs((a == b).mean() - 400 / 600) < 0.06
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash._scatter(x.copy(), 0x7FEB352D, 0x846CA68B))) == 1 << 16


def test_exact_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 5, 30, 50)]
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash.intersections(flat, sizes, flat, sizes).tolist() == want


def test_deduplicate_keeps_one_of_each(odd):
    out = minhash.deduplicate(odd, 2)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == odd.columns and sorted(i for i in ids if i is not None) == sorted(
        {d for d, c in brute_near([(r[0], r[1]) for r in ODD], 2, 80).items() if d == c}
    )
    assert ids.count(None) == 2


# --- op9 ---------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), list(names)
    while True:
        total = sum(w[n] for n in open_)
        over = [n for n in open_ if left * w[n] / total > most * sizes[n]]
        if not over:
            return target | {n: left * w[n] / total for n in open_}
        for n in over:
            target[n] = most * sizes[n]
        left -= sum(target[n] for n in over)
        open_ = [n for n in open_ if n not in over]


def test_mix(spark, odd, empty):
    rows = [(i, sentence(i, int(5 + (i * 37) % 200)), "en", "abcde"[i * i % 5] if i % 11 else None) for i in range(400)]
    docs = table(spark, rows)
    got = mixing.copies_of(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken_copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["taken_copies"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200
    assert sorted(got) == sorted(mixing.copies_of(docs.repartition(7)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken_copies"] for r in got)
    assert len(mixing.copies_of(odd).collect()) == len(ODD)
    assert mixing.copies_of(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c", "en", "s")] * 6 + [(None, None, "en", None), (2, "", "en", "t")]
    got = mixing.copies_of(table(spark, rows)).collect()
    assert len(got) == 8 and sum(r["size"] * r["taken_copies"] for r in got) <= 36


def test_mix_takes_what_copies_of_takes(spark):
    same, again = sentence(1, 14), sentence(2, 9)
    rows = [(7, same, "en", "s")] * 300 + [(i + 10, sentence(i, 6), "en", "s") for i in range(400)] + [(None, again, "en", "s")] * 50 + [(7, same, "en", "t")] * 40
    docs = table(spark, rows)
    for share in (0.35, 0.8, 1.1, 1.5):
        taken = {}
        for r in mixing.copies_of(docs, share=share).collect():
            taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["taken_copies"]
        mixed = {}
        for r in mixing.mix(docs, share=share).collect():
            mixed[r["source"]] = mixed.get(r["source"], 0) + len(r["text"].split())
        assert mixed == {s: n for s, n in taken.items() if n}


def test_slices_of_the_rank_are_even(spark, monkeypatch):
    """Odds bunch near 0 where most documents are taken; slices hold about the same number all the same."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 100)
    ranks = spark.range(4000).select(((mixing.uniform("s", F.col("id").cast("string")) / (1 - mixing.uniform("s", F.col("id").cast("string")))) / 999).alias("rank"))
    bounds = bounds_of(ranks, "rank", 40)
    counts = [r["count"] for r in with_bucket(ranks, "rank", bounds).groupBy("_bucket").count().collect()]
    assert len(counts) == 40 and max(counts) < 200


# --- op10 --------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, block string, entry int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], CHAT)


def test_transcripts(spark):
    rows = []
    for c in range(12):
        for t in range(150 if c == 0 else 6):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, sentence(c * 200 + t, 6) + "?" if role == "user" else "\n".join(sentence(c * 300 + t + j, 30) for j in range(3))))
    got = transcripts.parse(chats(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["role"] == r["given_role"] and not r["continues"] for r in got)


def test_blocks_give_the_best_path(spark):
    rng = np.random.default_rng(6)
    rows = [(0, t, str(rng.choice(transcripts.ROLES)), "\n".join(sentence(int(x), int(x) % 9 + 1) for x in rng.integers(0, 99, 2))) for t in range(200)]
    chat = chats(spark, rows)
    prepared = transcripts.rows_of(chat)
    transition, emission = transcripts.train(prepared)
    symbols = [s for r in prepared.orderBy("place").collect() for s in r["symbols"]]
    score, back = transition[transcripts.START] + emission[:, symbols[0]], []
    for s in symbols[1:]:
        way = score[:, None] + transition + emission[:, s]
        back.append(way.argmax(axis=0))
        score = way.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path = path[::-1]
    got = sorted(transcripts.parse(chat).collect(), key=lambda r: (r["turn"], r["part"]))
    at, value = 0, transition[transcripts.START, path[0]] + emission[path[0], symbols[0]]
    want = [transcripts.ROLES[s // 2] for s in path]
    have = [r["role"] for r in got for _ in range(r["n_lines"])]
    assert np.isfinite(value) and have == want and at == 0


def test_transcripts_with_markers(spark):
    rows = [(1, 0, None, "User: hello there\nmore\nAssistant: fine"), (None, None, None, None), (1, 1, "other", "Q: why?"), (1, 1, "other", "Q: why?"), (2, 0, "user", "")]
    got = transcripts.parse(chats(spark, rows)).collect()
    first = sorted((r["part"], r["role"], r["rendered"]) for r in got if r["conv_id"] == 1 and r["turn"] == 0)
    assert first == [(0, "user", "<|user|>\nhello there\nmore\n<|end|>\n"), (1, "assistant", "<|assistant|>\nfine\n<|end|>\n")]
    assert len(got) == 6
    assert transcripts.parse(chats(spark, [])).collect() == []


def test_rows_without_turn_are_cut_into_blocks(spark):
    """A third of all rows under one conversation without turn, many of them copies: blocks stay small, results as in one walk."""
    rng = random.Random(8)
    rows = [(7, None, rng.choice(["user", None]), f"User: {sentence(i % 50, 5)}?" if i % 3 else "same words here") for i in range(700)]
    rows += [(c, t, ("user", "assistant")[t % 2], sentence(c * 9 + t, 4) + ("?" if t % 2 == 0 else "")) for c in range(100, 300) for t in range(7)]
    rows += [(7, -1, "user", "early")] * 3
    df = chats(spark, rows)
    kept = transcripts.numbered(transcripts.rows_of(df))
    numbers = [(r["conv"], r["number"], r["place"]) for r in kept.orderBy("number").collect()]
    assert [n for _, n, _ in numbers] == list(range(len(rows)))
    assert all((a[0], a[2]) <= (b[0], b[2]) for a, b in zip(numbers, numbers[1:]))
    assert max(r["count"] for r in kept.groupBy("conv", "block").count().collect()) <= transcripts.BLOCK
    got = transcripts.parse(df).collect()
    whole = {(r["conv_id"], r["turn"], r["rendered"]) for r in got}
    block, transcripts.BLOCK = transcripts.BLOCK, 10_000
    try:
        again = transcripts.parse(df).collect()
    finally:
        transcripts.BLOCK = block
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(map(order, got)) == sorted(map(order, again)) and len(got) >= len(rows) and (7, -1, render_user("early")) in whole


def render_user(text):
    return transcripts.render("user", [text])


# --- shared ------------------------------------------------------------------------


def test_words_are_split_at_ascii_space_only():
    texts = ["a b c\td\x0b\x0ce\r\n", "", None, "  ", "x\x1cy"]
    words, counts = split_words(pa.array(["drop", *texts]).slice(1))
    assert words.to_pylist() == [w for t in texts for w in WORDS.findall(t or "")] and counts.tolist() == [4, 0, 0, 0, 1]


def test_repeated_turns_count_once_each(spark):
    """30,000 rows of one turn and as many of the next are 30,000 moves, not 900 million."""
    import pyspark.sql.functions as F

    n = 30_000
    twice = spark.range(2 * n).select(
        F.lit(1).cast("long").alias("conv_id"), (F.col("id") % 2).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words").alias("text"),
    )
    few = spark.createDataFrame([(2, t, r, "some words") for t, r in ((0, "user"), (1, "user"))], twice.schema)
    transition, _ = transcripts.train(transcripts.rows_of(twice.union(few)))
    # after a user's first line: 1 for each of 3 roles' turns and for going on, and n + 1 moves
    share = np.exp(transition[2])
    assert share[4] == pytest.approx((n + 1) / (n + 5)) and share[2] == pytest.approx(2 / (n + 5))
