"""Decontamination, the filter audit and hard negatives against brute-force versions, and on awkward tables."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tailspark.llm import decontamination, hardnegatives, interactions

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, n_chars long, found string, _found string, words long, part string, cells string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeé7"), rng.integers(1, 5))) for _ in range(n))


ITEMS = [
    (1, passage(1, 25)), (2, passage(2, 10)), (3, "Two words."), (4, None), (5, "  ?! "), (6, passage(1, 25)), (6, passage(3, 12)),
    (None, passage(4, 11)), (10, passage(2, 10).replace(" ", ", ")), (11, "日本語 ÉÉ"), (12, passage(9, 14) + " " + passage(1, 12)),
]
TEXTS = [
    (0, passage(5, 30)), (1, passage(5, 8) + ".\n" + passage(1, 25).upper().replace(" ", " -- ") + " " + passage(6, 5)), (1, None), (2, ""),
    (3, "x two; WORDS y two words"), (4, passage(2, 10) + passage(2, 10) + " " + passage(2, 9)), (None, passage(4, 11)), (None, None),
    (7, passage(1, 12)), (7, passage(1, 12)), (8, "日本語 ÉÉ 日本語 éé"), (9, passage(3, 9)), (10, passage(7, 3000) + " " + passage(3, 12)), (11, "?? ... !"),
    (12, passage(1, 25) + " " + passage(1, 25)),
]


def documents(spark, rows, sources="ab"):
    full = [(i, t, sources[k % len(sources)] if k % 5 else None, len(t or ""), "f", "g", 1, "p", "c") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, window string")


def hits(text, items, n=10):
    """(words, hit places, names of items) by comparing every window with every place."""
    words, places, names = TOKEN.findall(lower(text)), set(), set()
    for name, item in items:
        own = TOKEN.findall(lower(item))
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    places |= set(range(j, j + size))
                    names.add("" if name is None else str(name))
    return words, places, names


@pytest.mark.parametrize("set_rows", [1_000_000, 9])
def test_decontamination(spark, set_rows):
    found, out = decontamination.scan(documents(spark, TEXTS), benchmark(spark, ITEMS), set_rows=set_rows)
    rows = found.select("doc_id", "text", "n_chars", "found", "_found", f"{out}.*", decontamination.n_hit(out).alias("n_hit")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        words, places, names = hits(r["text"], ITEMS)
        assert r["n_words"] == len(words) and r["n_hit"] == len(places)
        assert sorted(r["items"]) == sorted(names)
        assert {i for s in r["spans"] for i in range(s["first"], s["last"] + 1)} == places
        for s in r["spans"]:
            cut = r["text"].encode()[s["start"] : s["end"]].decode()
            assert TOKEN.findall(lower(cut)) == words[s["first"] : s["last"] + 1] and TOKEN.match(lower(cut[0])) and TOKEN.match(lower(cut[-1]))


def test_decontamination_report_and_removal(spark):
    docs, items = documents(spark, TEXTS), benchmark(spark, ITEMS)
    for r in decontamination.report(docs, items).join(docs.select("doc_id", "text"), "doc_id").filter("doc_id not in (1, 7)").collect():
        _, places, names = hits(r["text"], ITEMS)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r["n_items"] == len(names) and r["contaminated"] == bool(places)
    cut = decontamination.decontaminate(docs, items)
    assert cut.columns == docs.columns
    left = {(r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()}
    assert (0, passage(5, 30), len(passage(5, 30))) in left and (3, "x ; y ", 6) not in left
    assert (3, "x  y ", 5) in {(i, t.replace(";", ""), n - t.count(";")) for i, t, n in left if i == 3}
    assert not hits("\n".join(t for i, t, _ in left if t and i in (1, 10)), ITEMS)[1]
    whole = {r["doc_id"] for r in decontamination.decontaminate(docs, items, whole=True).collect()}
    assert whole == {i for i, t in TEXTS if not hits(t, ITEMS)[1]}
    few = {r["doc_id"] for r in decontamination.decontaminate(docs, items, most=0.5).collect()}
    assert 7 not in few and 12 not in few and 10 in few


def test_decontamination_of_empty_tables(spark):
    docs, items = documents(spark, TEXTS), benchmark(spark, ITEMS)
    assert decontamination.report(docs.limit(0), items).count() == 0
    for none in (items.limit(0), benchmark(spark, [(1, None), (2, "?")])):
        rows = decontamination.report(docs, none).collect()
        assert len(rows) == len(TEXTS) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in rows)
        assert sorted(r["n_words"] for r in rows) == sorted(len(TOKEN.findall(lower(t))) for _, t in TEXTS)


def test_word_hashes_over_segments(monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT", 40)
    texts = [passage(1, 60), "z" * 500 + " a", "", passage(1, 60), "a"]
    words = decontamination.Words(pa.array(texts).slice(1))
    flat = [w for t in texts[1:] for w in TOKEN.findall(t)]
    of = {}
    for word, h in zip(flat, words.hashes().tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of)


def test_windows_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(decontamination, "_windows", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    known = decontamination.HashSet(pa.array(["a b", "b c", "c d"]), pa.array(["1", "2", "3"]))
    first, n, window = known.hits(decontamination.Words(pa.array(["a b x", "c d c", "b"])))
    assert sorted(zip(first.tolist(), window.tolist())) == [(0, 0), (3, 2)] and set(n.tolist()) == {2}


# --- filter audit ------------------------------------------------------------------


LONG = passage(20, 400)
AUDITED = [
    (0, LONG), (1, LONG), (1, LONG), (2, LONG + " x&y"), (3, "a a a b"), (4, None), (5, ""), (None, LONG), (None, "ABC"), (6, "ABC"), (7, "ABC"),
    (8, "w " * 300), (9, passage(21, 250).upper()), (10, "w " * 300), (3, "a a a b"), (12, passage(22, 2000)), (-3, "ABC"),
]
LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (7, 1, 1), (8, None, 1), (None, 1, 1), (6, 0, None), (99, 1, 1)]


def test_audit(spark):
    docs = documents(spark, AUDITED)
    labels = spark.createDataFrame([(*r, "k") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    plain = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    want = {}
    failing = []
    for i, text, part in plain:
        words = WORD.findall(text)
        failing.append((part, i, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and other == text for j, other, _ in plain),
        }))
    for part in {p for p, _, _ in failing}:
        own = [(i, f) for p, i, f in failing if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                shapley[x] += len(gone)
                fails = sum(f[x] for _, f in own)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in own)
                want[part, "".join(order), step + 1] = [
                    len(left), len(gone), fails - len(gone), unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), values in want.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in interactions.COUNTS] for r in interactions.audit(docs, labels).collect()}
    assert got == want
    assert len(got) == 3 * 600
    assert interactions.audit(docs.limit(0), labels).count() == 0
    bare = interactions.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(bare) == (0, 0, 1800)


def test_contractions_of_other_sizes(spark):
    counted = spark.createDataFrame([("p", True, False, True, False, 3), ("p", False, False, False, False, 2)], "part string, x boolean, y boolean, good boolean, toxic boolean, n long")
    rows = {(r["filter_order"], r["step"]): r for r in interactions.interactions(counted, ["x", "y"]).collect()}
    assert len(rows) == 4
    assert rows["yx", 1]["removed"] == 0 and rows["yx", 2]["removed"] == 3 and rows["xy", 1]["good_lost"] == 3 and rows["xy", 1]["shapley"] == 6
    with pytest.raises(ValueError):
        interactions.interactions(counted, list("abcdefgh"))


# --- hard negatives ----------------------------------------------------------------


def mined(rows, positives=5, negatives=10):
    """Brute force over distinct (vec_id, label, vector)."""
    rows = [(i, l, v) for i, l, v in {(i, l, tuple(v)) for i, l, v in rows}]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    def first(found, k):
        return sorted(set(found), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    out = []
    for i, label, v in rows:
        if i is None or i % 100:
            continue
        for ps, p in first([(dot(v, w), j) for j, other, w in rows if other == label and j != i], positives):
            fits = [(dot(v, w), j) for j, other, w in rows if other != label]
            fits = [(s, j) for s, j in fits if 30 * ps <= 100 * s <= 90 * ps]
            out += [(i, p, rank, n, ps, s) for rank, (s, n) in enumerate(first(fits, negatives), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8192, 2])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(hardnegatives, "LEAF", 4)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(3)), [int(x) for x in rng.integers(-3, 6, 4)]) for i in range(400)]
    rows += [(500 + i, i % 3, [2, 2, 2, 2]) for i in range(60)]  # one common vector
    rows += [(700, 1, [1, 2]), (701, 1, [3, 3, 3]), (800, 2, []), (200, 9, [5, 5, 5, 5]), (None, 0, [4, 4, 4, 4]), (None, 2, [5, 1, 1, 1])]
    rows += rows[:50] + [rows[100]] * 20
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label long, vector array<long>, anchor int")
    found = hardnegatives.mine(table, F.col("vec_id") % 100 == 0, block=block)
    assert found.columns == list(hardnegatives.OUT)
    assert sorted((tuple(r) for r in found.collect()), key=str) == mined(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.251]), (2, 2, [0.2, 0.2]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, 2, [None, 1.0]), (6, None, [0.3, 0.3]), (7, 2, None)]
    schema = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame([(i, v, l) for i, l, v in rows], schema)
    ready = hardnegatives.quantised(table)
    assert {r["vec_id"]: r["vector"] for r in ready.collect()} == {0: [128, 64], 1: [128, 64], 2: [51, 51]}
    out = hardnegatives.mine(ready, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in out] == [(0, 1, 1, 2, 128 * 128 + 64 * 64, 51 * 192)]
    assert hardnegatives.mine(ready.limit(0), F.col("vec_id") == 0).count() == 0
    assert hardnegatives.mine(ready, F.col("vec_id") == 12).count() == 0
    with pytest.raises(ValueError):
        hardnegatives.mine(spark.createDataFrame([(0, 1, [2**40])], "vec_id long, label long, vector array<long>"), F.col("vec_id") == 0)


def test_trees_bound_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (16, 6))
    vectors = np.floor(np.concatenate([rng.normal(c, 4, (128, 6)) for c in centres]))
    ids, labels = rng.permutation(len(vectors)), rng.integers(0, 2, len(vectors))
    tree = hardnegatives.PackedTree(ids, labels, vectors, 16, 4)
    assert sorted(tree.ids) == sorted(ids) and len(tree.levels[-1][0]) == 1
    opened = []
    for at in range(0, 2048, 97):
        vector, scores = vectors[at], vectors @ vectors[at]
        goals = hardnegatives.Goals(np.array([-np.inf]), np.array([np.inf]), 5)
        opened.append(hardnegatives.search(tree, ids[at], labels[at], vector, goals, True))
        fits = (labels == labels[at]) & (ids != ids[at])
        want = sorted(zip(-scores[fits], ids[fits]))[:5]
        assert list(zip(-goals.scores[0], goals.ids[0])) == want
        top = scores.max()
        goals = hardnegatives.Goals(np.array([0.3 * top, 0.7 * top]), np.array([0.5 * top, 0.9 * top]), 5)
        hardnegatives.search(tree, ids[at], labels[at], vector, goals, False)
        for g in range(2):
            fits = (labels != labels[at]) & (scores >= goals.low[g]) & (scores <= goals.high[g])
            assert list(zip(-goals.scores[g], goals.ids[g])) == sorted(zip(-scores[fits], ids[fits]))[:5]
    assert max(opened) < 128 and np.mean(opened) < 40  # of 128 leaves
