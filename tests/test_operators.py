import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailspark.functions import stats
from tailspark.operators import asof, calendar, ranking, resample, selection
from tailspark.plans import features
from tailspark.staging import stage

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def ncskew(values):
    r = np.array([v for v in values if v is not None and math.isfinite(v)])
    n = len(r)
    if n < 3 or (r**2).sum() <= 0:
        return None
    return -(n * (n - 1) ** 1.5 * (r**3).sum()) / ((n - 1) * (n - 2) * (r**2).sum() ** 1.5)


def duvol(values):
    r = np.array([v for v in values if v is not None])
    if len(r) < 4:
        return None
    down, up = r[r < r.mean()], r[r >= r.mean()]
    if len(down) <= 1 or len(up) <= 1 or (down**2).sum() <= 0 or (up**2).sum() <= 0:
        return None
    return math.log(((len(up) - 1) * (down**2).sum()) / ((len(down) - 1) * (up**2).sum()))


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_weekly_resample(spark):
    prices = spark.createDataFrame(
        [
            ("A", dt.date(2020, 1, 2), 90.0, 10.0),
            ("A", dt.date(2020, 1, 3), 100.0, 20.0),
            ("A", dt.date(2020, 1, 10), 110.0, 30.0),
            ("B", dt.date(2020, 1, 4), 5.0, None),  # a Saturday belongs to the next Friday
            ("B", dt.date(2020, 1, 6), None, 7.0),
            ("B", dt.date(2020, 1, 24), 0.0, 1.0),  # two weeks without rows are stepped over
            ("B", dt.date(2020, 1, 31), 4.0, 1.0),
            ("C", dt.date(2020, 1, 3), None, 1.0),
        ],
        "ticker string, date date, adj_close double, volume double",
    )
    got = [tuple(r) for r in resample.weekly_returns(prices).orderBy("ticker", "date").collect()]
    assert got[0] == ("A", dt.date(2020, 1, 3), 100.0, 30.0, None)
    assert got[1][:4] == ("A", dt.date(2020, 1, 10), 110.0, 30.0) and math.isclose(got[1][4], 0.10)
    assert got[2:] == [
        ("B", dt.date(2020, 1, 10), 5.0, 7.0, None),
        ("B", dt.date(2020, 1, 24), 0.0, 1.0, -1.0),
        ("B", dt.date(2020, 1, 31), 4.0, 1.0, None),  # no change from zero
    ]


def test_two_rows_on_one_day_take_the_higher_price(spark):
    prices = spark.createDataFrame(
        [("A", day(1), 3.0, 1.0), ("A", day(1), 4.0, 1.0)], "ticker string, date date, adj_close double, volume double"
    )
    assert resample.weekly_prices(prices).first().adj_close == 4.0


def test_monthly_keeps_empty_months(spark):
    prices = spark.createDataFrame(
        [("A", dt.date(2020, 1, 5), 1.0), ("A", dt.date(2020, 1, 30), 2.0), ("A", dt.date(2020, 4, 1), 3.0)],
        "ticker string, date date, adj_close double",
    )
    got = [(r.date.isoformat(), r.adj_close) for r in resample.monthly_prices(prices).orderBy("date").collect()]
    assert got == [("2020-01-31", 2.0), ("2020-02-29", None), ("2020-03-31", None), ("2020-04-30", 3.0)]


def test_asof_sees_nothing_from_the_future(spark):
    weeks = spark.createDataFrame([("A", dt.date(2020, 1, d)) for d in (3, 10, 17, 24)], "ticker string, date date")
    scores = spark.createDataFrame(
        [("A", dt.date(2020, 1, 1), 5.0), ("A", dt.date(2020, 1, 20), 99.0)], "ticker string, date date, score double"
    )
    for snap in (None, resample.week_end):
        got = asof.asof_join(weeks, scores, "ticker", "date", "date", ["score"], snap).orderBy("date").collect()
        assert [r.score for r in got] == [5.0, 5.0, 5.0, 99.0]


def test_asof_carries_the_newest_row_with_its_nulls(spark):
    weeks = spark.createDataFrame([("A", day(9)), ("B", day(9))], "ticker string, date date")
    right = spark.createDataFrame(
        [("A", day(1), 5.0, "x"), ("A", day(9), None, "y"), ("A", day(4), 7.0, "z"), ("A", day(4), 8.0, "w")],
        "ticker string, known date, score double, tag string",
    )
    got = {r.ticker: (r.score, r.tag) for r in asof.asof_join(weeks, right, "ticker", "date", "known", ["score", "tag"]).collect()}
    assert got == {"A": (None, "y"), "B": (None, None)}
    tied = asof.asof_join(weeks, right.where("tag in ('z', 'w')"), "ticker", "date", "known", ["score", "tag"])
    assert {r.ticker: r.tag for r in tied.collect()}["A"] == "w"


@FEW
@given(
    left=st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 40)), min_size=1, max_size=25, unique=True),
    right=st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 40)), max_size=25, unique=True),
)
def test_asof_equals_brute_force(spark, left, right):
    ldf = spark.createDataFrame([(t, day(n)) for t, n in left], "ticker string, date date")
    rdf = spark.createDataFrame([(t, day(n), float(n)) for t, n in right], "ticker string, known date, v double")
    got = {(r.ticker, r.date): r.v for r in asof.asof_join(ldf, rdf, "ticker", "date", "known", ["v"]).collect()}
    for t, n in left:
        known = sorted(k for rt, k in right if rt == t and k <= n)
        assert got[(t, day(n))] == (float(known[-1]) if known else None)


@pytest.fixture(scope="module")
def hot_sides(spark):
    """Nine rows in ten have one key; some dates repeat; some rows lack the key or the date."""
    rows = [("HOT" if i % 10 else f"K{i % 70}", day(i * 7 % 900), i) for i in range(3000)]
    rows += [("HOT", day(5), 9000 + i) for i in range(500)] + [(None, day(3), -1), ("HOT", None, -2), ("NONE", day(3), -3)]
    left = spark.createDataFrame(rows, "ticker string, date date, n long")
    right = spark.createDataFrame(
        [("HOT" if i % 3 else f"K{i % 70}", day(i * 11 % 950), float(i) if i % 4 else None, i) for i in range(400)]
        + [(None, day(1), 1.0, 1), ("HOT", None, 1.0, 1)],
        "ticker string, known date, v double, tag long",
    )
    other = spark.createDataFrame([("HOT", day(300), "x"), ("K0", day(10), "y")], "ticker string, known date, word string")
    return left, [asof.AsofSide(right, "known", ("known", "v", "tag")), asof.AsofSide(other, "known", ("word",), resample.week_end)]


def test_asof_by_ranges_equals_the_window(hot_sides):
    left, sides = hot_sides
    by_window = asof.asof_attach(left, sides, "ticker", "date")
    by_ranges = asof.asof_attach_ranges(left, sides, "ticker", "date")
    assert by_ranges.columns == by_window.columns
    assert sorted(by_ranges.collect(), key=str) == sorted(by_window.collect(), key=str)
    assert sorted(asof.asof_attach_ranges(left.limit(0), sides, "ticker", "date").collect()) == []
    empty = [asof.AsofSide(s.table.limit(0), s.on, s.columns, s.snap) for s in sides]
    assert asof.asof_attach_ranges(left, empty, "ticker", "date").where("tag is not null or word is not null").count() == 0


def test_asof_ranges_split_a_hot_key(spark, hot_sides, monkeypatch):
    left, sides = hot_sides
    seen = []
    monkeypatch.setattr(asof, "stage", lambda df, label: seen.append(stage(df, label)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        asof.asof_attach_ranges(left, sides, "ticker", "date").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = sorted(r["count"] for r in seen[0].groupBy("_range").count().collect())
    assert len(sizes) >= 3 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


SKEWED = [-0.20, -0.08, 0.03, 0.04, 0.05]


def test_crash_metrics_by_formula(spark):
    df = spark.createDataFrame([(v,) for v in SKEWED] + [(None,)], "r double")
    r = F.col("r")
    one = df.agg(*stats.skew_parts(r, "a"), *stats.duvol_parts(r, "a")).withColumns(stats.duvol_split("a")).withColumns(stats.duvol_sides("a"))
    row = one.select(stats.ncskew_from("a").alias("n"), stats.duvol_from("a").alias("d")).first()
    assert close(row.n, ncskew(SKEWED)) and close(row.d, duvol(SKEWED))


@FEW
@given(st.lists(st.one_of(st.none(), st.floats(-0.5, 0.5).map(lambda x: round(x, 3))), min_size=1, max_size=30))
def test_rolling_metrics_equal_python(spark, values):
    df = spark.createDataFrame([("A", day(7 * i), v) for i, v in enumerate(values)], "ticker string, date date, firm_specific_return double")
    got = features.with_forward_metrics(df, 5).orderBy("date").collect()
    for i, row in enumerate(got):
        ahead = values[i + 1 : i + 6]
        assert close(row.future_ncskew, ncskew(ahead))
        assert close(row.future_duvol, duvol(ahead))


def test_ncskew_changes_sign_with_the_returns(spark):
    df = spark.createDataFrame([(v, -v) for v in SKEWED], "r double, s double")
    row = df.agg(*stats.skew_parts(F.col("r"), "r"), *stats.skew_parts(F.col("s"), "s")).select(
        stats.ncskew_from("r").alias("r"), stats.ncskew_from("s").alias("s")
    ).first()
    assert math.isclose(row.r, -row.s)


def test_beta(spark):
    market = [0.01, -0.02, -0.03, 0.02, -0.01, 0.03]
    df = spark.createDataFrame([(2 * m, m) for m in market] + [(None, 0.5), (0.5, None)], "s double, m double")
    s, m = F.col("s"), F.col("m")
    parts = df.agg(*stats.beta_parts(s, m, "b"), *stats.beta_parts(s, F.when(m < 0, m), "d"))
    row = parts.select(stats.beta_from("b").alias("b"), stats.beta_from("d").alias("d")).first()
    assert close(row.b, 2.0) and close(row.d, 2.0)
    flat = spark.createDataFrame([(0.1, 0.2)] * 5, "s double, m double").agg(*stats.beta_parts(s, m, "b"))
    assert flat.select(stats.beta_from("b").alias("b")).first().b is None


def test_percentile_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None), (4, 3.0)], "i int, v double").withColumn("g", F.lit("x"))
    got = {r.i: r.p for r in ranking.attach_percentile(df, ["g"], "v", "p").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None, 4: 1.0}


@FEW
@given(rows=st.lists(st.tuples(st.sampled_from("aaab"), st.integers(0, 6)), min_size=1, max_size=60))
def test_ranks_equal_pandas(spark, rows):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).assign(i=range(len(rows)))
    df = spark.createDataFrame(pdf.assign(v=pdf.v.astype(float)))
    got = ranking.attach_percentile(df, ["g"], "v", "p").toPandas().set_index("i").sort_index()
    want = pdf.groupby("g").v.rank(pct=True)
    assert np.allclose(got.p.to_numpy(), want.to_numpy())
    placed = ranking.with_position(df, ["g"], [F.col("v").desc(), F.col("i").asc()]).toPandas().set_index("i").sort_index()
    assert (placed.position.to_numpy() == pdf.groupby("g").v.rank(method="first", ascending=False).to_numpy()).all()
    quantiles = {r.g: r.q for r in ranking.group_quantile(df, ["g"], "v", 0.8, "q").collect()}
    for g, values in pdf.groupby("g").v:
        assert math.isclose(quantiles[g], np.quantile(values, 0.8))


def test_one_hot_group_is_spread_over_slices(spark):
    """A group that holds nearly all rows is ranked in several slices, not in one task."""
    df = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 40_000).alias("v"))
    seen = {}
    original = ranking.stage

    def spy(frame, label, *a):
        seen["slices"] = original(frame, label, *a)
        return seen["slices"]

    ranking.stage = spy
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranking.with_position(df, ["g"], [F.col("v").asc()])
        assert placed.where(F.col("position") != F.col("v") + 1).count() == 0
        sizes = [r["count"] for r in seen["slices"].groupBy("_slice").count().collect()]
    finally:
        ranking.stage = original
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 30_000


def test_risk_buckets(spark):
    rows = [("t%d" % i, day(0), p) for i, p in enumerate([0.1, 0.8, 0.4, 0.2, 0.7])]
    got = {r.ticker: r.risk_bucket for r in ranking.with_risk_bucket(spark.createDataFrame(rows, "ticker string, date date, crash_probability double")).collect()}
    assert got["t1"] == "High" and sorted(got.values()) == ["High", "Low", "Low", "Medium", "Medium"]


@FEW
@given(st.lists(st.floats(0, 1).map(lambda x: round(x, 1)), min_size=1, max_size=40))
def test_bucket_sizes_follow_the_ceilings(spark, ps):
    rows = [("t%03d" % i, day(0), p) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "ticker string, date date, crash_probability double")
    got = [r.risk_bucket for r in ranking.with_risk_bucket(df).collect()]
    high = max(1, math.ceil(len(ps) * 0.2))
    medium = min(math.ceil(len(ps) * 0.4), len(ps) - high)
    assert got.count("High") == high and got.count("Medium") == medium


def test_split_cuts(spark):
    df = spark.createDataFrame([(day(i),) for i in range(10) for _ in range(2)], "date date")
    got = {r.split: r["count"] for r in calendar.chronological_split(df).groupBy("split").count().collect()}
    assert got == {"train": 12, "validation": 4, "test": 4}
    two = df.where(F.col("date") < day(2).isoformat())
    with pytest.raises(ValueError, match="3 unique dates"):
        calendar.chronological_split(two)
    assert {r.split for r in calendar.chronological_split(two, strict=False).collect()} == {"test"}
    with pytest.raises(ValueError):
        calendar.split_cuts(df, 0.7, 0.3)


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=80))
def test_exact_medians(spark, values):
    df = spark.createDataFrame([(v, 1.0, None) for v in values], "a double, b double, c double")
    for error in (0.2, 0.02):
        got = selection.exact_medians(df, ["a", "b", "c"], error)
        known = [v for v in values if v is not None]
        assert close(got["a"], float(np.median(known)) if known else None)
        assert got["b"] == 1.0 and got["c"] is None


def test_medians_of_many_rows_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.range(20_000).select(
        (F.col("id") * 7919 % 20_000).cast("double").alias("spread"), F.when(F.col("id") < 12_000, 3.0).otherwise(F.col("id") * 1.0).alias("tied"),
        F.when(F.col("id") % 3 == 0, nan).otherwise(F.col("id") * 1.0).alias("holes"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"),
        F.when(F.col("id") < 15_000, inf).otherwise(-inf).alias("far"), (F.col("id") % 2).cast("double").alias("halves"),
    )
    got = selection.exact_medians(df, df.columns)
    holes = [float(i) for i in range(20_000) if i % 3]
    assert got == {"spread": 9999.5, "tied": 3.0, "holes": float(np.median(holes)), "zero": 0.0, "far": inf, "halves": 0.5}
    assert selection.exact_medians(df.limit(0), ["spread"]) == {"spread": None}
