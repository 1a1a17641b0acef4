import datetime as dt

import pytest
from pyspark.sql import functions as F

from tailspark import SchemaError
from tailspark.sources import loaders, sinks


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_csv_prices_are_cleaned(spark, tmp_path):
    path = write(tmp_path, "prices.csv", " Ticker ,DATE,adj_close,volume\n aaa ,2020-01-03,10.5,100\nbbb,2020-01-10,x,5\n,2020-01-10,3,5\nccc,2020-01-10,7,\nddd,NA,7,1\n")
    df = loaders.load_prices(spark, path)
    assert rows(df, "ticker", "date", "adj_close", "volume") == [
        ("AAA", dt.date(2020, 1, 3), 10.5, 100.0),
        ("CCC", dt.date(2020, 1, 10), 7.0, None),
    ]


def test_day_first_by_vote(spark):
    df = spark.createDataFrame(
        [("a", d, "1", "1") for d in ("02-01-2020", "13-01-2020", "24-01-2020")],
        "ticker string, date string, adj_close string, volume string",
    )
    assert rows(loaders.load_prices(spark, df), "date") == [(dt.date(2020, 1, d),) for d in (2, 13, 24)]


@pytest.mark.parametrize(
    "cells, expected",
    [
        (["01/02/2020", "01/13/2020"], [dt.date(2020, 1, 2), dt.date(2020, 1, 13)]),
        (["1-1-2020", "2-2-2020"], [dt.date(2020, 1, 1), dt.date(2020, 2, 2)]),
        (["2020-01-02 00:00:00", "2020-1-3"], [dt.date(2020, 1, 2), dt.date(2020, 1, 3)]),
        (["2020-01-02"] * 9 + ["13/01/2020"], [dt.date(2020, 1, 2)] * 9 + [None]),
        (["13-13-2020", "14-01-2020"], [None, dt.date(2020, 1, 14)]),
    ],
)
def test_one_format_per_column(spark, cells, expected):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, d string")
    got = df.select("i", loaders.parsed_date(df, "d").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == expected


def test_availability_lag(spark):
    df = spark.createDataFrame(
        [("a", "2020-12-31", "1", "2", "3", "4", "5")],
        "ticker string, period_end string, market_cap string, shares_outstanding string, market_to_book string, leverage string, roa string",
    )
    assert loaders.load_fundamentals(spark, df).first().available_date == dt.date(2021, 2, 14)


def test_infinite_and_nan_cells_are_null(spark):
    df = spark.createDataFrame([("NaN",), ("Infinity",), ("-inf",), ("2",)], "x string")
    assert sorted([r.y for r in df.select(loaders.number("x").alias("y")).collect()], key=str) == [2.0, None, None, None]


def test_schema_errors(spark, tmp_path):
    with pytest.raises(SchemaError, match="volume"):
        loaders.load_prices(spark, write(tmp_path, "p.csv", "ticker,date,adj_close\na,2020-01-01,1\n"))
    with pytest.raises(SchemaError, match="empty"):
        loaders.load_prices(spark, write(tmp_path, "q.csv", "ticker,date,adj_close,volume\n"))
    with pytest.raises(ValueError, match="extension"):
        loaders.read_table(spark, str(tmp_path / "x.docx"))
    with pytest.raises(FileNotFoundError):
        loaders.read_table(spark, str(tmp_path / "none.csv"))


def test_discovery(spark, csv_folder, tmp_path):
    found = loaders.discover_sources(spark, csv_folder)
    assert found["prices"].endswith("prices.csv")
    with pytest.raises(FileNotFoundError, match="prices"):
        loaders.discover_sources(spark, str(tmp_path))
    assert loaders.discover_text(spark, csv_folder) is None
    write(tmp_path, "news_text.csv", "ticker,date,text\na,2020-01-01,b\n")
    assert loaders.discover_text(spark, str(tmp_path)).endswith("news_text.csv")


def test_text_aliases_and_states(spark):
    raw = spark.createDataFrame(
        [("aaa", "2020-02-07", "Wire", "Fraud probe"), ("bbb", "2020-02-07", "Wire", " ")],
        "Symbol string, `Published Date` string, Provider string, Story string",
    )
    text = loaders.load_text(spark, raw)
    assert text.status == "ok"
    assert rows(text.texts, "ticker", "text", "source") == [("AAA", "Fraud probe", "Wire")]
    assert loaders.load_text(spark, None).status == "no_text_file"
    assert loaders.load_text(spark, raw.select("Symbol")).status == "invalid_text_file"
    assert loaders.load_text(spark, raw.where("Symbol = 'bbb'")).status == "empty_text_file"
    assert loaders.load_text(spark, None).status_row(spark).first().status == "no_text_file"


def test_wide_history_and_ratio(spark):
    wide = spark.createDataFrame(
        [("2020-01-01", 1.0, 2.0, 10.0, 5.0, 7.0)],
        "Date string, `A_Close` double, `A_Adj Close` double, A_Volume double, B_Close double, C_Volume double",
    )
    long = loaders.symbol_history_to_long(wide, ["A", "B", "C"], {"A": "AX"})
    assert rows(long, "ticker", "adj_close", "volume") == [("AX", 2.0, 10.0)]
    cells = spark.createDataFrame([("50",), ("-20",), ("10",), ("x",)], "v string")
    got = [r.r for r in cells.select(loaders.plain_ratio(F.col("v")).alias("r")).collect()]
    assert got == [0.5, -0.2, 10.0, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("A", dt.date(2020, 1, 3), float("inf")), ("B", dt.date(2021, 1, 1), 2.0)],
        "ticker string, date date, x double",
    )
    sinks.write_parquet_by_year(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").glob("year=*")) == ["year=2020", "year=2021"]
    sinks.write_json_records(df, str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j")).fillna(-1.0), "ticker", "x") == [("A", -1.0), ("B", 2.0)]
    line = spark.createDataFrame([(1e9, 0.25, None, True, 3)], "a double, b double, c double, d boolean, e int")
    assert {r.metric: r.value for r in sinks.to_metric_rows(line).collect()} == {
        "a": "1000000000.0", "b": "0.25", "c": "None", "d": "True", "e": "3",
    }


@pytest.mark.parametrize(
    "cells, want",
    [
        (["20200103", "20200215", "x"], ["2020-01-03", "2020-02-15", None]),
        (["3 Jan 2020", "15 feb 2020", "2020-01-01"], ["2020-01-03", "2020-02-15", None]),
        (["2020-1-3 10:30:00", "2020/02/15", "1/2/2020"] * 3 + ["2020-02-15"] * 9, ["2020-01-03", "2020-02-15", None]),
        (["1/2/2020", "2/15/2020"], ["2020-01-02", "2020-02-15"]),
    ],
)
def test_date_layouts(spark, cells, want):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, d string")
    got = [r.d for r in df.select("i", loaders.parsed_date(df, "d").alias("d")).orderBy("i").collect()]
    assert [None if d is None else d.isoformat() for d in got[: len(want)]] == want


def test_fixed_day_first(spark):
    df = spark.createDataFrame([("1-2-2020",), ("1/3/2020",)], "d string")
    got = [r.d.isoformat() for r in df.select(loaders.parsed_date(df, "d", day_first=True).alias("d")).collect()]
    assert sorted(got) == ["2020-02-01", "2020-03-01"]


def test_spellings_are_taken_in_the_order_of_the_list(spark):
    df = spark.createDataFrame([("a", "b", "c")], "Full_Text string, `News Text` string, summary string")
    assert loaders.harmonise_text_columns(df).columns == ["text", "News Text", "summary"]


def test_a_repeated_date_is_taken_apart_once(spark):
    df = spark.createDataFrame([("13-01-2020",)] * 3 + [("2020-01-05 00:00:00",), (None,), ("x",)], "date string")
    looks = loaders.date_looks(df, "date")
    assert {r.look: r.n for r in looks.collect()} == {"day first": 3, "year first": 1, "other": 2}
    steps = [line for line in looks._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line]
    assert len(steps) == 2 and "Aggregate [date#" in steps[1]
