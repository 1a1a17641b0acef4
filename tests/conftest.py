import datetime as dt
import math

import pytest

from tailspark import Settings, build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    """Short windows for 42 weeks of data."""
    return Settings(
        trailing_window=6, turnover_window=6, beta_window=6, min_observations=3, horizon=6,
        features=Settings().features,
    )


FRIDAYS = [dt.date(2020, 1, 3) + dt.timedelta(weeks=i) for i in range(42)]


def benchmark_return(i):
    return 0.0 if i == 0 else 0.012 * math.sin(i / 1.7)


def own_return(ticker, i):
    if ticker == "AAA":
        return 0.9 * benchmark_return(i) + 0.014 * math.sin(0.7 * i)
    if ticker == "BBB":
        return 1.1 * benchmark_return(i) - 0.011 * math.cos(0.5 * i)
    return 0.8 * benchmark_return(i) + (-0.065 if i % 9 == 0 else 0.010 * math.cos(0.4 * i))


@pytest.fixture(scope="session")
def raw_rows():
    level, bench = 100.0, []
    for i, day in enumerate(FRIDAYS):
        level *= 1 + benchmark_return(i)
        bench.append((day.isoformat(), level))
    prices = []
    for ticker, start in (("AAA", 50.0), ("BBB", 75.0), ("CCC", 90.0)):
        price = start
        for i, day in enumerate(FRIDAYS):
            price *= 1 + (0 if i == 0 else own_return(ticker, i))
            prices.append((ticker, day.isoformat(), price, 1e6 + 1e4 * i + 300))
    fundamentals = [
        (t, day, cap * f, 1e8, 2.0, 0.3, 0.05)
        for t, cap in (("AAA", 10e9), ("BBB", 15e9), ("CCC", 8e9))
        for day, f in (("2019-09-30", 1.0), ("2020-06-30", 1.05))
    ]
    controversies = [
        (t, FRIDAYS[i].isoformat(), "Energy" if t == "CCC" else "Tech", i // 4 + (4.0 if t == "CCC" else 1.0))
        for t in ("AAA", "BBB", "CCC")
        for i in range(0, 42, 4)
    ]
    return {
        "prices": (prices, "ticker string, date string, adj_close double, volume double"),
        "benchmark_prices": (bench, "date string, benchmark_close double"),
        "fundamentals": (
            fundamentals,
            "ticker string, period_end string, market_cap double, shares_outstanding double, "
            "market_to_book double, leverage double, roa double",
        ),
        "controversies": (
            controversies,
            "ticker string, date string, sector string, controversy_score double",
        ),
    }


@pytest.fixture(scope="session")
def raw(spark, raw_rows):
    return {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in raw_rows.items()}


@pytest.fixture(scope="session")
def csv_folder(raw, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, df in raw.items():
        df.toPandas().to_csv(folder / f"{name}.csv", index=False)
    return str(folder)
