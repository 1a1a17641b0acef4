"""CSV records with quoted line breaks, cut at any byte."""

import random

import pytest
from pyspark.sql import functions as F

from tailspark.sources import loaders, records


@pytest.fixture
def splits(spark):
    """Sets the size of the blocks a file is read in."""

    def set_size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, text):
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(text)
    return str(path)


def rows(df):
    return sorted(tuple(None if v is None else v.replace("\r\n", "\n") for v in r) for r in df.collect())


def one_task(spark, path):
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path)


def random_cell(rng):
    if rng.random() < 0.25:
        return rng.choice(["a", "bb", "x y", "", '5" disk', 'na"ive'])
    marks = ["a", "b", ",", "\n", '""', "\r\n", "\n\n", " ", "é"]
    return '"' + "".join(rng.choice(marks) for _ in range(rng.randrange(9))) + '"'


@pytest.mark.parametrize("end, last, seed", [("\n", "", 1), ("\r\n", "\r\n", 2)])
def test_equal_to_the_one_task_reader(spark, splits, tmp_path, end, last, seed):
    rng = random.Random(seed)
    lines = ['id,"he ad",b,c']
    for i in range(120):
        lines.append(f"{i}," + ",".join(random_cell(rng) for _ in range(3)))
        lines += [""] * (rng.random() < 0.05)
    path = written(tmp_path / "news.csv", end.join(lines) + last)
    want = rows(one_task(spark, path))
    assert len(want) == 120
    for size in (61, 1 << 27):
        splits(size)
        got = records.read_csv(spark, path)
        assert got.columns == ["id", "he ad", "b", "c"]
        assert rows(got) == want
    splits(61)
    assert spark.read.text(path).select("_metadata.file_block_start").distinct().count() > 30


def test_one_record_over_many_blocks_and_files_with_their_own_headers(spark, splits, tmp_path):
    folder = tmp_path / "news_text.csv"
    folder.mkdir()
    story = "line, \"\"said\"\"\n\n" * 200
    written(folder / "a.csv", f'ticker,date,body\n\nAAA,2020-01-03,"{story}"\nBBB,2020-01-03,short\n')
    written(folder / "b.csv", 'ticker,date,body\nCCC,2020-01-03,"end\nopen')
    written(folder / "c.csv", "ticker,date,body\n")
    splits(37)
    got = {r.ticker: r.body for r in records.read_csv(spark, str(folder)).collect()}
    assert got.keys() == {"AAA", "BBB", "CCC"}
    assert got["AAA"] == story.replace('""', '"') and got["BBB"] == "short"
    assert got["CCC"].strip('"') == "end\nopen"
    loaded = loaders.load_text(spark, str(folder))
    assert loaded.status == "ok" and loaded.texts.count() == 3


def test_file_of_a_header_only(spark, tmp_path):
    path = written(tmp_path / "empty.csv", "ticker,`od`d,body")
    got = records.read_csv(spark, path)
    assert got.columns == ["ticker", "`od`d", "body"] and got.isEmpty()


def test_no_step_runs_in_one_task(spark, tmp_path):
    path = written(tmp_path / "news.csv", "a,b\n1,2\n")
    plan = records.read_csv(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_steps_of_a_line(spark):
    lines = ["plain, text", '"a', 'a"b', 'x,"y', '"a""', '"a"""', '",', '","', '"a"b"', 'a,"", "b', "", '""', '"""']
    got = spark.createDataFrame([(line,) for line in lines], "line string").select(
        "line", *[records._ends_inside(F.col("line"), s).alias(n) for n, s in (("out", 0), ("ins", 1))]
    )
    for line, row in zip(lines, got.collect()):
        assert row.out == walk(line, False), line
        assert row.ins == walk(line, True), line


def walk(line, inside):
    """The same by one character at a time."""
    start, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside and c == '"':
            if line[i + 1 : i + 2] == '"':
                i += 1
            else:
                inside, start = False, False
        elif not inside:
            if c == '"' and start:
                inside = True
            start = c == ","
        i += 1
    return inside
