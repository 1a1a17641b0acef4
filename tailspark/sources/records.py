"""CSV whose quoted cells hold line breaks, read by many tasks a file.

Whether a line starts a record depends on all text before it, so a reader of such a file usually walks it alone.
But a line can do only four things to the state of that walk: keep it, turn it over, end outside quotes or end
inside them. Such steps compose, so every block of a file is summed up in one row; a running composition over the
blocks of a file gives the state in which each of them starts, and the state of every line follows inside its block.
Text is shuffled by block only; records that cross the end of a block move again. The plan holds that exchange for whole
and for cut records alike, so it is paid twice unless adaptive execution reuses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT, IN, CLOSED = 0, 1, 2
BLOCK = ("file", "block")


def _ends_inside(line: Column, start: int) -> Column:
    """Whether a walk over the line that starts outside or inside quotes ends inside.

    A quote opens a cell only at its start. Inside, two together are a character and a single one closes. Any
    other quote is a plain character.
    """
    pieces = F.split(line, '"', -1)
    marks = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda piece, i: F.struct(piece.alias("before"), (i == 0).alias("first")),
    )

    def step(state: Column, mark: Column) -> Column:
        empty = mark["before"] == ""
        opens = mark["before"].endswith(",") | (mark["first"] & empty) | ((state == CLOSED) & empty)
        return F.when(state == IN, CLOSED).when(opens, IN).otherwise(OUT)

    return F.aggregate(marks, F.lit(start), step) == IN


def _with_start(df: DataFrame, window: Window, first: Column) -> DataFrame:
    """Add `inside`, the state in which a row starts: `first` and the steps of all rows before it.

    That is the end of the last step that fixes the state, turned over by every turning step after it.
    """
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = (F.col("from_out") & ~F.col("from_in")).cast("long")
    fix = F.when(
        F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("end"), F.col("_turns").alias("turns"))
    )
    steps = df.withColumn("_turns", F.sum(turn).over(so_far)).withColumn("_fix", F.last(fix, True).over(so_far))
    # both columns hold the row's own step; the row before has what comes before it
    before = F.lag(F.struct("_turns", "_fix")).over(window)
    turned = (F.col("_before._turns") - F.coalesce(F.col("_before._fix.turns"), F.lit(0))) % 2 == 1
    state = F.coalesce(F.col("_before._fix.end"), first) != F.coalesce(turned, F.lit(False))
    return steps.withColumn("_before", before).withColumn("inside", state).drop("_before")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    quoted = F.contains("value", F.lit('"'))
    return lines.withColumns(
        {
            "from_out": F.when(quoted, _ends_inside(F.col("value"), OUT)).otherwise(False),
            "from_in": F.when(quoted, _ends_inside(F.col("value"), IN)).otherwise(True),
        }
    )


def _blank(value: Column) -> Column:
    return F.rtrim(value, F.lit("\r")) == ""


def _block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, starts_inside, open_record, header): one row a block.

    `open_record` is the record that goes on into the block, as the block and line of its start.
    """
    order = Window.partitionBy(*BLOCK).orderBy("line")
    slim = lines.withColumn("blank", _blank(F.col("value"))).drop("value")
    # what the block would do, started outside and started inside
    walked = _with_start(slim, order, F.lit(False)).withColumnRenamed("inside", "if_out")
    walked = _with_start(walked, order, F.lit(True)).withColumnRenamed("inside", "if_in")

    def end(state: str) -> Column:
        return F.max_by(F.when(F.col(state), F.col("from_in")).otherwise(F.col("from_out")), "line")

    def first(pick, state: str) -> Column:
        return pick(F.when(~F.col(state) & ~F.col("blank"), F.col("line")))

    blocks = walked.groupBy(*BLOCK).agg(
        end("if_out").alias("from_out"),
        end("if_in").alias("from_in"),
        first(F.min, "if_out").alias("min_out"),
        first(F.min, "if_in").alias("min_in"),
        first(F.max, "if_out").alias("max_out"),
        first(F.max, "if_in").alias("max_in"),
    )
    by_file = Window.partitionBy("file").orderBy("block")
    placed = _with_start(blocks, by_file, F.lit(False))
    known = placed.select(
        *BLOCK,
        F.col("inside").alias("starts_inside"),
        F.when(F.col("inside"), F.col("min_in")).otherwise(F.col("min_out")).alias("lowest"),
        F.when(F.col("inside"), F.col("max_in")).otherwise(F.col("max_out")).alias("highest"),
    )

    def record(line: str) -> Column:
        return F.when(F.col(line).isNotNull(), F.struct(F.col("block").alias("block"), F.col(line).alias("line")))

    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    return known.select(
        *BLOCK,
        "starts_inside",
        F.last(record("highest"), True).over(earlier).alias("open_record"),
        F.min(record("lowest")).over(whole).alias("header"),
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record): the records of one CSV file or a folder of them as text, without each file's header.

    Lines end in a line feed, with or without a carriage return. Blank lines outside quotes are no records. A cell
    that is never closed makes the rest of its file one record, as for any reader.
    """
    lines = _lines(spark, path)
    order = Window.partitionBy(*BLOCK).orderBy("line")
    placed = lines.join(_block_starts(lines), list(BLOCK))
    located = _with_start(placed, order, F.col("starts_inside"))
    begins = ~F.col("inside") & ~_blank(F.col("value"))
    own = F.last(F.when(begins, F.struct("block", "line")), True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # a line that is outside and blank belongs to nothing
    lettered = (
        located.withColumn("owner", F.coalesce(own, "open_record"))
        .where(F.col("inside") | begins)
        .where(F.col("owner") != F.col("header"))
    )
    # a block's own records need no shuffle of their own; the pieces of those that go on meet by their start
    parts = lettered.groupBy(*BLOCK, "owner").agg(
        F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"),
        F.max(F.struct("line", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("open")))[
            "open"
        ].alias("open"),
    )
    crosses = (F.col("owner.block") != F.col("block")) | F.col("open")
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    pieces = parts.select(*BLOCK, "owner", crosses.alias("crosses"), text.alias("text"))
    inner = pieces.where(~F.col("crosses")).select("file", "text")
    outer = (
        pieces.where("crosses")
        .groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        .select("file", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    )
    return inner.unionAll(outer).select("file", F.rtrim("text", F.lit("\r")).alias("record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all cells as text, line breaks inside cells as written.

    The rows are those of the one-task `multiLine` reader, which turns breaks inside cells into line feeds where lines
    end in a carriage return and a line feed.
    """
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    names = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    parsed = csv_records(spark, path).select(F.from_csv("record", schema, options).alias("cells"))
    return parsed.select("cells.*")
