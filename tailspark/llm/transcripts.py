"""Transcript parsing: a hidden Markov model recovers the roles, then turns are rendered.

The hidden states of a line are the speaker's role and whether the line begins a turn or goes on
with it. A line shows a speaker marker, if any, its place in its row, its length and whether it ends as a
question. Spark counts transitions and emissions over all rows whose role is known; markers have
fixed weights. Roles are then read off by Viterbi, without looking at the given ones.

A conversation may be of any length: its rows are cut into blocks of at most `BLOCK` rows. For that all rows are
put in order by ranges, which also cut rows that share conversation and turn, and numbered. A block gives
the best score from each state before it to each state at its end; these tables are combined
`BLOCK` at a time up to one for the conversation, the states at the blocks' ends are fixed on the
way down, and every block is then decoded on its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.llm.common import stage

ROLES = ("system", "user", "assistant")
BLOCK = 64
HEAD = 256  # characters of a text that order rows of one turn
STATES = 2 * len(ROLES) + 1  # begins and goes on for each role, and the start
START = STATES - 1
FEATURES = 16
MARKERS = {
    "system": "system", "user": "user", "human": "user", "customer": "user", "q": "user", "question": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "a": "assistant", "answer": "assistant",
}
MARKER = r"(?i)^[ \t>#*\[<|-]*(system|user|human|customer|question|q|assistant|ai|bot|agent|answer|a)[ \t]*[\]|>*]*[ \t]*[:>][ \t*]*"
_MARKER = re.compile(MARKER)
OUT = (
    "conv_id long, turn long, part int, role string, given_role string, continues boolean, n_lines int, rendered string"
)


def _symbol(line: Column, i: Column) -> Column:
    """16 features of the line times 4 kinds of marker."""
    kinds = F.create_map(*[F.lit(x) for name, role in MARKERS.items() for x in (name, 1 + ROLES.index(role))])
    marker = F.coalesce(F.element_at(kinds, F.lower(F.regexp_extract(line, MARKER, 1))), F.lit(0))
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    size = F.when(words <= 3, 0).when(words <= 12, 1).when(words <= 40, 2).otherwise(3)
    question = F.when(F.rtrim(line).endswith("?"), 1).otherwise(0)
    return marker * FEATURES + F.when(i == 0, 8).otherwise(0) + size * 2 + question


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, place, given_role, text, symbols): a row is one message or several lines of a transcript.

    A row without conv_id is a conversation of its own; one without turn comes after the others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    alone = F.concat(F.lit("row "), F.xxhash64(text, turn).cast("string"))
    return _with_symbols(conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), alone).alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        turn.alias("turn"),
        F.coalesce(F.greatest(turn, F.lit(0)), F.lit(2**31)).alias("place"),
        F.col("role").cast("string").alias("given_role"),
        text.alias("text"),
    ))


def _with_symbols(rows: DataFrame) -> DataFrame:
    return rows.withColumn("symbols", F.transform(F.split(F.col("text"), "\n"), _symbol))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` written in order of conversation and place, with number (a count over all rows) and block.

    The order is total, as repeated rows get a number of their own before they are dealt, so ranges cut any
    group: rows without turn, of one turn, and copies. A block is BLOCK numbers of one conversation.
    """
    tie, head = F.monotonically_increasing_id(), F.substring("text", 1, HEAD)
    keyed = rows.drop("symbols").select("*", head.alias("head"), F.xxhash64("text").alias("digest"), tie.alias("tie"))
    order = ["conv", "place", "head", "digest", "given_role", "tie"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "digest", "tie")
    # symbols are worked out behind the shuffle, which samples its rows
    placed = stage(_with_symbols(ranged).withColumn("at", F.monotonically_increasing_id()), "transcripts")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # one row for each shuffle partition
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    number = F.col("_before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counted = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("number", number)
    return counted.drop("_part", "_before", "at").withColumn("block", F.floor(F.col("number") / BLOCK))


def train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the transition table (STATES x STATES) and the emission table (STATES x symbols).

    All counts are over all rows with a known role; one is added to each. Rows of one
    conversation follow each other where their turns do. Where a turn has several rows, each counts
    as one move, shared out over the rows of the next turn.
    """
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("given_role")).cast("int") - 1
    known = rows.select("conv", "turn", role.alias("role"), "symbols").filter("role >= 0 and turn is not null")
    shown = (
        known.select("role", F.posexplode("symbols").alias("i", "symbol"))
        .groupBy((2 * F.col("role") + F.when(F.col("i") > 0, 1).otherwise(0)).alias("state"), (F.col("symbol") % FEATURES).alias("feature"))
        .count()
    )
    emission = np.ones((STATES, FEATURES))
    for r in shown.collect():
        emission[r["state"], r["feature"]] += r["count"]
    n = F.size("symbols")
    inner = known.groupBy("role").agg(F.sum(F.when(n > 1, 1).otherwise(0)).alias("on"), F.sum(F.greatest(n - 2, F.lit(0))).alias("more"))
    # counted before they meet: a turn joins at most 6 rows with 3, however often its rows repeat
    begin = known.groupBy("conv", "turn", (2 * F.col("role") + F.when(n > 1, 1).otherwise(0)).alias("last")).agg(F.count("*").alias("n"))
    after = known.groupBy("conv", (F.col("turn") - 1).alias("turn")).agg(
        F.count("*").alias("all"), *[F.count(F.when(F.col("role") == r, 1)).alias(f"n{r}") for r in range(len(ROLES))]
    )
    shared = [F.sum(F.col("n") * F.col(f"n{r}") / F.col("all")).alias(f"n{r}") for r in range(len(ROLES))]
    moves = begin.join(after, ["conv", "turn"]).groupBy("last").agg(*shared)
    first = known.groupBy("conv").agg(F.min_by("role", "turn").alias("next")).groupBy("next").count()
    allowed = np.zeros((STATES, STATES), bool)
    allowed[:, 0:START:2] = True
    for r in range(len(ROLES)):
        allowed[2 * r : 2 * r + 2, 2 * r + 1] = True
    move = np.where(allowed, 1.0, 0.0)
    for r in inner.collect():
        move[2 * r["role"], 2 * r["role"] + 1] += r["on"]
        move[2 * r["role"] + 1, 2 * r["role"] + 1] += r["more"]
    for r in moves.collect():
        for k in range(len(ROLES)):
            move[r["last"], 2 * k] += r[f"n{k}"]
    for r in first.collect():
        move[START, 2 * r["next"]] += r["count"]
    with np.errstate(divide="ignore"):
        transition = np.log(move / np.maximum(move.sum(axis=1, keepdims=True), 1))
    features = np.log(emission / emission.sum(axis=1, keepdims=True))
    marks = np.zeros((STATES, 1 + len(ROLES)))  # fixed weights: a marker begins its role's turn
    marks[:, 1:] = np.log(0.001)
    for r in range(len(ROLES)):
        marks[2 * r, 0], marks[2 * r, 1 + r] = np.log(0.5), 0.0
    table = (marks[:, :, None] + features[:, None, :]).reshape(STATES, -1)
    table[START] = -np.inf
    return transition, table


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores of going through a, then b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_path(steps: list[np.ndarray], entry: int, final: int) -> list[int]:
    """States after each step of the best way from `entry` to `final`; of equal ways that of the lowest states."""
    score, back = steps[0][entry], []
    for m in steps[1:]:
        way = score[:, None] + m
        back.append(way.argmax(axis=0))
        score = way.max(axis=0)
    path = [final]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _groups(batches, keys: list[str]):
    """Runs of rows with equal keys, as lists of dicts; one run is held at a time."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in keys)
            if held and now != key:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def _batched(rows, schema: pa.Schema, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


_TABLE = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("scores", pa.list_(pa.float64()))])
_ENDS = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int32()), ("final", pa.int32())])


def _steps(transition: np.ndarray, emission: np.ndarray) -> list[np.ndarray]:
    """One matrix for each symbol, shared by all lines that show it."""
    return [transition + emission[:, symbol] for symbol in range(emission.shape[1])]


def _leaf(transition: np.ndarray, emission: np.ndarray):
    def run(batches):
        steps = _steps(transition, emission)

        def tables():
            for rows in _groups(batches, ["conv", "block"]):
                total = None
                for row in rows:
                    for symbol in row["symbols"]:
                        total = steps[symbol] if total is None else times(total, steps[symbol])
                yield {"conv": rows[0]["conv"], "block": rows[0]["block"], "scores": total.ravel()}

        yield from _batched(tables(), _TABLE)

    return run


def _matrix(row: dict) -> np.ndarray:
    return np.array(row["scores"]).reshape(STATES, STATES)


def _joined(batches):
    def tables():
        for rows in _groups(batches, ["conv", "parent"]):
            total = _matrix(rows[0])
            for row in rows[1:]:
                total = times(total, _matrix(row))
            yield {"conv": rows[0]["conv"], "block": rows[0]["parent"], "scores": total.ravel()}

    yield from _batched(tables(), _TABLE)


def _split(batches):
    def found():
        for rows in _groups(batches, ["conv", "parent"]):
            path = best_path([_matrix(r) for r in rows], rows[0]["entry"], rows[0]["final"])
            for row, a, b in zip(rows, [rows[0]["entry"], *path], path):
                yield {"conv": row["conv"], "block": row["block"], "entry": a, "final": b}

    yield from _batched(found(), _ENDS)


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("given_role", pa.string()),
        ("continues", pa.bool_()), ("n_lines", pa.int32()), ("rendered", pa.string()),
    ]
)


def render(role: str, lines: list[str]) -> str:
    """A turn in canonical form, without its speaker marker."""
    return f"<|{role}|>\n" + "\n".join([_MARKER.sub("", lines[0], count=1), *lines[1:]]).strip() + "\n<|end|>\n"


def _decoded(transition: np.ndarray, emission: np.ndarray):
    def run(batches):
        steps = _steps(transition, emission)

        def turns():
            for rows in _groups(batches, ["conv", "block"]):
                path = best_path([steps[s] for row in rows for s in row["symbols"]], rows[0]["entry"], rows[0]["final"])
                at = 0
                for row in rows:
                    lines, states = row["text"].split("\n"), path[at : at + len(row["symbols"])]
                    at += len(states)
                    cuts = [i for i, s in enumerate(states) if i == 0 or s % 2 == 0] + [len(states)]
                    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        role = ROLES[states[a] // 2]
                        yield {
                            "conv_id": row["conv_id"], "turn": row["turn"], "part": part, "role": role,
                            "given_role": row["given_role"], "continues": states[a] % 2 == 1, "n_lines": b - a,
                            "rendered": render(role, lines[a:b]),
                        }

        yield from _batched(turns(), _ARROW)

    return run


def parse(conversations: DataFrame) -> DataFrame:
    """The turns of `conversations` (conv_id, turn, role, text, ...) with recovered roles, see OUT.

    A row gives one turn, or several where markers or the model see a change of speaker inside
    it; part numbers them. continues tells that a turn goes on from the row before. Rows of
    equal conv_id and turn go by the first HEAD characters of the text, then by a hash of it; rows repeat as often as they occur. A missing text is one
    empty line; a missing role is not trained on. Without any known role all counts are one and
    markers alone decide. Other columns are ignored.
    """
    spark = conversations.sparkSession
    rows = numbered(rows_of(conversations))
    transition, emission = train(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by(df: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
        return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    table = "conv string, block long, scores array<double>"
    leaf = by(rows.select("conv", "block", "number", "symbols"), "conv", "block", order=("number",))
    leaves = stage(leaf.mapInArrow(_leaf(transition, emission), table), "blocks")
    first = leaves.groupBy("conv").agg(F.min("block").alias("first"))
    # a level: one table a block, and the number of its parent, counted from the conversation's first block
    within = F.col("block") - F.col("first")
    levels = [stage(leaves.join(first, "conv").select("conv", "block", "scores", within.alias("within")), "blocks")]
    while (levels[-1].agg(F.max("within")).first()[0] or 0) > 0:
        up = by(_to_parent(levels[-1]), "conv", "parent", order=("block",))
        levels.append(stage(up.mapInArrow(_joined, table).withColumn("within", F.col("block")), "blocks"))
    starts = F.slice("scores", START * STATES + 1, STATES)
    ends_ = levels[-1].select(
        "conv", "block", F.lit(START).alias("entry"), (F.array_position(starts, F.array_max(starts)) - 1).cast("int").alias("final")
    )
    for level in reversed(levels[:-1]):
        down = _to_parent(level).join(ends_.withColumnRenamed("block", "parent"), ["conv", "parent"])
        ends_ = stage(
            by(down, "conv", "parent", order=("block",)).mapInArrow(_split, "conv string, block long, entry int, final int"), "ends"
        )
    decoded = by(rows.drop("place").join(ends_, ["conv", "block"]), "conv", "block", order=("number",))
    return decoded.mapInArrow(_decoded(transition, emission), OUT)


def _to_parent(level: DataFrame) -> DataFrame:
    return level.withColumn("parent", F.floor(F.col("within") / BLOCK)).drop("within")
