"""Exact medians of many columns in a few passes, however many columns and rows.

A double's bits, taken in order of its value, are found from the top: a pass counts the values by their next bits,
which tells the cell that holds the middle, and later passes count inside that cell only. A cell of one value is done;
once few values are left in it, the last pass counts these one by one. A task gives one row for each cell that it saw.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = 0.0005  # the share of a column's rows that the last pass counts one by one
LEAST = 1000  # so many are counted one by one in any case
FIRST, NEXT = 16, 8  # bits of a pass: sign, exponent and the first places, then finer
HELD = 1 << 20  # cells a task holds at once
CELL = "i int, cell long, part int, n long, low long, high long"


def exact_medians(df: DataFrame, columns: Sequence[str], error: float = ERROR) -> dict[str, float | None]:
    """Median per column, None for a column without values. `df` is stored: it is read several times. Missing values and NaN do not count."""
    return prefix_medians(df.withColumn("_part", F.lit(0)), columns, "_part", [0], error)[0]


@dataclass(frozen=True)
class _Place:
    """A place in the order of the values of a cell, with the cell's rows, lowest and highest value."""

    cell: int
    place: int
    rows: int
    low: int
    high: int


def prefix_medians(
    df: DataFrame, columns: Sequence[str], part: str, upto: Sequence[int], error: float = ERROR
) -> list[dict[str, float | None]]:
    """The medians over the rows whose `part` is at most each number of `upto`, all in the same passes."""
    values = df.select(F.col(part).cast("int").alias("_part"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    counts = counted_cells(values, dict.fromkeys(range(len(columns))), 0, FIRST)
    # the two middle places of a column's rows up to a part
    places: dict[tuple[int, int, int], _Place] = {}
    sizes = {}
    for i in range(len(columns)):
        for k, last in enumerate(upto):
            sizes[i, k] = sum(n for _, p, n, _, _ in counts[i] if p <= last)
            for side in (0, 1) if sizes[i, k] else ():
                places[i, k, side] = _narrowed(counts[i], None, (sizes[i, k] - 1 + side) // 2, last, FIRST)
    known = FIRST
    while known < 64 and (rest := {t: p for t, p in places.items() if p.low < p.high}):
        few = all(p.rows <= max(LEAST, error * sizes[t[:2]]) for t, p in rest.items())
        bits = 64 - known if few else min(NEXT, 64 - known)
        cells = defaultdict(set)
        for t, p in rest.items():
            cells[t[0]].add(p.low >> (64 - known))
        counts = counted_cells(values, cells, known, bits)
        for t, p in rest.items():
            places[t] = _narrowed(counts[t[0]], p.low >> (64 - known), p.place, upto[t[1]], bits)
        known += bits
    found: list[dict[str, float | None]] = [dict.fromkeys(columns) for _ in upto]
    for i, k, side in places:
        if side == 0:
            a, b = (_value(places[i, k, s].low) for s in (0, 1))
            found[k][columns[i]] = a if a == b else a + (b - a) * 0.5
    return found


def _narrowed(counts: list, cell: int | None, place: int, last: int, bits: int) -> _Place:
    """The finer cell that holds the place."""
    inside: dict[int, tuple[int, int, int]] = {}
    for finer, part, n, low, high in counts:
        if part <= last and (cell is None or finer >> bits == cell):
            rows, a, b = inside.get(finer, (0, low, high))
            inside[finer] = rows + n, min(a, low), max(b, high)
    for finer in sorted(inside):
        rows, low, high = inside[finer]
        if place < rows:
            return _Place(finer, place, rows, low, high)
        place -= rows
    raise AssertionError("the rows changed between two passes")


def order_keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; the two zeros are one value. Twice gives the bits back."""
    return _flipped((x + 0.0).view(np.int64))


def _flipped(bits: np.ndarray) -> np.ndarray:
    return bits ^ ((bits >> np.int64(63)) & np.int64((1 << 63) - 1))


def _value(key: int) -> float:
    return float(_flipped(np.array([key], np.int64)).view(np.float64)[0])


def counted_cells(values: DataFrame, cells: dict, known: int, bits: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per column (cell of `known + bits` bits, part, rows, lowest, highest value), inside the given cells of `known` bits."""
    wanted = {i: None if c is None else np.array(sorted(c), np.int64) for i, c in cells.items()}

    def merged(held: list[np.ndarray]) -> np.ndarray:
        """One row for each (cell, part)."""
        table = np.concatenate(held)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        first = np.flatnonzero(np.any(np.diff(table[:, :2], axis=0, prepend=table[:1, :2] - 1) != 0, axis=1))
        return np.column_stack([
            table[first, :2], np.add.reduceat(table[:, 2], first), np.minimum.reduceat(table[:, 3], first), np.maximum.reduceat(table[:, 4], first),
        ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = defaultdict(list)
        size: dict[int, int] = defaultdict(int)
        for batch in batches:
            parts = batch.column("_part").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, found in wanted.items():
                x = batch.column(f"_{i}").to_numpy(zero_copy_only=False)
                here = np.flatnonzero(~np.isnan(x))
                keys = order_keys(x[here])
                if found is not None:
                    near = np.isin(keys >> np.int64(64 - known), found)
                    here, keys = here[near], keys[near]
                mine = parts[here]
                for part in np.unique(mine):
                    ordered = np.sort(keys[mine == part])
                    cell = ordered >> np.int64(64 - known - bits)
                    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                    end = np.append(first[1:], len(cell))
                    of_part = np.full(len(first), part, np.int64)
                    held[i].append(np.column_stack([cell[first], of_part, end - first, ordered[first], ordered[end - 1]]))
                    size[i] += len(first)
                if size[i] > HELD:
                    held[i] = [merged(held[i])]
                    size[i] = len(held[i][0]) // 2
        for i, tables in held.items():
            table = merged(tables)
            columns = [np.full(len(table), i, np.int32), table[:, 0], table[:, 1].astype(np.int32), *table.T[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in CELL.split(", ")])

    rows = values.select("_part", *[f"_{i}" for i in wanted]).mapInArrow(count, CELL)
    grouped = rows.groupBy("i", "cell", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    counts: dict[int, list] = {i: [] for i in wanted}
    for r in grouped.collect():
        counts[r.i].append((r.cell, r.part, r.n, r.low, r.high))
    return counts


GRAIN = 18  # bits of a cut: 64 cells between a power of two and the next


def prefix_cuts(
    df: DataFrame, columns: Sequence[str], part: str, upto: Sequence[int], fills: Sequence[Sequence[float]], most: int
) -> list[list[list[float]]]:
    """Per number of `upto` and column the ascending cuts between at most `most` bins of equal size, missing values filled.

    A column of few values has a cut at each but the largest. Cuts are seen values, within one cell of the exact share.
    """
    values = df.select(F.col(part).cast("int").alias("_part"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    counts = counted_cells(values, dict.fromkeys(range(len(columns))), 0, GRAIN)
    sizes = {r["_part"]: r["count"] for r in values.groupBy("_part").count().collect()}
    found = []
    for last, fill in zip(upto, fills):
        rows, of_fold = sum(n for p, n in sizes.items() if p <= last), []
        for i in range(len(columns)):
            inside = [c for c in counts[i] if c[1] <= last]
            missing = rows - sum(c[2] for c in inside)
            key = int(order_keys(np.array([fill[i]], float))[0])
            inside.append((key >> (64 - GRAIN), 0, missing, key, key))
            table = np.array([c for c in inside if c[2]], np.int64)
            cells, at = np.unique(table[:, 0], return_inverse=True)
            n, low, high = np.zeros(len(cells), np.int64), np.full(len(cells), np.iinfo(np.int64).max), np.full(len(cells), np.iinfo(np.int64).min)
            np.add.at(n, at, table[:, 2])
            np.minimum.at(low, at, table[:, 3])
            np.maximum.at(high, at, table[:, 4])
            if len(cells) <= most and (low == high).all():
                cuts = set(high.tolist())
            else:
                upper = np.searchsorted(np.cumsum(n), rows * np.arange(1, most) / most, side="left")
                cuts = set(high[upper].tolist())
                if len(cuts) < most - 1:
                    cuts.add(int(low[0]))
            of_fold.append(sorted(_value(c) for c in cuts if c < high[-1]))
        found.append(of_fold)
    return found
