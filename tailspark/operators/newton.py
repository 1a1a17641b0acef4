"""Penalised logistic fits by Newton steps, many fits in one pass.

A pass adds up the loss, the gradient and the curvature of every fit over the rows, which is a small matrix a fit.
The objective is strictly convex, so a gradient of zero marks its one optimum; a step that raises it is halved. Fits
of one pass may differ in their penalty, in how missing values are filled and columns scaled, and in the rows they
see (those whose `part` is at most the fit's last one).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10  # of every element of the gradient of the mean loss
MOST_STEPS = 100


@dataclass(frozen=True)
class Scaled:
    """How the columns of some fits are filled and scaled, and the last part whose rows they see."""

    median: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    last: int = 0


@dataclass(frozen=True)
class Task:
    """One fit: the place of its `Scaled`, the weight of each class and the penalty of half the squared coefficients."""

    scaled: int
    weights: tuple[float, float]
    penalty: float
    rows: int


@dataclass(frozen=True)
class LogisticFit:
    intercept: float
    coefficients: DenseVector

    def probability(self, columns: Sequence[Column]) -> Column:
        score = sum((x * F.lit(float(c)) for x, c in zip(columns, self.coefficients)), F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-score))


def fit_logistic(
    rows: DataFrame, label: str, columns: Sequence[str], scaled: Sequence[Scaled], tasks: Sequence[Task], part: str | None = None
) -> list[LogisticFit]:
    """Fit every task on stored rows, a label of 0 and 1."""
    source = rows.select(
        F.col(label).cast("double").alias("_y"),
        (F.lit(0) if part is None else F.col(part)).cast("int").alias("_part"),
        *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)],
    )
    width = len(columns) + 1
    at = [np.zeros(width) for _ in tasks]
    best: list[tuple | None] = [None] * len(tasks)
    going = set(range(len(tasks)))
    ridge = np.r_[0.0, np.ones(width - 1)]
    for _ in range(MOST_STEPS):
        sums = _sums(source, scaled, tasks, {t: at[t] for t in going})
        for t in sorted(going):
            loss, gradient, curvature = sums[t]
            penalty = tasks[t].penalty * ridge
            loss = loss / tasks[t].rows + 0.5 * float(penalty @ (at[t] * at[t]))
            gradient = gradient / tasks[t].rows + penalty * at[t]
            curvature = curvature / tasks[t].rows + np.diag(penalty)
            if np.abs(gradient).max() < TOLERANCE:
                best[t] = at[t], loss
                going.discard(t)
            elif best[t] is not None and not loss <= best[t][1] + 1e-13 * abs(best[t][1]):
                at[t] = best[t][0] + (at[t] - best[t][0]) / 2
            else:
                best[t] = at[t], loss
                at[t] = at[t] - np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        if not going:
            break
    return [LogisticFit(float(b[0][0]), Vectors.dense(b[0][1:])) for b in best]


def _sums(source: DataFrame, scaled: Sequence[Scaled], tasks: Sequence[Task], at: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Per fit: the summed loss, gradient and curvature at its coefficients, intercept first."""
    width = len(next(iter(at.values())))
    groups = [(s, [t for t in at if tasks[t].scaled == i]) for i, s in enumerate(scaled)]
    groups = [(np.array(s.median), np.array(s.mean), np.array(s.scale), s.last, fits) for s, fits in groups if fits]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: np.zeros(1 + width + width * width) for t in at}
        for batch in batches:
            numbers = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(numbers[0]):
                continue
            x_all, y_all, parts = np.column_stack(numbers[2:]), numbers[0], numbers[1]
            for median, mean, scale, last, fits in groups:
                seen = parts <= last
                y = y_all[seen]
                if not len(y):
                    continue
                x = x_all[seen]
                x = (np.where(np.isnan(x), median, x) - mean) / scale
                x = np.column_stack([np.ones(len(x)), x])
                for t in fits:
                    weight = np.where(y == 1, tasks[t].weights[1], tasks[t].weights[0])
                    score = x @ at[t]
                    p = np.exp(-np.logaddexp(0.0, -score))
                    total[t][0] += weight @ (np.logaddexp(0.0, score) - y * score)
                    total[t][1 : 1 + width] += x.T @ (weight * (p - y))
                    total[t][1 + width :] += (x.T @ (x * (weight * p * (1.0 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["fit", "sums"]
        )

    def merged(table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(v.as_buffer()) for v in table["sums"]], axis=0)
        return pa.table({"fit": table["fit"][:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "fit int, sums binary"
    found = source.mapInArrow(add, schema).groupBy("fit").applyInArrow(merged, schema).collect()
    split = {r.fit: np.frombuffer(bytes(r.sums)) for r in found}
    return {t: (v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width)) for t, v in split.items()}
