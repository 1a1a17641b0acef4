"""Packing documents into token windows by the online sum-of-squares rule.

Each task packs its own rows. A document's full windows are cut off first; what remains goes to
the window level (or a new window) that makes the sum of the squared numbers of windows at each
level least. Levels are kept in one array. After every block of about `BLOCK_TOKENS` tokens the
windows still open are closed: the emptiest are dissolved, their pieces cut to fill up the
others, so at most one window of a block is left unfilled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import chunks, ends, text_column
from tailspark.llm.tokens import WordCoder, model_path

WINDOW, END_ID, BLOCK_TOKENS = 2048, 1, 4_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Levels:
    """Open windows by fill level; `place` gives the level that the sum-of-squares rule picks."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> int:
        """Level to add `size` (1 .. window - 1) to, 0 for a new window; ties go to the fullest."""
        n, w = self.count, self.window
        # levels 0 .. w - size; change of the sum of squares, halved, without the constant
        after = n[size : w + 1].astype(np.float64)
        after[-1] = -0.5  # a full window has no square
        change = after - n[: w - size + 1]
        change[0] = after[0] - 0.5  # a new window leaves no level
        change[1:][n[1 : w - size + 1] == 0] = np.inf
        if size == w:
            return 0
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, window: int) -> None:
        if level < self.window:
            self.count[level] += 1
            self.open[level].append(window)


def pack(sizes: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window number, offset) of the pieces of documents of these sizes."""
    levels, pieces, made = Levels(window), [], 0
    inside: dict[int, list[tuple[int, int, int, int]]] = {}  # of windows still open
    for doc, size in enumerate(sizes.tolist()):
        full, rest = divmod(size, window)
        for k in range(full):
            pieces.append((doc, k * window, window, made, 0))
            made += 1
        if rest:
            level = levels.place(rest)
            if level:
                at = levels.take(level)
            else:
                at, made = made, made + 1
            inside.setdefault(at, []).append((doc, full * window, rest, level))
            if level + rest == window:
                pieces += [(d, s, n, at, o) for d, s, n, o in inside.pop(at)]
            else:
                levels.put(level + rest, at)
    # close: fill the fullest windows with pieces of the emptiest
    left = sorted(inside.items(), key=lambda x: -(x[1][-1][2] + x[1][-1][3]))
    low, high = 0, len(left) - 1
    while low < high:
        at, own = left[low]
        fill = own[-1][2] + own[-1][3]
        while fill < window and low < high:
            doc, start, n, offset = left[high][1].pop()
            cut = min(n, window - fill)
            own.append((doc, start + n - cut, cut, fill))
            fill += cut
            if cut < n:
                left[high][1].append((doc, start, n - cut, offset))
            if not left[high][1]:
                high -= 1
        if fill < window:
            break
        low += 1
    for at, own in left:
        pieces += [(d, s, n, at, o) for d, s, n, o in own]
    return pieces


def _packed(path: str, window: int, end_id: int, block_tokens: int):
    def emit(docs, ids, sizes, made, base):
        at = ends(sizes)
        rows = sorted(pack(sizes, window))
        flat = ids.astype("<u4")
        crcs = [zlib.crc32(flat[at[d] + s : at[d] + s + n]) for d, s, n, _, _ in rows]
        table = np.array(rows, np.int64).reshape(-1, 5)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = [
            docs.take(pa.array(table[:, 0])), table[:, 1], table[:, 2], np.array(crcs, np.int64),
            sizes[table[:, 0]], base + made + table[:, 3], table[:, 4],
        ]
        batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)
        return batch, made + (int(table[:, 3].max()) + 1 if len(table) else 0)

    def run(batches):
        coder = WordCoder.load(path)
        base = TaskContext.get().partitionId() << 36
        made, held, docs, sizes, tokens = 0, [], [], [], 0
        for batch in batches:
            for part in chunks(batch, size=8_000_000):
                ids, counts = coder.encode(part.column("text"))
                closed = np.insert(ids, np.cumsum(counts), end_id)
                held.append(closed)
                docs.append(part.column("doc_id"))
                sizes.append(counts + 1)
                tokens += len(closed)
                if tokens >= block_tokens:
                    out, made = emit(pa.concat_arrays(docs), np.concatenate(held), np.concatenate(sizes), made, base)
                    yield out
                    held, docs, sizes, tokens = [], [], [], 0
        if docs:
            yield emit(pa.concat_arrays(docs), np.concatenate(held), np.concatenate(sizes), made, base)[0]

    return run


def pack_documents(
    docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text, ...), see SCHEMA.

    A document is its text's ids and `end_id`; a missing text counts as empty and is that id
    alone. start counts the document's ids before the piece, offset the window's. Windows are
    padded to `window`. sequence_id is unique; it numbers the windows of a task from the task's
    own range. Repeated rows are packed as often as they occur, and rows without doc_id with a
    null one. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(_packed(tokenizer or model_path(), window, end_id, block_tokens), SCHEMA)
