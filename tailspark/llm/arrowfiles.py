"""Token ids as Arrow files of equal-length sequences.

Documents in ascending order of doc_id make one stream of ids. It is cut into ranges of doc_id,
one file each; a file holds the range's ids as fixed-size lists, with a list of the same length
that marks ids (true) and the padding after the file's last id (false). Record batches have
`BATCH` sequences, so sequence i lies in batch i // BATCH and is read without copying. Beside each file an
index file names the documents and their places. Files are written under a name of the attempt
and moved into place, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.llm.common import bounds_of, buckets_for, chunks, text_column, with_bucket
from tailspark.llm.tokens import WordCoder, model_path

LENGTH, END_ID, BATCH = 2048, 2, 256
MANIFEST = "bucket int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file that may be given as a URI."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else uri
    return pafs.FileSystem.from_uri(uri)


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Writes one stream of ids and its index to `path`.arrow and `path`.index.arrow."""

    def __init__(self, path: str, kind: pa.DataType, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.path = _located(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.length, self.batch, self.kind = length, batch, kind
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.waiting, self.total = [], 0, 0
        self.docs: list = []
        self.sizes: list[np.ndarray] = []

    def add(self, docs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents, all their ids, flat, and how many each has."""
        self.docs += docs.to_pylist()
        self.sizes.append(sizes)
        self.held.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        block = self.length * self.batch
        if self.waiting >= block:
            flat = np.concatenate(self.held)
            full = len(flat) // block * block
            for i in range(0, full, block):
                self._write(flat[i : i + block], block)
            self.held, self.waiting = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, room: int) -> None:
        values = np.zeros(room, self.kind.to_pandas_dtype())
        values[: len(ids)] = ids
        mask = np.arange(room) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> tuple[int, int]:
        """Number of documents and ids. Both files are in place after this."""
        left = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        if len(left):
            self._write(left, -(-len(left) // self.length) * self.length)
        self.writer.close()
        self.sink.close()
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        index = pa.table(
            {"doc_id": pa.array(self.docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())}
        )
        with self.fs.open_output_stream(self.own + ".index") as sink, pa.ipc.new_file(sink, index.schema) as writer:
            writer.write_table(index)
        self.fs.move(self.own + ".index", self.path + ".index.arrow")
        self.fs.move(self.own, self.path + ".arrow")
        return len(self.docs), self.total


class SequenceFile:
    """Random access to the sequences, masks and documents of one file."""

    def __init__(self, path: str):
        fs, path = _located(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = [pa.memory_map(path + e) if local else fs.open_input_file(path + e) for e in (".arrow", ".index.arrow")]
        self.file = pa.ipc.open_file(opened[0])
        self.index = pa.ipc.open_file(opened[1]).read_all()
        self.length = self.file.schema.field("input_ids").type.list_size
        first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.batch = max(1, first)
        self._at, self._columns = -1, None

    def _load(self, number: int):
        if number != self._at:
            batch = self.file.get_batch(number)
            values = batch.column("input_ids").flatten().to_numpy()
            self._at, self._columns = number, (values, batch.column("mask"))
        return self._columns

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, a view of the file, and mask of sequence i."""
        values, mask = self._load(i // self.batch)
        at = i % self.batch
        return values[at * self.length : (at + 1) * self.length], mask[at].values.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the stream."""
        block, parts = self.batch * self.length, []
        while n > 0:
            values, _ = self._load(start // block)
            piece = values[start % block : start % block + n]
            parts.append(piece)
            start, n = start + len(piece), n - len(piece)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def _written(folder: str, tokenizer: str, length: int, end_id: int):
    def run(batches):
        coder = WordCoder.load(tokenizer)
        kind, writer, bucket = id_type(coder.size), None, None
        out = []

        def done():
            if writer is not None:
                out.append((bucket, f"{folder}/tokens-{bucket + 1:06d}", *writer.close()))

        for batch in batches:
            for part in chunks(batch, size=16_000_000):
                ids, sizes = coder.encode(part.column("text"))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                at = np.concatenate([[0], np.cumsum(sizes)])
                buckets = part.column("_bucket").to_numpy()
                cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if writer is None or buckets[a] != bucket:
                        done()
                        bucket = int(buckets[a])
                        writer = SequenceWriter(f"{folder}/tokens-{bucket + 1:06d}", kind, length)
                    writer.add(part.column("doc_id").slice(a, b - a), ids[at[a] : at[b]], sizes[a:b])
        done()
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return run


def write_sequences(
    docs: DataFrame, folder: str, length: int = LENGTH, end_id: int = END_ID, tokenizer: str | None = None
) -> DataFrame:
    """Writes the ids of all texts to `folder` and returns the manifest: a row for each file, in order, with
    `start`, the ids of all files before it.

    The ids of a document are its text's and `end_id`; a missing text is that id alone. Rows that
    share a doc_id go by text, rows without doc_id come first. Ids take 16 bits where the
    vocabulary allows it. The number of files is at most four times the shuffle partitions, so the
    manifest is short. An empty table writes no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    ranged = with_bucket(rows, "doc_id", bounds_of(rows, "doc_id", buckets_for(rows)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ranged.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "doc_id", "text")
    written = ordered.mapInArrow(_written(folder, tokenizer or model_path(), length, end_id), MANIFEST).collect()
    start, manifest = 0, []
    for r in sorted(written, key=lambda r: r["bucket"]):
        manifest.append((*r, start))
        start += r["n_tokens"]
    return spark.createDataFrame(manifest, MANIFEST + ", start long")


def _read(batches):
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            file = SequenceFile(path)
            index = file.index
            starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
            crcs = [zlib.crc32(file.span(int(s), int(n)).astype("<u4")) for s, n in zip(starts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    index.column("doc_id").combine_chunks() if index.num_rows else pa.array([], pa.int64()),
                    pa.array(starts + base), pa.array(sizes), pa.array(np.array(crcs, np.int64)),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "bucket").mapInArrow(_read, ROWS)


def round_trip(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Writes the sequences to `folder` and reads the documents back from there."""
    return read_documents(write_sequences(docs, folder))
