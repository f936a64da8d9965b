"""Token-id files.

Documents are dealt to files by ranges of their id and tokenized there in order;
the ids of a file form one stream that is cut into blocks of ``BLOCK`` ids, each
coded on its own (``rangecoder``). A record holds one block, the segments of
documents in it and where it starts in its file, so any block can be read alone.
Records are kept in Parquet, which every store that Spark writes to can hold.

Null text is empty and holds the end id alone. Null ids come first; rows with equal
ids are documents each, in any order. An empty table gives files without records.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import give_back, slices, texts
from .rangecoder import BLOCK, LANES, decode_blocks, encode_blocks
from .tokens import encoder

END = 2
#: token pieces a worker remembers in each of two generations, beside the lanes of the coder
REMEMBERED = 250_000


def _records(key_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("file", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("first_doc", T.LongType()), T.StructField("keys", T.ArrayType(key_type)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
    ])


class _Stream:
    """Cuts a file's ids into blocks and remembers which documents they hold."""

    def __init__(self, file: int):
        self.file, self.start, self.doc, self.first = file, 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.keys: list = []
        self.sizes: list[int] = []
        self.done: list[tuple] = []
        self.room = BLOCK

    def add(self, key, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.room]
            self.ids.append(part)
            self.keys.append(key)
            self.sizes.append(len(part))
            self.room -= len(part)
            at += len(part)
            if not self.room:
                self.close(self.doc if at < len(ids) else self.doc + 1)
        self.doc += 1

    def close(self, next_doc: int) -> None:
        if not self.sizes:
            return
        n = BLOCK - self.room
        self.done.append((self.start, n, self.first, self.keys, self.sizes, np.concatenate(self.ids)))
        self.start += n
        self.first = next_doc
        self.ids, self.keys, self.sizes, self.room = [], [], [], BLOCK

    def records(self, key_type: pa.DataType) -> pa.RecordBatch:
        payloads = encode_blocks([d[5] for d in self.done])
        cols = list(zip(*[d[:5] for d in self.done], strict=True))
        self.done = []
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.file] * len(payloads), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(key_type)), pa.array(cols[4], pa.list_(pa.int64())),
                pa.array(payloads, pa.binary()),
            ],
            ["file", "start", "n_ids", "first_doc", "keys", "sizes", "payload"],
        )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Token-id files of all documents under ``path``, in ascending order of ``key``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(docs[key].alias("__key"), docs[text].alias("__text"))
    source = source.repartitionByRange(n, "__key").sortWithinPartitions("__key")
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer, REMEMBERED)
        stream = _Stream(TaskContext.get().partitionId())
        kind = pa.int64()
        for batch in slices(batches, "__text"):
            kind = batch.column(0).type
            for k, coded in zip(batch.column(0).to_pylist(), enc.encode(texts(batch, "__text")), strict=True):
                stream.add(k, np.frombuffer(coded + tail, "<u4"))
                if len(stream.done) >= LANES:
                    yield stream.records(kind)
        enc.forget()
        stream.close(stream.doc)
        if stream.done:
            yield stream.records(kind)
        give_back()

    source.mapInArrow(run, _records(source.schema["__key"].dataType)).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Segments of documents: ``file, doc, key, start, n_ids, crc32`` and, if wanted, ``ids``.

    ``start`` counts the ids of all documents before; a document that runs over
    several blocks has a segment in each.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    rows = blocks.join(offsets, "file").select("file", F.col("start") + F.col("__offset"), "first_doc", "keys", "sizes", "payload")
    key_type = blocks.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("file", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("key", key_type),
        T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if ids else []),
    ])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, LANES):
                part = batch.slice(a, LANES)
                file, start, first, keys, sizes, payload = (c.to_pylist() for c in part.columns)
                cols: list[list] = [[] for _ in schema]
                for f, s, d, ks, ns, got in zip(file, start, first, keys, sizes, decode_blocks(payload), strict=True):
                    at = 0
                    for k, (key, n) in enumerate(zip(ks, ns, strict=True)):
                        raw = got[at : at + n].tobytes()
                        for col, v in zip(cols, (f, d + k, key, s + at, n, zlib.crc32(raw), raw), strict=False):
                            col.append(v)
                        at += n
                kinds = [pa.int32(), pa.int64(), part.column(3).type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], schema.names)

    return rows.mapInArrow(run, schema)


def join_crc(segments: list[tuple[int, int]]) -> int:
    """crc32 of segments put together, from the (bytes, crc32) of each.

    Appending zeros shows how the crc so far moves on; what the zeros alone give is
    taken out and the next segment's crc put in.
    """
    crc = 0
    for k, (size, own) in enumerate(segments):
        zeros = bytes(size)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own if k else own
    return crc


def file_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, read from its files."""
    segments = read_token_files(spark, path, ids=False)
    docs = segments.groupBy("file", "doc").agg(
        F.first("key").alias("key"), F.min("start").alias("start"), F.sum("n_ids").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("start", "n_ids", "crc32"))).alias("parts"),
    ).select("key", "start", "n_tokens", "parts")
    schema = T.StructType([
        T.StructField(key, docs.schema["key"].dataType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches):
        for batch in batches:
            crc = [join_crc([(4 * p["n_ids"], p["crc32"]) for p in parts]) for parts in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)
