"""Helpers shared by the training-data operators.

Text work runs in ``mapInArrow`` over slices of bounded bytes, so a batch of very
long texts never becomes Python objects all at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.scale import write_through

#: bytes of text that are held as Python objects at a time
SLICE_BYTES = 4 << 20
#: stands for a null id in join keys; sorts first, as nulls do
NULL_ID = -(1 << 63)

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += _GOLD * np.uint64(salt + 1)
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


def mix2(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Order-dependent 64-bit hash of two arrays."""
    with np.errstate(over="ignore"):
        return mix(a * _GOLD + mix(b, salt), salt)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        group = np.cumsum(size.to_numpy(zero_copy_only=False)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b or b"" for b in col.to_pylist()]


def carried(
    df: DataFrame, text: str, added: T.StructType, fn: Callable[[pa.RecordBatch], dict], limit: int = SLICE_BYTES,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` in a struct ``row`` with what ``fn`` works out from a slice in a struct ``out``.

    The two structs keep added names apart from the columns of ``df``. ``columns``
    says which of them to carry (all by default).
    """
    kept = df.columns if columns is None else columns
    row = F.struct(*[df[c] for c in kept]).alias("row")
    own = text in kept  # then the text is sent once, inside the row
    source = df.select(row) if own else df.select(row, df[text].alias("__text"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("out", added)])

    def run(batches):
        if own:
            batches = (pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), text)], ["row", "__text"]) for b in batches)
        for batch in slices(batches, "__text", limit):
            got = fn(batch)
            n = batch.num_rows
            out = pa.StructArray.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, type=arrow(f.dataType)) for f in added for v in [got[f.name]]],
                [f.name for f in added],
            )
            assert len(out) == n
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["row", "out"])
            give_back()

    return source.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another allocator than glibc's
        pass


def arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "double": pa.float64(), "float": pa.float32(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow(f.dataType)) for f in kind])
    return simple[kind.simpleString()]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read back."""
    return write_through(df, f"llm-{name}")


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of ``key``: the same ones on every run."""
    return df.orderBy(F.xxhash64(key), F.col(key)).limit(most)


def common_length(df: DataFrame, vector: str) -> int:
    """The most common length of an array; of equally common ones the longest; 0 without any."""
    sizes = df.select(F.size(df[vector]).alias("n")).filter("n > 0").groupBy("n").count()
    first = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return first.n if first else 0


def finite(vector: Column, dimension: int) -> Column:
    """The vector has the length and neither null nor non-finite components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) == dimension) & ~bad, F.lit(False))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column without nulls, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
