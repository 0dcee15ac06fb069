"""Shared parts of the text operators: rows of Arrow batches as bytes, cached values of words, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Entries a worker's cache holds before it starts anew; it bounds memory and changes no result.
CACHE_ENTRIES = 400_000
#: Bytes of text in a slice that keeps all columns beside what is found: it is held twice, on its way in and out.
SLICE_BESIDE = 2 << 20


class WordCache(dict):
    """Values of words. Missing words of a batch are computed together; a full cache keeps only the batch's own words."""

    def __init__(self, compute: Callable[[list], Iterable], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.limit = compute, limit

    def learn(self, words: set) -> None:
        new = [w for w in words if w not in self]
        if new and len(self) + len(new) > self.limit:
            kept = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(kept)
        self.update(zip(new, self.compute(new), strict=True))


class Memo(dict):
    """Values of words computed one by one; a full cache is emptied first."""

    def __init__(self, compute: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.compute(word)
        return value


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def pieces_of(batch: pa.RecordBatch, size: int = 8 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, so that a slice of long texts has few rows."""
    column = batch.column(batch.schema.get_field_index(name))
    start = total = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if i > start and total + (n or 0) > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def per_text(
    docs: DataFrame,
    columns: Sequence[str],
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows made from each slice of the named columns; ``make`` prepares a worker's state once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for part in pieces_of(batch, slice_bytes):
                yield pa.RecordBatch.from_pydict(one(part))

    return docs.select(*columns).mapInArrow(run, schema)


def beside(
    docs: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], name: str
) -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of what ``make`` finds from the named SQL expressions; no shuffle."""
    found = T._parse_datatype_string(schema)
    inputs = {f"{name}_{i}": F.expr(c) for i, c in enumerate(columns)}
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for part in pieces_of(batch, SLICE_BESIDE, f"{name}_1"):
                own = pa.RecordBatch.from_arrays(part.columns[width:], ["doc_id", "text", "lang"][: len(columns)])
                made = one(own)
                arrays = [made[f.name] for f in found.fields]
                struct = pa.StructArray.from_arrays(arrays, [f.name for f in found.fields])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], struct], [*part.schema.names[:width], name])

    out = T.StructType([*docs.schema.fields, T.StructField(name, found)])
    return docs.select("*", *[e.alias(n) for n, e in inputs.items()]).mapInArrow(run, out)


_SHARED: dict = {}


def once(slot: str, version, build: Callable):
    """A value kept in the Python worker across tasks. A worker holds one at a time, so that caches do not add up."""
    if slot not in _SHARED or _SHARED[slot][0] != version:
        _SHARED.clear()
        _SHARED[slot] = (version, build())
    return _SHARED[slot][1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back, for parts that several later steps read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def remainder(key, parts: int):
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))
