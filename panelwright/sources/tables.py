"""Delimited and columnar sources and sinks. Text lands as strings and is coerced by one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import coerce_double, coerce_int
from ..functions.text import null_if_blank, strip_quotes, strip_quotes_upper
from ..operators.joins import semi_join_universe
from ..session import pinned

TRANCHE_COLUMNS = {
    "patent_id": "string",
    "appYear": "int",
    "gvkeyUO": "string",
    "gvkeyFR": "string",
    "clean_name": "string",
    "privateSubsidiary": "int",
    "grantYear": "int",
}


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths a glob matches on whatever file system the path belongs to, sorted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found is not None else []


def discover_tranches(
    spark: SparkSession, folder: str, full: str = "static.csv", parts: str = "staticTranche*.csv", prefer: str = "full"
) -> list[str]:
    """The one full file or the tranche files; ``prefer`` says which wins when both exist."""
    whole = matching_paths(spark, f"{folder}/{full}")
    pieces = matching_paths(spark, f"{folder}/{parts}")
    paths = (whole or pieces) if prefer == "full" else (pieces or whole)
    if not paths:
        raise FileNotFoundError(f"no table files found in {folder}")
    return paths


def coerce(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Select the named columns and try-cast each; text that does not parse becomes null."""
    casts: dict[str, Callable] = {"int": coerce_int, "double": coerce_double}
    return df.select(
        *[
            (casts[t](c) if t in casts else F.col(c).try_cast(t)).alias(c)
            for c, t in schema.items()
        ]
    )


def read_delimited(spark: SparkSession, paths: Sequence[str] | str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """All columns as text, bound by header name, with quotes and blanks stripped from the header."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    df = reader.option("multiLine", multi_line).csv(paths if isinstance(paths, str) else list(paths))
    return df.toDF(*[c.strip().strip('"') for c in df.columns])


def scan_tranches(
    spark: SparkSession,
    folder: str,
    schema: Mapping[str, str] = TRANCHE_COLUMNS,
    required: Sequence[str] = ("gvkeyUO", "appYear"),
    prefer: str = "full",
    full: str = "static.csv",
    parts: str = "staticTranche*.csv",
) -> DataFrame:
    """Chosen columns of one full file or of all tranches, without rows that miss a required value."""
    rows = read_delimited(spark, discover_tranches(spark, folder, full, parts, prefer))
    return coerce(rows, schema).dropna(subset=list(required))


def combine_tranches(spark: SparkSession, paths: Sequence[str], out: str, fmt: str = "csv") -> dict[str, int]:
    """Write all tranches as one dataset; rows are counted while they are written."""
    seen = Observation("combine")
    rows = read_delimited(spark, paths).observe(seen, F.count(F.lit(1)).alias("rows"))
    write_table(rows, out, fmt)
    return {"files": len(paths), "rows": seen.get["rows"]}


def clean_cells(df: DataFrame, key: str) -> DataFrame:
    """Blanks and quotes off every cell, the key in upper case."""
    return df.select(*[(strip_quotes_upper(c) if c == key else strip_quotes(c)).alias(c) for c in df.columns])


def scan_tsv_filtered(
    spark: SparkSession, path: str, columns: Sequence[str], universe: DataFrame, key: str
) -> DataFrame:
    """Chosen columns of a tab-separated file for keys of the universe."""
    rows = read_delimited(spark, path, sep="\t").select(*columns)
    return semi_join_universe(clean_cells(rows, key), universe, key)


def scan_parquet(spark: SparkSession, path: str, schema: Mapping[str, str] | None = None, upper: Sequence[str] = ()) -> DataFrame:
    """Columnar scan; blank text becomes null, listed columns become upper case, types are coerced."""
    df = spark.read.parquet(path)
    if schema is not None:
        df = df.select(*schema)
    text = {c: null_if_blank(c) for c, t in df.dtypes if t == "string"}
    df = df.withColumns({c: (F.upper(e) if c in upper else e) for c, e in text.items()}) if text else df
    return df if schema is None else coerce(df, schema)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """';' or ',', whichever is more frequent in the whole input; two totals reach the driver."""
    line = F.col("value")
    counts = [F.sum(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias(n) for c, n in ((";", "s"), (",", "c"))]
    total = spark.read.text(path).agg(*counts).first()
    return ";" if (total["s"] or 0) > (total["c"] or 0) else ","


_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the lines of each split to records. What began before the split or goes on behind it becomes a fragment.

    Lines come as (value, quotes, file, block, open): in order within a split, with whether its first line is inside quotes.
    """
    split, is_open, fresh, held = None, False, True, []
    out: list[tuple] = []

    def close():
        if split is not None and held:
            out.append((*split, _TAIL if fresh else _MIDDLE, "\n".join(held)))

    for batch in batches:
        values, quotes, files, blocks, opens = (c.to_pylist() for c in batch.columns)
        for value, n, file, block, start in zip(values, quotes, files, blocks, opens, strict=True):
            if split != (file, block):
                close()
                split, is_open, held = (file, block), start, []
                fresh = not start  # whether what is held began in this split
            held.append(value)
            is_open ^= n % 2 == 1
            if not is_open:
                out.append((*split, _WHOLE if fresh else _HEAD, "\n".join(held)))
                held, fresh = [], True
        if len(out) > 4096:
            yield _records(out)
            out = []
    close()
    yield _records(out)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "kind", "record"])


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``file``, ``block``, ``record``: the records of delimited files, in which quoted fields may hold line breaks.

    Files are read in splits, one large file by many tasks. Whether a split begins inside quotes follows from the number of
    quotes before it: they are counted by split, and a prefix sum over the splits, one small row each, carries the parity
    on. Each split then cuts its own records; only the fragments at its borders, two at most, meet again. A quote inside an
    unquoted field counts too, as the format does not allow one there.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).alias("quotes"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    starts = starts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("open"))
    marked = lines.join(F.broadcast(starts), ["file", "block"]).select("value", "quotes", "file", "block", "open")
    pieces = pinned(marked.mapInArrow(_cut_records, "file string, block long, kind int, record string"))
    whole = pieces.where(F.col("kind") == _WHOLE).select("file", "block", "record")
    ordered = W.partitionBy("file").orderBy("block", "kind")
    torn = pieces.where(F.col("kind") != _WHOLE).withColumn("nth", F.sum((F.col("kind") == _TAIL).cast("int")).over(ordered))
    mended = torn.groupBy("file", "nth").agg(
        F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda x: x["record"]), "\n")
    return whole.unionByName(mended.select("file", "block", joined.alias("record")))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Names in the first record of the first file."""
    first = matching_paths(spark, path)
    inside = [p for p in (matching_paths(spark, f"{first[0]}/[!_.]*") if first else [])]
    head = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True)
    return [c.strip().strip('"') for c in head.csv(inside[0] if inside else path).columns]


def normalize_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files of unknown delimiter with quoted line breaks, read in splits as text columns.

    Columns are those of the first file's header; the header record of each file is left out, and blank lines are.
    """
    sep = sniff_delimiter(spark, path)
    names = _header(spark, path, sep)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    record = F.regexp_replace("record", "\r$", "")
    rows = quoted_records(spark, path).where(F.trim(record) != "")
    parsed = rows.select(F.from_csv(record, schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"'}).alias("r"), "block")
    heading = F.lit(True)
    for i, n in enumerate(names):
        heading = heading & F.trim(F.col(f"r.c{i}"), F.lit(' "')).eqNullSafe(F.lit(n))
    cells = parsed.where(~((F.col("block") == 0) & heading)).select("r.*")
    return cells.toDF(*names)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """CSV, gzipped CSV or ZSTD Parquet; existing output is replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt in ("csv", "csv.gz"):
        codec = "gzip" if fmt == "csv.gz" else "none"
        writer.option("header", True).option("escape", '"').option("compression", codec).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def is_complete(spark: SparkSession, path: str) -> bool:
    return bool(matching_paths(spark, f"{path.rstrip('/')}/_SUCCESS"))


def reuse_stage(
    spark: SparkSession, paths: Mapping[str, str], build: Callable[[], Mapping[str, DataFrame]], reuse: bool = True
) -> dict[str, DataFrame]:
    """Stage outputs from disk if every one was completed, else built and written first."""
    if not (reuse and all(is_complete(spark, p) for p in paths.values())):
        for name, frame in build().items():
            write_table(frame, paths[name])
    return {name: spark.read.parquet(p) for name, p in paths.items()}
