"""Incremental scoring: by new input files, each scored once across any number of runs, or by numbered chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import global_rank
from ..sources.tables import is_complete, matching_paths

Scorer = Callable[[DataFrame], DataFrame]


def score_incremental(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    score: Scorer,
    out: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> None:
    """Score files that are new since the last run and stop.

    The checkpoint remembers finished files. A batch overwrites its own ``batch=<id>`` folder, so a batch that
    is repeated after a failure replaces its rows instead of adding them again.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    query = (
        reader.load(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_scored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out.rstrip('/')}/batch=*").drop("batch")


# Chunks with addresses: any range can be scored again, in any order, and what counts is the last completed run of each.


def number_chunks(df: DataFrame, order: Sequence[str], chunk_rows: int, path: str) -> DataFrame:
    """The rows under ``path`` by ``chunk``: stable numbers from 1, ``chunk_rows`` rows each in the stated total order.

    Written once and reused if it is complete, so that a range means the same rows in every run.
    """
    if not is_complete(df.sparkSession, path):
        chunk = (F.floor((F.col("__rank") - 1) / chunk_rows) + 1).cast("int")
        numbered = global_rank(df, list(order), "__rank").withColumn("chunk", chunk).drop("__rank")
        numbered.write.mode("overwrite").partitionBy("chunk").parquet(path)
    return df.sparkSession.read.parquet(path)


def score_chunks(chunks: DataFrame, score: Scorer, out: str, first: int = 1, last: int | None = None) -> int:
    """Score the chunks from ``first`` to ``last`` and commit them; returns the number of the run.

    ``score`` keeps the column ``chunk``. Rows go to a folder of this run; the run counts once its manifest is complete,
    which lists the chunks it has scored, empty ones too. A run that fails leaves nothing that is read.
    """
    spark, out = chunks.sparkSession, out.rstrip("/")
    wanted = chunks.where(F.col("chunk") >= first)
    wanted = wanted if last is None else wanted.where(F.col("chunk") <= last)
    done = [int(p.rsplit("=", 1)[1]) for p in matching_paths(spark, f"{out}/scored/run=*")]
    run = max(done, default=0) + 1
    score(wanted).write.parquet(f"{out}/scored/run={run}")
    listed = wanted.select("chunk").distinct().join(
        spark.read.parquet(f"{out}/scored/run={run}").groupBy("chunk").agg(F.count("*").alias("rows")), "chunk", "left"
    )
    listed.fillna(0, ["rows"]).write.parquet(f"{out}/manifest/run={run}")
    return run


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """``chunk``, ``run``, ``rows``: of each chunk the last completed run and how many rows that gave."""
    out = out.rstrip("/")
    done = [p for p in matching_paths(spark, f"{out}/manifest/run=*") if is_complete(spark, p)]
    if not done:
        return spark.createDataFrame([], "chunk int, run int, rows long")
    listed = spark.read.option("basePath", f"{out}/manifest").parquet(*done)
    return listed.groupBy("chunk").agg(F.max("run").alias("run"), F.max_by("rows", "run").alias("rows"))


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The scored rows of every chunk's last completed run."""
    out, current = out.rstrip("/"), manifest(spark, out).select("chunk", "run")
    done = [p for p in matching_paths(spark, f"{out}/scored/run=*") if is_complete(spark, p)]
    rows = spark.read.option("basePath", f"{out}/scored").parquet(*done)
    return rows.join(current, ["chunk", "run"], "left_semi").drop("run")


def chunk_diagnostics(spark: SparkSession, out: str, score: str, threshold: float) -> DataFrame:
    """One row from the output alone: chunks, rows, mean score, and the share of rows at or above the threshold."""
    totals = manifest(spark, out).agg(
        F.count("*").alias("n_chunks"), F.max("chunk").alias("last_chunk"), F.sum("rows").alias("n_listed")
    )
    scored = read_chunks(spark, out).agg(
        F.count("*").alias("n_rows"),
        F.avg(score).alias("mean_score"),
        F.avg((F.col(score) >= threshold).cast("int")).alias("share_above"),
    )
    one = F.lit(1).alias("__one")
    return totals.select("*", one).join(scored.select("*", one), "__one").drop("__one")
