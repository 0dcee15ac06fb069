"""The corpus pipeline: filter by quality and language, drop near duplicates and repeated passages, pack into sequences.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again by the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.fertility import accepted, fit_floors
from panelwright.llm.language import fit_languages, held_out, recognised
from panelwright.llm.near import distinct_rows
from panelwright.llm.packing import pack_documents
from panelwright.llm.queries import vocabulary
from panelwright.llm.repeats import remove_repeats
from panelwright.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and lie in the fertility band of their language or script.

    Floors are fitted on the labelled rows where the folder has a table of labels.
    """
    path = vocabulary("piece_bpe_32k.model")
    try:
        labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return accepted(docs, path)
    return accepted(docs, path, floors=fit_floors(docs, labels, path))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model, learned from the stage's own labelled rows, recognises."""
    return recognised(docs, fit_languages(docs, ~held_out()))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (five words, similarity 0.8): that of least doc_id, rows without one last."""
    return distinct_rows(docs, size=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 50-byte strings that an earlier document has; ``n_chars`` follows the text that is left."""
    rows = remove_repeats(docs, as_text=True)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences and offsets."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
