"""The registered queries of this subpackage: each applies one operator to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_and_decode
from .collocations import collocations
from .counts import token_counts
from .fertility import fit_floors, judge
from .language import fit_languages, held_out, predict_languages
from .near import near_duplicates
from .nearest import search
from .packing import pack_documents
from .pivots import top_k
from .quality import fit_quality, score_quality
from .repeats import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .trees import held_out as held_out_fifth
from .whitening import whiten
from .words import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Queries that SQL can express; the others are tested against brute force.
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def vocabulary(name: str) -> str:
    """A file of the public tokenizers installed beside this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = encode_and_decode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        held_out_fifth().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return _scored(score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels"))), 0.5)


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")
    return judge(docs, path, floors=fit_floors(docs, table(spark, folder, "labels"), path))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return _scored(score_quality(docs, fit_quality(docs, table(spark, folder, "labels"))), 0.3)


@query
def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = predict_languages(docs, fit_languages(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op11_exact_top_k"] = """
WITH finite AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM finite q JOIN finite c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), components=32)


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), least=30, covered=80, top=2000)


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
    FROM documents WHERE text IS NOT NULL)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), counts AS (
  SELECT lang, g, count(*) AS f FROM (
    SELECT lang, list_slice(w, i, i + k - 1) AS g
    FROM pieces, LATERAL unnest(range(1, len(w) + 1)) AS x(i), unnest(range(1, 5)) AS y(k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, g HAVING count(*) >= 30
), covers AS (
  SELECT lang, list_slice(g, i, i + k - 1) AS g, max(f) AS longer
  FROM counts, LATERAL unnest(range(1, len(g) + 1)) AS x(i), unnest(range(2, 4)) AS y(k)
  WHERE i + k - 1 <= len(g) AND k < len(g) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, list_slice(c.g, 1, k) AS first, list_slice(c.g, k + 1, len(c.g)) AS rest
  FROM counts c LEFT JOIN covers v ON c.lang = v.lang AND c.g = v.g, LATERAL unnest(range(1, len(c.g))) AS x(k)
  WHERE v.longer IS NULL OR 100 * CAST(v.longer AS HUGEINT) < 80 * CAST(c.f AS HUGEINT)
), scored AS (
  SELECT c.lang, c.g, a, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score,
    k FROM cuts c JOIN counts l ON c.lang = l.lang AND c.first = l.g JOIN counts r ON c.lang = r.lang AND c.rest = r.g
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
