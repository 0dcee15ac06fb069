"""Weak supervision, evaluation and incremental scoring over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence
from ..operators import learning
from ..session import pinned, scratch_path
from ..sources import tables
from ..streaming import incremental
from .base import Tables, query, rounded
from .scalars import DOC_FLAGS, PATTERNS, SCORES_SQL

MD5_SQL = "('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT"


@query("hash_split", f"SELECT doc_id, {MD5_SQL} % 10 >= 8 AS is_holdout FROM documents")
def _hash_split(t: Tables) -> DataFrame:
    return learning.hash_split(t.documents, "doc_id").select("doc_id", "is_holdout")


@query(
    "balanced_sample",
    f"""
    WITH x AS (SELECT doc_id, quality, {MD5_SQL} AS h, {MD5_SQL} % 10 >= 8 AS is_holdout FROM labels),
    r AS (SELECT *, row_number() OVER (PARTITION BY is_holdout, quality ORDER BY h, doc_id) AS rn FROM x),
    s AS (SELECT is_holdout, min(n) AS n FROM (SELECT is_holdout, quality, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1)
    SELECT doc_id, quality, is_holdout FROM r JOIN s USING (is_holdout)
    WHERE rn <= least(n, CASE WHEN is_holdout THEN 30 ELSE 90 END)
    """,
)
def _balanced_sample(t: Tables) -> DataFrame:
    rows = learning.hash_split(t.labels, "doc_id")
    return learning.balanced_sample(rows, "doc_id", "quality", "is_holdout", {False: 90, True: 30}).select(
        "doc_id", "quality", "is_holdout"
    )


@query(
    "prototype_similarity",
    """
    WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    p AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM c WHERE label = 0 GROUP BY 1)),
    n AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM c WHERE label = 1 GROUP BY 1)),
    e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    s AS (SELECT vec_id,
            list_dot_product(x, p.v) / ((sqrt(list_dot_product(x, x)) + 1e-9) * (sqrt(list_dot_product(p.v, p.v)) + 1e-9)) AS a,
            list_dot_product(x, n.v) / ((sqrt(list_dot_product(x, x)) + 1e-9) * (sqrt(list_dot_product(n.v, n.v)) + 1e-9)) AS b
          FROM e, p, n)
    SELECT vec_id, round(1 / (1 + exp(-2 * (a - b))), 9) AS semantic_score FROM s
    """,
)
def _prototype_similarity(t: Tables) -> DataFrame:
    e = t.embeddings
    out = learning.prototype_similarity(e, "embedding", e.where("label = 0"), e.where("label = 1"), "semantic_score")
    return rounded(out.select("vec_id", "semantic_score"), 9)


GRADED = """
    SELECT l.doc_id, l.quality, least(floor(d.n_chars / 50) / 100, 1.0) AS score
    FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""


@query(
    "auc_exact",
    f"""
    WITH x AS (SELECT quality AS y, score AS s FROM ({GRADED})),
    r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS k FROM x),
    c AS (SELECT sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q, sum(y * k) AS rs FROM r)
    SELECT round((rs - p * (p + 1) / 2) / (p * q), 10) AS auc FROM c
    """,
)
def _auc_exact(t: Tables) -> DataFrame:
    return rounded(learning.auc_exact(t.sql(GRADED), "quality", "score"), 10)


GRID_SQL = ", ".join(f"({x!r}::DOUBLE)" for x in learning.threshold_grid())


@query(
    "f1_sweep",
    f"""
    WITH x AS (SELECT quality AS y, score AS s FROM ({GRADED})),
    g AS (SELECT t, sum(CASE WHEN s >= t AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s >= t AND y = 0 THEN 1 ELSE 0 END) AS fp,
                 sum(y) AS p FROM x, (VALUES {GRID_SQL}) AS v(t) GROUP BY 1),
    f AS (SELECT t, coalesce(2 * tp / nullif(p + tp + fp, 0), 0.0) AS f1 FROM g)
    SELECT round(t, 6) AS best_threshold, round(f1, 10) AS best_f1 FROM f ORDER BY f1 DESC, t LIMIT 1
    """,
)
def _f1_sweep(t: Tables) -> DataFrame:
    best = learning.best_f1(t.sql(GRADED), "quality", "score")
    return best.select(F.round("best_threshold", 6).alias("best_threshold"), F.round("best_f1", 10).alias("best_f1"))


@query(
    "score_flags",
    """
    SELECT patent_id, CASE WHEN metadata_score >= 0.35 THEN 1 ELSE 0 END AS benchmark_flag,
           round(abs(metadata_score - 0.5) * 2, 9) AS benchmark_confidence
    FROM {scored}
    """,
)
def _score_flags(t: Tables) -> DataFrame:
    scored = t.view("scored").select("patent_id", "metadata_score")
    columns = evidence.flag_and_confidence("metadata_score", 0.35)
    return rounded(scored.select("patent_id", *[c.alias(n) for n, c in columns.items()]), 9)


def labelled_features(t: Tables) -> DataFrame:
    """Features of all documents with the known quality label and the hash split."""
    features = evidence.evidence_features(t.sql(DOC_FLAGS), "text", PATTERNS)
    return learning.hash_split(features.join(t.labels.select("doc_id", "quality"), "doc_id", "left"), "doc_id")


def training_sample(t: Tables) -> DataFrame:
    """``labelled_features`` of a balanced sample; texts are matched against the patterns once they are chosen."""
    caps = {False: 120_000, True: 30_000}
    labelled = learning.hash_split(t.sql(DOC_FLAGS).join(t.labels.select("doc_id", "quality"), "doc_id", "left"), "doc_id")
    chosen = learning.balanced_sample(labelled, "doc_id", "quality", "is_holdout", caps)
    return evidence.evidence_features(chosen, "text", PATTERNS).select(*labelled_features(t).columns)


#: Terms of the models that are compared with SQL; as many components make the semantic space exact.
TERMS = 256

TRAIN_SQL = f"""
    x AS (SELECT doc_id, quality, {MD5_SQL} AS h FROM {{labels}} JOIN (SELECT doc_id FROM {{documents}}) USING (doc_id)
          WHERE {MD5_SQL} % 10 < 8 AND quality IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS rn FROM x),
    train AS (SELECT doc_id, quality FROM r
              WHERE rn <= (SELECT least(min(n), 120000) FROM (SELECT count(*) AS n FROM x GROUP BY quality)))
"""


def terms_sql(texts: str) -> str:
    """Counts of single words and pairs in the rows ``(id, text)``."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')"
    return f"""(
      WITH s AS (SELECT id, {words} AS w FROM ({texts})),
      v AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM s)
      SELECT id, term, count(*) AS c FROM (
        SELECT id, term FROM v UNION ALL SELECT id, a.term || ' ' || b.term FROM v a JOIN v b USING (id) WHERE b.i = a.i + 1)
      GROUP BY ALL)"""


def unit_sql(counts: str) -> str:
    """Unit TF-IDF rows of term counts."""
    return f"""(SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x
                FROM (SELECT id, term, c * idf AS w FROM {counts} JOIN vocab USING (term)))"""


VOCABULARY_SQL = f"""
    {TRAIN_SQL},
    tf AS (SELECT * FROM {terms_sql('SELECT doc_id AS id, text FROM {documents}')}),
    vocab AS (
      SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf
      FROM tf JOIN train ON id = doc_id, (SELECT count(*) AS n FROM train)
      GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.97::DOUBLE * any_value(n) ORDER BY sum(c) DESC, term LIMIT {TERMS})
"""


def vectors(t: Tables) -> tuple:
    train = pinned(training_sample(t)).where("not is_holdout")
    vectorizer = learning.fit_vectorizer(train, "text", TERMS)
    return vectorizer, learning.vectorize(vectorizer, train).persist()


def certified(optimality: DataFrame, names: list[str], column: str) -> DataFrame:
    """Features by name; the gradient of an optimum rounds to zero."""
    table = F.array(*[F.lit(n) for n in names])
    name = F.when(F.col("feature") < 0, "(intercept)").otherwise(F.get(table, F.col("feature")))
    return optimality.select(name.alias(column), F.round("observed", 9).alias("observed"), F.round("gradient", 5).alias("gradient"))


@query(
    "fit_text_classifier",
    f"""
    WITH {VOCABULARY_SQL}, u AS (SELECT * FROM {unit_sql('tf')} JOIN train ON id = doc_id)
    SELECT term, round(coalesce(sum(x * quality), 0) / (SELECT count(*) FROM train), 9) AS observed, 0.0::DOUBLE AS gradient
    FROM vocab LEFT JOIN u USING (term) GROUP BY term
    UNION ALL SELECT '(intercept)', round(avg(quality), 9), 0.0 FROM train
    """,
)
def _fit_text_classifier(t: Tables) -> DataFrame:
    vectorizer, train = vectors(t)
    classifier = learning.fit_text_classifier(train, "quality", max_iter=500, tol=1e-10)
    proof = learning.optimality(classifier, train, "quality", "features", learning.TEXT_PENALTY)
    return certified(proof, learning.vocabulary_of(vectorizer), "term")


def sentences_sql() -> str:
    sides = (learning.POSITIVE_PROTOTYPES, learning.NEGATIVE_PROTOTYPES)
    return ", ".join(f"({100 * side + i}, '{s}')" for side, group in enumerate(sides) for i, s in enumerate(group))


@query(
    "fit_semantic_space",
    f"""
    WITH {VOCABULARY_SQL}, u AS (SELECT * FROM {unit_sql('tf')}),
    ptf AS (SELECT * FROM {terms_sql('SELECT id, text FROM (VALUES ' + sentences_sql() + ') AS s(id, text)')}),
    m AS (SELECT id // 100 AS side, term,
                 sum(x) / CASE WHEN id < 100 THEN {len(learning.POSITIVE_PROTOTYPES)} ELSE {len(learning.NEGATIVE_PROTOTYPES)} END AS x
          FROM {unit_sql('ptf')} GROUP BY 1, 2, id < 100),
    p AS (SELECT term, sum(CASE WHEN side = 0 THEN x ELSE -x END / (norm + 1e-9)) AS d
          FROM m JOIN (SELECT side, sqrt(sum(x * x)) AS norm FROM m GROUP BY side) USING (side) GROUP BY term),
    s AS (SELECT id, sum(x * d) / (sqrt(sum(x * x)) + 1e-9) AS c FROM u LEFT JOIN p USING (term) GROUP BY id)
    SELECT doc_id, round(1 / (1 + exp(-2 * coalesce(c, 0))), 6) AS semantic_lsa_score FROM {{documents}} LEFT JOIN s ON id = doc_id
    """,
)
def _fit_semantic_space(t: Tables) -> DataFrame:
    vectorizer, train = vectors(t)
    space = learning.fit_semantic_space(vectorizer, train, "text", TERMS)
    placed = learning.vectorize(vectorizer, t.documents.select("doc_id", F.lower("text").alias("text")))
    return placed.select("doc_id", F.round(space.similarity(), 6).alias("semantic_lsa_score"))


@query(
    "fit_stacker",
    f"""
    WITH {TRAIN_SQL},
    f AS (SELECT quality, dictionary_score, boilerplate_score,
                 1 / (1 + exp(1.2 - 1.2 * has_measurement_cpc - 0.9 * has_data_processing_cpc)) AS metadata_score
          FROM train JOIN ({SCORES_SQL}) USING (doc_id) JOIN ({DOC_FLAGS}) USING (doc_id))
    SELECT feature, round(observed, 9) AS observed, 0.0::DOUBLE AS gradient FROM (
      SELECT 'dictionary_score' AS feature, avg(quality * dictionary_score) AS observed FROM f
      UNION ALL SELECT 'metadata_score', avg(quality * metadata_score) FROM f
      UNION ALL SELECT 'boilerplate_score', avg(quality * boilerplate_score) FROM f
      UNION ALL SELECT 'text_supervised_score', NULL
      UNION ALL SELECT '(intercept)', avg(quality) FROM f)
    """,
)
def _fit_stacker(t: Tables) -> DataFrame:
    _, train = vectors(t)
    classifier = learning.fit_text_classifier(train, "quality")
    scored = pinned(learning.positive_probability(classifier, train, "text_supervised_score").drop("features"))
    stacker = learning.fit_stacker(scored, "quality")
    stack = stacker.stages[0].transform(scored)
    proof = certified(
        learning.optimality(stacker.stages[1], stack, "quality", "__stack", 1.0 / scored.count()),
        list(learning.STACK_FEATURES), "feature",
    )
    # What the text model contributes is no sum that SQL can give.
    known = F.when(F.col("feature") != "text_supervised_score", F.col("observed"))
    return proof.withColumn("observed", known)


def fitted(t: Tables) -> tuple[learning.EvidenceModel, DataFrame]:
    return learning.fit_evidence_model(training_sample(t), "text", "quality", "is_holdout", components=32)


@query("method_comparison")
def _method_comparison(t: Tables) -> DataFrame:
    return rounded(fitted(t)[1], 6)


@query("score_patents")
def _score_patents(t: Tables) -> DataFrame:
    model, _ = fitted(t)
    scored = learning.score_texts(model, labelled_features(t), "text")
    return rounded(scored.drop("text"), 6)


@query("save_load_model", "SELECT count(*) AS n, count(*) AS n_equal FROM documents")
def _save_load_model(t: Tables) -> DataFrame:
    model, _ = fitted(t)
    path = scratch_path(t.spark, "model")
    model.save(t.spark, path)
    again = learning.EvidenceModel.load(t.spark, path)
    features = labelled_features(t)
    a = learning.score_texts(model, features, "text").select("doc_id", F.col("benchmark_score").alias("fresh"))
    b = learning.score_texts(again, features, "text").select("doc_id", F.col("benchmark_score").alias("loaded"))
    return a.join(b, "doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("fresh") - F.col("loaded")) < 1e-9).alias("n_equal")
    )


@query(
    "score_incremental",
    f"""SELECT doc_id, round(dictionary_score, 9) AS dictionary_score, round(boilerplate_score, 9) AS boilerplate_score
        FROM ({SCORES_SQL})""",
)
def _score_incremental(t: Tables) -> DataFrame:
    source, out, checkpoint = (scratch_path(t.spark, x) for x in ("stream-in", "stream-out", "stream-state"))

    def score(batch: DataFrame) -> DataFrame:
        low = batch.select("doc_id", F.lower("text").alias("text"))
        scored = evidence.saturating_scores(evidence.regex_hits(low, "text", PATTERNS))
        return scored.select("doc_id", "dictionary_score", "boilerplate_score")

    docs = t.documents.select("doc_id", "text", "lang")
    # Two runs over a folder that grows in between give what one run over everything gives.
    for part in (docs.where("lang = 'en'"), docs.where("lang <> 'en' OR lang IS NULL")):
        part.write.mode("append").parquet(source)
        incremental.score_incremental(t.spark, source, docs.schema, score, out, checkpoint)
    return rounded(incremental.read_scored(t.spark, out), 9)


CHUNKED_SQL = f"""
    SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 128 + 1 AS INT) AS chunk,
           round(dictionary_score, 9) AS dictionary_score, round(boilerplate_score, 9) AS boilerplate_score FROM ({SCORES_SQL})
"""


def scored_chunks(t: Tables) -> str:
    """All documents scored in ranges of chunks that overlap, come out of order and repeat."""
    source, out = scratch_path(t.spark, "chunks"), scratch_path(t.spark, "chunk-scores")

    def score(rows: DataFrame) -> DataFrame:
        low = rows.select("doc_id", "chunk", F.lower("text").alias("text"))
        scored = evidence.saturating_scores(evidence.regex_hits(low, "text", PATTERNS))
        return scored.select("doc_id", "chunk", "dictionary_score", "boilerplate_score")

    chunks = incremental.number_chunks(t.documents.select("doc_id", "text"), ["doc_id"], 128, source)
    for first, last in ((3, None), (1, 4), (2, 2)):
        incremental.score_chunks(chunks, score, out, first, last)
    return out


@query("score_chunk_ranges", CHUNKED_SQL)
def _score_chunk_ranges(t: Tables) -> DataFrame:
    out = incremental.read_chunks(t.spark, scored_chunks(t))
    return rounded(out.select("doc_id", "chunk", "dictionary_score", "boilerplate_score"), 9)


@query(
    "score_chunk_diagnostics",
    f"""
    SELECT count(DISTINCT chunk) AS n_chunks, max(chunk) AS last_chunk, count(*) AS n_listed, count(*) AS n_rows,
           round(avg(dictionary_score), 6) AS mean_score, round(count_if(dictionary_score >= 0.15) / count(*), 6) AS share_above
    FROM ({CHUNKED_SQL})
    """,
)
def _score_chunk_diagnostics(t: Tables) -> DataFrame:
    return rounded(incremental.chunk_diagnostics(t.spark, scored_chunks(t), "dictionary_score", 0.15), 6)


@query(
    "reuse_stage",
    """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1
    """,
)
def _reuse_stage(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stage")

    def build():
        return {
            "totals": t.orders.groupBy("o_custkey").agg(
                F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("price")
            )
        }

    def fail():
        raise AssertionError("a complete stage must not be rebuilt")

    tables.reuse_stage(t.spark, {"totals": path}, build)
    return tables.reuse_stage(t.spark, {"totals": path}, fail)["totals"]
