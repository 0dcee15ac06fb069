"""Weak-supervision models on Spark ML, and exact evaluation of scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.evidence import flag_and_confidence
from ..functions.numbers import sigmoid
from ..session import pinned, scratch_path
from .describe import id_hash
from .ranking import grouped_rank, running_totals

# Sentences that stand for evidence wording and for generic wording.
POSITIVE_PROTOTYPES = (
    "invention uses experimental evidence and validation benchmarks from observed data",
    "method relies on sensor measurements, calibration, and data quality verification",
    "algorithm trained on labeled training data and evaluated using cross validation",
    "empirical estimation and statistical inference based on observational data",
)
NEGATIVE_PROTOTYPES = (
    "generic computer implemented method for transmitting and storing data",
    "digital interface and network communication protocol without empirical testing",
    "mechanical structure and hardware arrangement with no data analysis",
)
STACK_FEATURES = ("dictionary_score", "metadata_score", "boilerplate_score", "text_supervised_score")
EPSILON = 1e-9


def hash_split(df: DataFrame, key: str, out: str = "is_holdout", buckets: int = 10, holdout_from: int = 8) -> DataFrame:
    """Repeatable split by a hash of the identifier."""
    return df.withColumn(out, id_hash(key) % buckets >= holdout_from)


def balanced_sample(df: DataFrame, key: str, label: str, split: str, caps: Mapping[bool, int]) -> DataFrame:
    """Per split, equally many rows of both classes, at most the cap, chosen by identifier hash.

    Ranks are exact and computed across the cluster, so one huge class does not end up in one task.
    """
    known = df.where(F.col(label).isNotNull())
    sizes = known.groupBy(split, label).agg(F.count("*").alias("n"))
    cap = F.when(F.col(split), caps[True]).otherwise(caps[False])
    take = sizes.groupBy(split).agg(F.min("n").alias("least"), F.count("*").alias("classes"))
    take = take.where("classes = 2").select(split, F.least("least", cap).alias("take"))
    keys = known.select(key, label, split, id_hash(key).alias("__h"))
    ranked = grouped_rank(keys, [split, label], ["__h", key], "__rank")
    chosen = ranked.join(take, split).where("__rank <= take").select(key)
    return known.join(chosen, key, "left_semi")


def term_stages(text: str) -> list[Transformer]:
    """Lower-case words of two or more characters, then single words and pairs together; null text has none."""
    words = rf"regexp_extract_all(lower(coalesce(`{text}`, '')), r'(?U)\b\w\w+\b', 0)"
    return [
        SQLTransformer(statement=f"SELECT *, {words} AS __w1 FROM __THIS__"),
        NGram(n=2, inputCol="__w1", outputCol="__w2"),
        SQLTransformer(statement="SELECT *, concat(__w1, __w2) AS __terms FROM __THIS__"),
    ]


def term_counts(df: DataFrame, terms: str) -> DataFrame:
    """``term``, its occurrences and the rows that hold it, from one pass; tasks add up before the shuffle."""
    one, none = F.lit(1), F.lit(0)
    seen = F.transform(terms, lambda t: F.struct(t.alias("term"), one.alias("n"), none.alias("rows")))
    held = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), none.alias("n"), one.alias("rows")))
    cells = df.select(F.inline(F.concat(seen, held)))
    return cells.groupBy("term").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


SCRATCH = ("__w1", "__w2", "__terms", "__counts", "__weighted")


def fit_vectorizer(
    df: DataFrame, text: str, vocabulary: int = 80_000, min_df: float = 5, max_df: float = 0.97
) -> PipelineModel:
    """Smoothed TF-IDF with unit rows: count * (ln((1 + n) / (1 + df)) + 1), then length one.

    The vocabulary is the commonest terms, of equally common ones the least; ``min_df`` and ``max_df`` below one are
    shares of the rows, others counts, and a ``max_df`` of one sets no limit. Only the kept terms reach the driver.
    """
    stages = term_stages(text)
    n = df.count()
    least, most = (x if x >= 1 else x * n for x in (min_df, max_df if max_df != 1 else n + 1))
    counts = term_counts(PipelineModel(stages).transform(df), "__terms").where(F.col("rows").between(least, most))
    kept = counts.orderBy(F.desc("n"), "term").limit(vocabulary).collect()
    if not kept:
        raise ValueError("no term lies within the limits of document frequency")
    idf = [float(np.log((1 + n) / (1 + r["rows"])) + 1) for r in kept]
    counted = CountVectorizerModel.from_vocabulary([r["term"] for r in kept], inputCol="__terms", outputCol="__counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__counts", outputCol="__weighted")
    return PipelineModel([*stages, counted, scale, Normalizer(p=2.0, inputCol="__weighted", outputCol="features")])


def vocabulary_of(vectorizer: PipelineModel) -> list[str]:
    return next(s for s in vectorizer.stages if isinstance(s, CountVectorizerModel)).vocabulary


def vectorize(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop(*SCRATCH)


def reloaded(model, spark: SparkSession):
    """The model written to the shared folder and read back.

    A freshly fitted model carries its training summary and with it the session, which cannot always be shipped
    to tasks; the stored model holds the coefficients only.
    """
    path = scratch_path(spark, "fitted")
    model.write().save(path)
    return type(model).load(path)


#: Strength of the penalty of the text classifier.
TEXT_PENALTY = 2e-6


def fit_text_classifier(
    df: DataFrame, label: str, reg: float = TEXT_PENALTY, max_iter: int = 100, tol: float = 1e-7
) -> LogisticRegressionModel:
    """Logistic model on unit rows: least mean loss plus ``reg`` / 2 times the squared length of the coefficients.

    ``optimality`` tells how close a fit with these limits came; a smaller ``tol`` and more rounds bring it closer.
    """
    fitted = LogisticRegression(
        featuresCol="features", labelCol=label, regParam=reg, standardization=False, maxIter=max_iter, tol=tol,
        probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred",
    ).fit(df)
    return reloaded(fitted, df.sparkSession)


def optimality(model: LogisticRegressionModel, df: DataFrame, label: str, features: str, reg: float) -> DataFrame:
    """How far a logistic model is from the optimum of its own training rows, feature by feature.

    ``feature`` (its place; -1 is the intercept), ``coefficient``, ``observed`` (mean of label times feature) and
    ``gradient`` (mean of probability times feature less ``observed``, plus the penalty's part). The objective is strictly
    convex for ``reg`` above zero, so gradients of zero single out its only optimum. Rows are added up by feature across
    the cluster, first within each task; the coefficients come from the model. Rows without a label are left out.
    """
    spark = df.sparkSession
    raw = F.unwrap_udt(features)
    places = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    known = df.where(F.col(label).isNotNull())
    scored = positive_probability(model, known, "__q").select(
        F.col("__q"), F.col(label).cast("double").alias("__y"), places.alias("__at"), raw["values"].alias("__x")
    )
    cells = F.concat(
        F.array(F.struct(F.lit(-1).alias("feature"), F.lit(1.0).alias("x"))),
        F.zip_with("__at", "__x", lambda i, x: F.struct(i.alias("feature"), x.alias("x"))),
    )
    sums = scored.select("__q", "__y", F.inline(cells)).groupBy("feature").agg(
        F.sum(F.col("__y") * F.col("x")).alias("y"), F.sum((F.col("__q") - F.col("__y")) * F.col("x")).alias("r"),
        F.count("*").alias("n"),
    )
    rows = sums.where("feature = -1").select(F.col("n").alias("total"))
    weights = [(-1, float(model.intercept), 0.0)]
    weights += [(i, float(w), reg) for i, w in enumerate(model.coefficients.toArray())]
    coefficients = spark.createDataFrame(weights, "feature int, coefficient double, reg double")
    joined = coefficients.join(sums, "feature", "left").fillna(0.0, ["y", "r"]).crossJoin(F.broadcast(rows))
    return joined.select(
        "feature", "coefficient", (F.col("y") / F.col("total")).alias("observed"),
        (F.col("r") / F.col("total") + F.col("reg") * F.col("coefficient")).alias("gradient"),
    )


def positive_probability(model: Transformer, df: DataFrame, out: str) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("__p")[1])
    return scored.drop("__p", "__raw", "__pred")


#: Rows whose terms are gathered at once; bounds the memory of a batch.
ROWS_PROJECTED = 256


@dataclass
class SemanticSpace:
    """Right singular vectors and the unit mean vectors of the two prototype sets. Size is bounded by the
    vocabulary limit times the number of components, whatever the corpus."""

    basis: np.ndarray
    positive: np.ndarray
    negative: np.ndarray

    def similarity(self, features: str = "features") -> Column:
        """``sigmoid(2 (cos(x, positive) - cos(x, negative)))`` of a sparse feature vector."""
        shared = SparkSession.active().sparkContext.broadcast((self.basis, self.positive - self.negative))

        @F.pandas_udf("double")
        def project(indices: pd.Series, values: pd.Series) -> pd.Series:
            basis, direction = shared.value
            out = np.zeros(len(indices))
            for k in range(0, len(indices), ROWS_PROJECTED):
                some = indices.iloc[k : k + ROWS_PROJECTED]
                sizes = np.array([len(at) for at in some])
                filled = np.flatnonzero(sizes)
                if not len(filled):
                    continue
                at = np.concatenate([np.asarray(x, dtype=int) for x in some])
                w = np.concatenate([np.asarray(x, dtype=float) for x in values.iloc[k : k + ROWS_PROJECTED]])
                starts = (np.cumsum(sizes) - sizes)[filled]
                points = np.add.reduceat(w[:, None] * basis[at], starts, axis=0)
                out[k + filled] = points @ direction / (np.linalg.norm(points, axis=1) + EPSILON)
            return pd.Series(out)

        raw = F.unwrap_udt(features)
        return sigmoid(F.lit(2.0) * project(raw["indices"], raw["values"]))


#: Terms in one block of a product, how many partial blocks are added up at once, and the cells multiplied at once.
TERMS_IN_BLOCK, FAN_IN, CELLS_MULTIPLIED = 1024, 16, 65_536


def gram_product(vectors: DataFrame, features: str, q: np.ndarray) -> np.ndarray:
    """``X'X q`` for the sparse rows X of a vector column.

    Each task adds up its own rows and gives blocks of terms; blocks are added by a tree of exchanges, at most ``FAN_IN``
    of them in one group, so neither many tasks nor a common term burden one task. The driver receives a matrix of the
    shape of ``q``.
    """
    spark, (terms, width) = vectors.sparkSession, q.shape
    shared = spark.sparkContext.broadcast(q)
    cell = "block int, part int, body binary"

    def blocks(total: np.ndarray, touched: np.ndarray, part: int) -> pa.RecordBatch:
        ids = np.unique(np.flatnonzero(touched) // TERMS_IN_BLOCK)
        bodies = [total[b * TERMS_IN_BLOCK : (b + 1) * TERMS_IN_BLOCK].tobytes() for b in ids]
        columns = [pa.array(ids, pa.int32()), pa.array([part] * len(ids), pa.int32()), pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "part", "body"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, total, touched = shared.value, np.zeros((terms, width)), np.zeros(terms, bool)
        for batch in batches:
            ends = np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + CELLS_MULTIPLIED, side="right")))
                sizes = np.diff(ends[start:stop], prepend=done)
                at, x = (batch.column(i)[start:stop].flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
                points = np.add.reduceat(x[:, None] * basis[at], np.cumsum(sizes) - sizes, axis=0)
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                spread = x[order, None] * np.repeat(points, sizes, axis=0)[order]
                total[found] += np.add.reduceat(spread, first, axis=0)
                touched[found] = True
                start = stop
        yield blocks(total, touched, TaskContext.get().partitionId())

    def add(key: tuple, table: pa.Table) -> pa.Table:
        bodies = (np.frombuffer(b, float) for b in table.column("body").to_pylist())
        body = sum(bodies).tobytes()
        columns = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([body], pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "part", "body"])

    raw = F.unwrap_udt(features)
    sparse_rows = vectors.select(raw["indices"].alias("at"), raw["values"].alias("x")).where("size(at) > 0")
    parts = sparse_rows.rdd.getNumPartitions()
    partial = sparse_rows.mapInArrow(multiply, cell)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        level = partial.select("block", F.pmod("part", F.lit(parts)).alias("part"), "body")
        partial = level.groupBy("block", "part").applyInArrow(add, cell)
    out = np.zeros((terms, width))
    for r in partial.select("block", "body").collect():
        body = np.frombuffer(r["body"], float).reshape(-1, width)
        out[r["block"] * TERMS_IN_BLOCK :][: len(body)] += body
    shared.destroy()
    return out


def leading_directions(
    vectors: DataFrame, features: str, terms: int, components: int, passes: int = 6, spare: int = 10, seed: int = 7
) -> np.ndarray:
    """Right singular vectors of the rows by a randomised block range finder: a seeded sketch, a fixed number of passes.

    Each pass multiplies an orthonormal block, ``spare`` columns wider than asked for, by ``X'X``; the last one also gives
    the small matrix whose eigenvectors turn the block. A block as wide as the terms needs one pass only and is exact.
    """
    width = min(terms, components + spare)
    sketch = np.random.default_rng(seed).normal(size=(terms, width))
    q = np.linalg.qr(sketch)[0]
    for left in range(passes if width < terms else 1, 0, -1):
        product = gram_product(vectors, features, q)
        if left > 1:
            q = np.linalg.qr(product)[0]
    small = q.T @ product
    turn = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
    return q @ turn[:, : min(components, terms)]


def fit_semantic_space(
    vectorizer: PipelineModel,
    train: DataFrame,
    text: str,
    components: int = 128,
    positive: Sequence[str] = POSITIVE_PROTOTYPES,
    negative: Sequence[str] = NEGATIVE_PROTOTYPES,
    passes: int = 6,
) -> SemanticSpace:
    """Truncated SVD of the feature rows, and prototypes placed in the same space.

    A vocabulary with fewer terms than ``components`` gives as many components as terms; scores are then the cosines of
    the feature rows themselves.
    """
    spark = train.sparkSession
    basis = leading_directions(train, "features", len(vocabulary_of(vectorizer)), components, passes)
    sentences = [(i, s) for i, group in enumerate((positive, negative)) for s in group]
    placed = vectorize(vectorizer, spark.createDataFrame(sentences, f"side int, {text} string")).select("side", "features")
    sides: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for side, vector in placed.collect():
        sides[side].append(vector.toArray() @ basis)
    means = [np.mean(sides[s], axis=0) for s in (0, 1)]
    unit = [m / (np.linalg.norm(m) + EPSILON) for m in means]
    return SemanticSpace(basis, unit[0], unit[1])


def fit_stacker(df: DataFrame, label: str, features: Sequence[str] = STACK_FEATURES, tol: float = 1e-10) -> PipelineModel:
    """Logistic model on the component scores with unit inverse regularisation strength."""
    n = df.count()
    fitted = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="__stack"),
            LogisticRegression(
                featuresCol="__stack", labelCol=label, regParam=1.0 / n, standardization=False, maxIter=1000, tol=tol,
                probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__pred",
            ),
        ]
    ).fit(df)
    return reloaded(fitted, df.sparkSession)


@dataclass
class EvidenceModel:
    vectorizer: PipelineModel
    classifier: LogisticRegressionModel
    space: SemanticSpace
    stacker: PipelineModel
    thresholds: dict[str, float]

    def save(self, spark: SparkSession, path: str) -> None:
        self.vectorizer.write().overwrite().save(f"{path}/vectorizer")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.stacker.write().overwrite().save(f"{path}/stacker")
        vectors = [*self.space.basis, self.space.positive, self.space.negative]
        kinds = ["basis"] * len(self.space.basis) + ["positive", "negative"]
        rows = pd.DataFrame({"kind": kinds, "at": range(len(vectors)), "vector": [v.tolist() for v in vectors]})
        table = spark.createDataFrame(rows, "kind string, at int, vector array<double>")
        table.write.mode("overwrite").parquet(f"{path}/space")
        limits = spark.createDataFrame(sorted(self.thresholds.items()), "name string, value double")
        limits.write.mode("overwrite").parquet(f"{path}/thresholds")

    @staticmethod
    def load(spark: SparkSession, path: str) -> EvidenceModel:
        space = spark.read.parquet(f"{path}/space").toPandas().sort_values("at")
        pick = {k: np.array(g["vector"].tolist()) for k, g in space.groupby("kind")}
        limits = {r[0]: r[1] for r in spark.read.parquet(f"{path}/thresholds").collect()}
        return EvidenceModel(
            PipelineModel.load(f"{path}/vectorizer"),
            LogisticRegressionModel.load(f"{path}/classifier"),
            SemanticSpace(pick["basis"], pick["positive"][0], pick["negative"][0]),
            PipelineModel.load(f"{path}/stacker"),
            limits,
        )


def score_texts(model: EvidenceModel, features: DataFrame, text: str) -> DataFrame:
    """All model scores, flag and confidence on rows that already carry the transparent features."""
    vectors = vectorize(model.vectorizer, features)
    scored = positive_probability(model.classifier, vectors, "text_supervised_score")
    scored = scored.withColumn("semantic_lsa_score", model.space.similarity())
    final = positive_probability(model.stacker, scored, "benchmark_score").drop("__stack", "features")
    return final.withColumns(flag_and_confidence("benchmark_score", model.thresholds["benchmark_threshold"]))


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """One row with the element-wise mean of an array column, combined on the map side."""
    cells = df.select(F.posexplode(vector).alias("at", "x"))
    means = cells.groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def prototype_similarity(df: DataFrame, vector: str, positive: DataFrame, negative: DataFrame, out: str) -> DataFrame:
    """``sigmoid(2 (cos(x, p) - cos(x, n)))`` against the unit means of two sets of vectors."""
    placed = df.withColumns(
        {
            "__x": F.transform(F.col(vector), lambda v: v.cast("double")),
            "__p": mean_vector(positive, vector).scalar(),
            "__n": mean_vector(negative, vector).scalar(),
        }
    )

    def cosine(side: str) -> Column:
        norms = (F.sqrt(dot(F.col("__x"), F.col("__x"))) + EPSILON) * (F.sqrt(dot(F.col(side), F.col(side))) + EPSILON)
        return dot(F.col("__x"), F.col(side)) / norms

    return placed.withColumn(out, sigmoid(F.lit(2.0) * (cosine("__p") - cosine("__n")))).drop("__x", "__p", "__n")


def auc_exact(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from exact rank sums; ties share their average rank."""
    known = df.select(*by, F.col(label).alias("y"), F.col(score).cast("double").alias("s")).dropna()
    # One row per distinct score before anything is ordered, so runs of ties stay small.
    counts = known.groupBy(*by, "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ordered = running_totals(counts, [*by, "s"], {"upto": "n"})
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = ordered.groupBy(*by).agg(
        F.sum("pos").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"),
        F.sum(F.col("pos") * mean_rank).alias("rank_sum"),
        F.min(F.col("upto") - F.col("n")).alias("before"),
    )
    ranks = F.col("rank_sum") - F.col("p") * F.col("before")
    area = F.try_divide(ranks - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return sums.select(*by, area.alias("auc"))


def threshold_grid(low: float = 0.05, high: float = 0.95, steps: int = 91) -> list[float]:
    return [float(t) for t in np.linspace(low, high, steps)]


def f1_sweep(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """F1 at every threshold in one pass: rows are counted by how many thresholds they reach, then summed.

    The histogram has one row per threshold, so the window below it is bounded.
    """
    grid = list(thresholds or threshold_grid())
    known = df.select(*by, F.col(label).alias("y"), F.col(score).alias("s")).dropna()
    reached = sum((F.when(F.col("s") >= t, 1).otherwise(0) for t in grid), F.lit(0))
    counts = known.groupBy(*by, reached.alias("k")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(grid))))
    keys = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    filled = keys.select(*by, steps.alias("k")).join(counts, [*by, "k"], "left").fillna(0, ["pos", "neg"])
    whole = W.partitionBy(*by)
    above = whole.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    swept = filled.withColumns(
        {"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "p": F.sum("pos").over(whole)}
    )
    values = F.array(*[F.lit(t) for t in grid])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("tp") + F.col("fp")), F.lit(0.0))
    return swept.where("k > 0").select(*by, F.element_at(values, F.col("k")).alias("threshold"), f1.alias("f1"))


def best_f1(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Highest F1 and the lowest threshold that attains it."""
    swept = f1_sweep(df, label, score, thresholds, by)
    first = F.struct((-F.col("f1")).alias("m"), F.col("threshold"))
    return swept.groupBy(*by).agg(F.min_by("threshold", first).alias("best_threshold"), F.max("f1").alias("best_f1"))


def method_comparison(df: DataFrame, label: str, methods: Mapping[str, str]) -> DataFrame:
    """AUC, best F1 and its threshold for every scoring method, all methods in one pass."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("score")) for n, c in methods.items()]
    )
    long = df.select(label, F.inline(cells))
    auc = auc_exact(long, label, "score", ["method"])
    return auc.join(best_f1(long, label, "score", by=["method"]), "method")


def fit_evidence_model(
    sample: DataFrame, text: str, label: str, split: str, vocabulary: int = 80_000, min_df: float = 5, components: int = 128
) -> tuple[EvidenceModel, DataFrame]:
    """Fit on the non-holdout rows of a balanced sample; return the model and the holdout comparison."""
    sample = pinned(sample)
    train = sample.where(~F.col(split))
    vectorizer = fit_vectorizer(train, text, vocabulary, min_df)
    train_vectors = vectorize(vectorizer, train).persist()
    classifier = fit_text_classifier(train_vectors, label)
    space = fit_semantic_space(vectorizer, train_vectors, text, components)
    stacker = fit_stacker(positive_probability(classifier, train_vectors, "text_supervised_score"), label)
    model = EvidenceModel(vectorizer, classifier, space, stacker, {"benchmark_threshold": 0.5})
    holdout = pinned(score_texts(model, sample.where(F.col(split)), text))
    methods = {
        "dictionary": "dictionary_score",
        "metadata": "metadata_score",
        "semantic_lsa": "semantic_lsa_score",
        "text_supervised": "text_supervised_score",
        "hybrid_benchmark": "benchmark_score",
    }
    comparison = pinned(method_comparison(holdout, label, methods))
    limits = {r["method"]: r["best_threshold"] for r in comparison.collect()}
    train_vectors.unpersist()
    model.thresholds = {
        "benchmark_threshold": limits["hybrid_benchmark"],
        "dictionary_threshold": limits["dictionary"],
        "metadata_threshold": limits["metadata"],
    }
    return model, comparison
