import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelwright.functions import evidence
from panelwright.operators import learning
from panelwright.session import scratch_path

GOOD = "sensor calibration with training data and cross validation experiment number{}"
BAD = "user interface receiving data over the network node item{}"


@pytest.fixture(scope="module")
def sample(spark):
    data = [(i, (GOOD if i % 2 else BAD).format(i % 7), i % 2) for i in range(160)]
    df = spark.createDataFrame(data, "patent_id int, text string, y int")
    return learning.hash_split(evidence.evidence_features(df, "text"), "patent_id")


def test_auc_with_ties_matches_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 10
    s[:100] = 0.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert learning.auc_exact(df, "y", "s").first()[0] == pytest.approx(pairs)
    grid = learning.threshold_grid()
    f1 = [2 * ((s >= t) & (y == 1)).sum() / max(1, (s >= t).sum() + (y == 1).sum()) for t in grid]
    best = learning.best_f1(df, "y", "s").first()
    assert best["best_f1"] == pytest.approx(max(f1)) and best["best_threshold"] == grid[int(np.argmax(f1))]


def test_balanced_sample_is_balanced_per_split(sample):
    picked = learning.balanced_sample(sample.where("patent_id % 3 > 0 or y = 1"), "patent_id", "y", "is_holdout", {False: 20, True: 1000})
    counts = {(r["is_holdout"], r["y"]): r["count"] for r in picked.groupBy("is_holdout", "y").count().collect()}
    assert counts[False, 0] == counts[False, 1] == 20 and counts[True, 0] == counts[True, 1]


def test_tfidf_rows_follow_the_smoothed_formula(spark):
    df = spark.createDataFrame([("alpha beta beta",), ("alpha gamma",), ("beta",)], "text string")
    model = learning.fit_vectorizer(df, "text", min_df=1, max_df=1.0)
    vocabulary = model.stages[3].vocabulary
    vector = learning.vectorize(model, df.limit(1)).first()["features"].toArray()
    idf = {w: np.log(4 / (1 + d)) + 1 for w, d in {"alpha": 2, "beta": 2, "alpha beta": 1, "beta beta": 1}.items()}
    raw = {"alpha": idf["alpha"], "beta": 2 * idf["beta"], "alpha beta": idf["alpha beta"], "beta beta": idf["beta beta"]}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    got = {w: vector[i] for i, w in enumerate(vocabulary) if vector[i]}
    assert got == pytest.approx({w: v / norm for w, v in raw.items()})


def test_model_separates_and_survives_saving(spark, sample):
    model, comparison = learning.fit_evidence_model(sample, "text", "y", "is_holdout", vocabulary=500, components=4)
    table = {r["method"]: r for r in comparison.collect()}
    assert table["hybrid_benchmark"]["auc"] > 0.99 and table["text_supervised"]["auc"] > 0.99
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = learning.EvidenceModel.load(spark, path)
    assert again.thresholds == model.thresholds
    columns = ["patent_id", "benchmark_score", "semantic_lsa_score", "text_supervised_score", "benchmark_flag"]
    a, b = (learning.score_texts(m, sample, "text").select(*columns).orderBy("patent_id").collect() for m in (model, again))
    assert np.allclose(np.array(a, float), np.array(b, float))
    assert {r["benchmark_flag"] for r in a} == {0, 1}


def test_semantic_score_matches_numpy(spark, sample):
    vectorizer = learning.fit_vectorizer(sample, "text", vocabulary=200)
    rows = learning.vectorize(vectorizer, sample).cache()
    # Two components: the data is symmetric beyond them, so further vectors are not unique.
    space = learning.fit_semantic_space(vectorizer, rows, "text", 2)
    x = np.array([r["features"].toArray() for r in rows.orderBy("patent_id").select("features").collect()])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs((space.basis * vt[:2].T).sum(axis=0)), 1, atol=1e-6)
    point = x @ space.basis
    cos = point / (np.linalg.norm(point, axis=1, keepdims=True) + 1e-9) @ (space.positive - space.negative)
    got = [r[0] for r in rows.orderBy("patent_id").select(space.similarity()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-2 * cos)))


def test_prototype_similarity(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "id int, v array<double>")
    out = learning.prototype_similarity(df, "v", df.where("id = 0"), df.where("id = 1"), "s").orderBy("id")
    want = [1 / (1 + np.exp(-2.0)), 1 / (1 + np.exp(2.0)), 0.5]
    assert [r["s"] for r in out.collect()] == pytest.approx(want, abs=1e-6)
    assert out.select(F.count("*")).first()[0] == 3


def test_vocabulary_breaks_ties_by_term_and_null_text_has_no_terms(spark):
    df = spark.createDataFrame([("bb aa",), ("cc bb aa",), ("é1 x",), (None,), ("",)], "text string")
    model = learning.fit_vectorizer(df, "text", vocabulary=3, min_df=1, max_df=1.0)
    assert learning.vocabulary_of(model) == ["aa", "bb", "bb aa"]
    sizes = [r["features"].numNonzeros() for r in learning.vectorize(model, df).collect()]
    assert sizes == [3, 3, 0, 0, 0]
    assert learning.vocabulary_of(learning.fit_vectorizer(df, "text", min_df=1, max_df=0.3)) == ["cc", "cc bb", "é1"]
    with pytest.raises(ValueError):
        learning.fit_vectorizer(df, "text", min_df=4)


def sparse_rows(spark, x, partitions):
    data = [(Vectors.sparse(x.shape[1], {int(j): float(row[j]) for j in np.flatnonzero(row)}),) for row in x]
    return spark.createDataFrame(data, ["features"]).repartition(partitions)


def test_leading_directions_match_numpy_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(learning, "TERMS_IN_BLOCK", 16)
    monkeypatch.setattr(learning, "FAN_IN", 3)
    monkeypatch.setattr(learning, "CELLS_MULTIPLIED", 50)
    rng = np.random.default_rng(5)
    left, right = (np.linalg.qr(rng.normal(size=(n, 60)))[0] for n in (150, 70))
    x = (left * 0.8 ** np.arange(60)) @ right.T
    x[np.abs(x) < 1e-4] = 0
    x[[3, 90]] = 0
    rows = sparse_rows(spark, x, 11)
    q = rng.normal(size=(70, 4))
    assert np.allclose(learning.gram_product(rows, "features", q), x.T @ (x @ q))
    found = learning.leading_directions(rows, "features", 70, 8, passes=8)
    vt = np.linalg.svd(x)[2]
    assert np.allclose(found.T @ found, np.eye(8)) and np.allclose(np.abs((found * vt[:8].T).sum(axis=0)), 1, atol=1e-6)
    whole = learning.leading_directions(rows, "features", 70, 70)
    assert np.allclose(whole @ whole.T, np.eye(70))


def test_optimality_tells_an_optimum_from_other_coefficients(spark, sample):
    vectorizer = learning.fit_vectorizer(sample, "text", vocabulary=50)
    rows = learning.vectorize(vectorizer, sample).cache()
    reg = 1e-3
    model = learning.fit_text_classifier(rows, "y", reg, max_iter=300, tol=1e-10)
    proof = {r["feature"]: r for r in learning.optimality(model, rows, "y", "features", reg).collect()}
    assert len(proof) == len(learning.vocabulary_of(vectorizer)) + 1
    assert max(abs(r["gradient"]) for r in proof.values()) < 1e-5
    # The same against numpy, for a model stopped early and judged under another penalty.
    early = learning.fit_text_classifier(rows, "y", reg, max_iter=2)
    got = {r["feature"]: r for r in learning.optimality(early, rows, "y", "features", 0.1).collect()}
    data = rows.select("features", "y").collect()
    x, y = np.array([r["features"].toArray() for r in data]), np.array([r["y"] for r in data], float)
    w = early.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + early.intercept)))
    want = ((p - y)[:, None] * x).mean(axis=0) + 0.1 * w
    assert np.allclose([got[i]["gradient"] for i in range(len(w))], want) and np.abs(want).max() > 1e-3
    assert got[-1]["gradient"] == pytest.approx((p - y).mean(), abs=1e-12)
    assert np.allclose([got[i]["observed"] for i in range(len(w))], (y[:, None] * x).mean(axis=0))
    # A dense column with a feature that is never set, and a row without a label.
    cells = [(0.1, 0), (0.4, 1), (0.3, 0), (0.9, 1)]
    dense = spark.createDataFrame([(Vectors.dense([a, 0.0]), b) for a, b in cells], ["features", "y"])
    small = learning.fit_text_classifier(dense, "y", 0.05, max_iter=300, tol=1e-12)
    unknown = dense.limit(1).withColumn("y", F.lit(None).cast("long"))
    proof = learning.optimality(small, dense.unionByName(unknown), "y", "features", 0.05)
    table = {r["feature"]: r for r in proof.collect()}
    assert table[0]["observed"] == pytest.approx(1.3 / 4) and abs(table[0]["gradient"]) < 1e-6 and table[1]["gradient"] == 0


def test_comparison_matches_numpy_for_every_method(spark, sample):
    model, comparison = learning.fit_evidence_model(sample, "text", "y", "is_holdout", vocabulary=60, components=4)
    held = learning.score_texts(model, sample.where("is_holdout"), "text").collect()
    y = np.array([r["y"] for r in held])
    names = {
        "dictionary": "dictionary_score", "metadata": "metadata_score", "semantic_lsa": "semantic_lsa_score",
        "text_supervised": "text_supervised_score", "hybrid_benchmark": "benchmark_score",
    }
    table = {r["method"]: r for r in comparison.collect()}
    assert set(table) == set(names)
    for method, column in names.items():
        s = np.array([r[column] for r in held])
        gap = s[y == 1][:, None] - s[y == 0]
        assert table[method]["auc"] == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())
        f1 = [2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + (y == 1).sum()) for t in learning.threshold_grid()]
        assert table[method]["best_f1"] == pytest.approx(max(f1))
