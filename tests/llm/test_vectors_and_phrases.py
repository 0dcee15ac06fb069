"""Exact search, whitening and collocations against brute force, on tables with nulls, ties, repeats and hot rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")

from panelwright.llm import collocations, pivots, vectors, whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<double>"


def is_query():
    return F.col("vec_id") % 20 == 0


def odd_rows(rows):
    """Rows that take no part, and rows that repeat a key or a vector."""
    width = len(rows[0][1])
    left_out = [(9000, None), (9020, []), (9040, [float("nan")] * width), (9060, [1.0]), (9080, [None] * width)]
    left_out += [(9100, [float("inf")] + [0.0] * (width - 1)), (9120, [1e300] * width)]
    return rows + left_out + [(None, rows[0][1]), (9140, [0.0] * width), (20, rows[3][1]), (20, rows[0][1])]


def whole(rows, width):
    good = [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and abs(c) < 2.0**52 for c in v)]
    return [(i, [int(np.floor(64 * c)) for c in v]) for i, v in good]


# Exact search


def nearest(rows, k=20):
    rows = [(i, x) for i, x in rows if i is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.int64)
    lists = []
    for a in np.flatnonzero(ids % 20 == 0):
        score = x @ x[a]
        order = [b for b in np.lexsort((ids, -score)) if b != a][:k]
        lists += [(int(ids[a]), r + 1, int(ids[b]), int(score[b])) for r, b in enumerate(order)]
    return sorted(lists)


def vector_cases():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    near = (centres[r.integers(0, 20, 1500)] + 0.1 * r.normal(size=(1500, 16))) * r.uniform(0.1, 3, (1500, 1))
    near[100:600] = near[100]  # a third of all rows are one vector
    near[700:1100] = near[700] + 1e-3 * r.normal(size=(400, 16))
    yield "clustered", near
    yield "isotropic", r.normal(size=(700, 16))
    yield "tied", r.integers(-1, 2, size=(700, 16)) / 64.0
    yield "few", r.normal(size=(9, 16))


@pytest.mark.parametrize(("name", "data"), list(vector_cases()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("sizes", [{}, {"block_rows": 100, "query_rows": 7, "sample_rows": 300}])
def test_top_k_is_exact(spark, name, data, sizes):
    rows = odd_rows([(i, [float(c) for c in v]) for i, v in enumerate(data)])
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit(1) for c in ("x", "key", "ring", "found")})
    got = sorted(tuple(r) for r in pivots.top_k(df, is_query(), **sizes).collect())
    assert got == nearest(whole(rows, 16))


def test_top_k_of_nothing_and_of_large_numbers(spark):
    assert pivots.top_k(spark.createDataFrame([], VECTORS), is_query()).count() == 0
    r = np.random.default_rng(2)
    rows = [(i, [float(c) * 2.0**20 for c in r.normal(size=3)]) for i in range(60)]  # products beyond 2 ** 53
    got = sorted(tuple(x) for x in pivots.top_k(spark.createDataFrame(rows, VECTORS), is_query()).collect())
    assert got == nearest(whole(rows, 3))
    with pytest.raises(OverflowError):
        pivots.top_k(spark.createDataFrame([(0, [2.0**40])], VECTORS), is_query())


def test_rings_bound_their_scores():
    r = np.random.default_rng(3)
    x = r.integers(-90, 90, (500, 8)).astype(float)
    longest = int((x * x).sum(axis=1).max())
    index = pivots.fit_pivots(x[:200], longest, 90, 7, 0.05)
    ring, distance = index.key(x)
    index.cell = np.searchsorted(index.first_ring, np.arange(index.first_ring[-1]), side="right") - 1
    index.low, index.high = (np.array([f(distance[ring == k], initial=s) for k in range(len(index.cell))]) for f, s in ((np.min, 1e9), (np.max, 0)))
    bounds = index.ring_bounds(x[:50])
    assert len(index.cell) > 7
    assert (bounds[:, ring] >= x[:50] @ x.T).all()


# Whitening


@pytest.mark.parametrize("case", ["isotropic", "clustered", "repeated", "flat", "wide"])
def test_axes_equal_a_full_decomposition(case):
    r = np.random.default_rng(4)
    turn = np.linalg.qr(r.normal(size=(40, 40)))[0]
    cov = {
        "isotropic": np.cov(r.normal(size=(40, 5000))),
        "clustered": (turn * (1 + 1e-9 * np.arange(40))) @ turn.T,
        "repeated": (turn * np.repeat([5, 3, 1, 1e-3], 10)) @ turn.T,
        "flat": (turn[:, :6] * np.arange(1, 7)) @ turn[:, :6].T,
        "wide": (turn * np.geomspace(1e9, 1e-3, 40)) @ turn.T,
    }[case]
    values, axes = whitening.principal_axes(cov, 32)
    want = np.linalg.eigvalsh(cov)[::-1][:32]
    assert len(values) == (6 if case == "flat" else (32 if case != "wide" else len(values)))
    assert np.abs(values - want[: len(values)]).max() < 1e-13 * want[0] * 40
    assert np.abs(cov @ axes - axes * values).max() < 1e-13 * want[0] * 40
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13


def test_sturm_counts_eigenvalues_below():
    r = np.random.default_rng(5)
    d, e = r.normal(size=12), r.normal(size=11)
    e[4] = 0  # two blocks
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.concatenate([values + 1e-9, values - 1e-9])
    assert whitening.sturm_counts(d, e, at).tolist() == [(values < x).sum() for x in at]
    assert np.allclose(whitening.leading_eigenvalues(d, e, 5), values[::-1][:5], atol=1e-14, rtol=0)


def whitened(df, width, components=32):
    rows = whitening.whiten(df, components).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r["vec_id"]].setdefault(r["component"], []).append(r)
    return rows, by


def test_whitening_of_a_table(spark):
    r = np.random.default_rng(6)
    data = r.normal(size=(400, 12)) @ r.normal(size=(12, 12)) + 3
    rows = odd_rows([(i, [float(c) for c in v]) for i, v in enumerate(data)])
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("x", F.lit("clash"))
    x = np.array([v for _, v in whole(rows, 12)], dtype=object) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    found, by = whitened(df, 12)
    assert len(found) == n * 12 and {f["n"] for f in found} == {n}
    deviation = Counter((i, int(((n * a - total) ** 2).sum())) for (i, _), a in zip(whole(rows, 12), x, strict=True))
    assert Counter((f["vec_id"], f["deviation"]) for f in found if f["component"] == 1) == deviation
    centred = ((n * x - total) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    for (i, _), z in zip(whole(rows, 12), centred @ axes / np.sqrt(values), strict=True):
        for k in range(12):
            assert min(abs(abs(f["whitened"]) - abs(z[k])) for f in by[i][k + 1]) < 1e-9
    assert all(abs(f["explained"] - values[f["component"] - 1] / values.sum()) < 1e-12 for f in found)
    assert len({f["identity_error"] for f in found}) == 1 and found[0]["identity_error"] < 1e-10


def test_whitening_of_flat_and_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, VECTORS)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(8)], VECTORS)
    found, _ = whitened(line, 3)
    assert {f["component"] for f in found} == {1} and len(found) == 8 and abs(found[0]["explained"] - 1) < 1e-12


def test_deviation_beyond_a_long_is_null_and_exact_below():
    exact = whitening.Centre(10**9, np.array([5, -3]), np.array([7, 999_999_999]), 10**6)
    x = np.array([[5, -3], [6, -2], [10**6, 0]])
    want = [sum((10**9 * (int(a) - w) - r) ** 2 for a, w, r in zip(row, (5, -3), (7, 999_999_999), strict=True)) for row in x]
    assert exact.deviation(x) == [v if v < 2**63 else None for v in want]
    huge = whitening.Centre(3, np.array([0]), np.array([1]), 2**58)
    assert huge.deviation(np.array([[2**58], [1]])) == [None, 4]


def test_whole_vectors_floor_downwards(spark):
    df = spark.createDataFrame([(1, [-0.001, 0.0, 1 / 64])], VECTORS)
    assert vectors.whole_vectors(df, 10).first()["x"] == [9, 10, 11]


# Collocations


def listed(rows, least, covered=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for i in range(len(words)) for k in range(1, 5) if i + k <= len(words))
    result = []
    for lang, c in f.items():
        candidates = {g: a for g, a in c.items() if a >= least and len(g) > 1}
        inside = {g[i : i + k]: 0 for g in candidates for k in range(2, len(g)) for i in range(len(g) - k + 1)}
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        scored = []
        for g, a in candidates.items():
            if 100 * inside.get(g, 0) < covered * a:
                cuts = [(2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            result.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(result)


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(4)
    words = ["The", "of", "stone", "river", "Straße", "été", "a", "x\x1cy", "漢字", "b", "c", "d"]
    rows = [(None, "en"), ("", None), ("A" * 50, "en"), ("a b", ""), ("a " * 3000, "fr"), (" \t. ,", "fr")]
    passage = " ".join(f"w{i}" for i in range(70))
    ring = " ".join(["p q r s t"] * 40)
    for _ in range(150):
        body = " ".join(r.choice(words) + r.choice(["", "", ",", "\t.", "\r\n"]) for _ in range(r.randint(0, 60)))
        rows.append((body + r.choice(["", " " + passage + ".", " " + ring]), r.choice(["en", "de", None, "und"])))
    return rows + rows[:3]


@pytest.mark.parametrize("setting", [{"least": 30}, {"least": 5, "top": 40}, {"least": 2, "slots": 64}])
def test_collocations_equal_plain_counting(spark, spoken, setting):
    df = spark.createDataFrame(spoken, "text string, lang string").repartition(3)
    df = df.withColumns({c: F.lit(0) for c in ("n", "gram", "words", "hash")})
    got = sorted(tuple(x) for x in collocations.collocations(df, **setting).collect())
    assert got == listed(spoken, setting["least"], top=setting.get("top", 2000))


def test_chains_become_paths_of_the_same_flow(spark, spoken):
    df = spark.createDataFrame(spoken, "text string, lang string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    schema = "lang string, gram string, n long, words int"
    grams = spark.createDataFrame(collocations.longest_grams(df, 2, 1 << 20).collect(), schema)
    edges, nodes = grams.where("words = 4 AND n >= 2"), collocations.node_flow(grams, 3, 2)
    want = Counter({(r["lang"], tuple(r["gram"].split(" "))): r["n"] for r in edges.collect()})
    for segment in (1024, 7):
        paths = collocations.compacted(edges, nodes, segment).collect()
        got = Counter()
        for p in paths:
            for i in range(len(p["words"]) - 3):
                got[p["lang"], tuple(p["words"][i : i + 4])] += p["n"]
        assert got == want and len(paths) < len(want)
        assert max(len(p["words"]) for p in paths) == (10 if segment == 7 else 70)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
