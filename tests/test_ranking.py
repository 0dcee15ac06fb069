import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import describe, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One key and one value each fill a third of the rows."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        value = 5.0 if i % 3 == 1 else round(rng.random() * 10, 3)
        data.append((i, key, value, rng.randrange(1990, 2000)))
    return spark.createDataFrame(data, "id int, k string, v double, y int"), pd.DataFrame(data, columns=["id", "k", "v", "y"])


def test_global_rank_is_a_permutation(skewed):
    df, pdf = skewed
    got = ranking.global_rank(df, ["v", "id"], "r", "n").toPandas().sort_values("r")
    assert list(got["r"]) == list(range(1, 901)) and set(got["n"]) == {900}
    assert list(got["id"]) == list(pdf.sort_values(["v", "id"])["id"])


def test_grouped_rank(skewed):
    df, pdf = skewed
    got = ranking.grouped_rank(df, ["k"], ["y", "id"], "r").toPandas().set_index("id")["r"]
    want = pdf.sort_values(["k", "y", "id"]).groupby("k").cumcount() + 1
    assert got.sort_index().tolist() == want.groupby(pdf.loc[want.index, "id"]).first().sort_index().tolist()


def test_grouped_rank_over_many_borders(spark):
    """Groups of one row and of many partitions, null and NaN keys, ties, and more partitions than rows."""
    rng = random.Random(3)
    data = [(None if i % 7 == 0 else float("nan") if i % 7 == 1 else float(i % 3 == 0), "x" * (i % 2), rng.randrange(5), i) for i in range(70)]
    df = spark.createDataFrame(data, "k double, s string, o int, id int")
    counted, size = {}, {}
    for k, s, _, i in sorted(data, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        counted[i] = size[str(k), s] = size.get((str(k), s), 0) + 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.id: r.r for r in ranking.grouped_rank(df, ["k", "s"], ["o", "id"], "r").collect()}
            assert got == counted
        assert ranking.grouped_rank(df.limit(0), ["k"], ["id"], "r").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_of_hard_doubles(spark):
    inf = float("inf")
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, -1.0, inf, -inf, 3.0, 3.0, 3.0, None]
    df = spark.createDataFrame([(v, "a" if i % 2 else None) for i, v in enumerate(values)], "v double, k string")
    ordered = sorted(v for v in values if v is not None)
    probs = {f"p{i}": i / (len(ordered) - 1) for i in range(len(ordered))}
    got = list(ranking.quantiles(df, "v", probs).first())
    assert [g for g, v in zip(got, ordered, strict=True) if abs(v) < inf] == [v for v in ordered if abs(v) < inf]
    assert [r.k for r in ranking.quantiles(df, "v", probs, ["k"]).collect()] == ["a"]


@pytest.mark.parametrize("tiles", [3, 7, 10, 1000])
def test_ntile(skewed, tiles):
    df, pdf = skewed
    got = ranking.ntile(df, tiles, ["v", "id"]).toPandas().sort_values(["v", "id"])
    sizes = got.groupby("tile").size()
    assert sizes.max() - sizes.min() <= 1 and got["tile"].is_monotonic_increasing
    q, r = divmod(900, tiles)
    want = [t + 1 for t in range(tiles) for _ in range(q + (t < r))]
    assert got["tile"].tolist() == want


def test_quantiles_match_pandas(skewed):
    df, pdf = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = ranking.quantiles(df, "v", probs).first()
    assert list(got) == pytest.approx([pdf["v"].quantile(p) for p in probs.values()])
    by = ranking.quantiles(df, "v", probs, ["k"]).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["v"].quantile(list(probs.values())).unstack().sort_index()
    assert np.allclose(by.to_numpy(), want.to_numpy())
    assert list(ranking.quantiles(df.limit(0), "v", probs).first()) == [None] * 5
    assert ranking.quantiles(df.limit(0), "v", probs, ["k"]).count() == 0


def test_prior_count_ignores_layout(skewed, rows):
    df, pdf = skewed
    links = df.select(F.col("k").alias("owner"), "id", "y")
    a = rows(ranking.prior_count(links, "owner", "id", "y", "n"))
    b = rows(ranking.prior_count(links.unionAll(links).repartition(7), "owner", "id", "y", "n"))
    want = pdf.sort_values(["k", "y", "id"])
    counted = sorted(zip(want["k"], want["id"], want["y"], want.groupby("k").cumcount()), key=lambda r: tuple((False, str(x)) for x in r))
    assert a == b == counted


def test_mode_and_first(spark, rows):
    df = spark.createDataFrame(
        [(1, "b", 2), (1, "a", None), (1, "b", 3), (1, "a", 9), (2, None, 1), (2, "", 1), (2, "z", None)], "k int, c string, s int"
    )
    assert rows(ranking.mode_by_key(df.where("c <> ''"), "k", "c", "m")) == [(1, "a"), (2, "z")]
    assert rows(ranking.first_by_sequence(df, "k", "s", "c", "m")) == [(1, "b"), (2, "z")]


def test_best_owner_directions(spark, rows):
    df = spark.createDataFrame([(1, None, 2005), (1, "x", 2001), (1, "y", 2003), (1, "z", None), (2, None, 1999)], "p int, o string, y int")
    assert rows(ranking.best_owner(df, "p", "o", "y")) == [(1, "y", 2003), (2, None, 1999)]
    assert rows(ranking.best_owner(df, "p", "o", "y", newest_first=False)) == [(1, "x", 2001), (2, None, 1999)]


def test_lead_by_rows_and_by_years(spark, rows):
    df = spark.createDataFrame([("a", y, float(y)) for y in (2000, 2001, 2003, 2004, 2005, 2006)], "k string, y int, v double")
    assert rows(ranking.lead_change(df, "k", "y", ["v"]).where("y = 2000"), "d5_v") == [(6.0,)]
    assert rows(ranking.lead_change_exact(df, "k", "y", ["v"]).where("y = 2000"), "d5_v") == [(5.0,)]
    assert rows(ranking.lead_change_exact(df, "k", "y", ["v"]).where("y = 2003"), "d5_v") == [(None,)]


def test_sample_rows_is_exact_and_repeatable(skewed):
    df, _ = skewed
    a = {r["id"] for r in describe.sample_rows(df, 100, "id").collect()}
    b = {r["id"] for r in describe.sample_rows(df.repartition(5), 100, "id").collect()}
    smallest = {r["id"] for r in df.orderBy(describe.id_hash("id"), "id").limit(100).collect()}
    assert a == b == smallest
    assert describe.sample_rows(df, 5000, "id").count() == 900


@pytest.mark.parametrize("bins", [4, 10])
def test_quantile_bins_match_pandas(skewed, bins):
    df, pdf = skewed
    got = describe.quantile_bins(df, "v", "y", bins).toPandas().sort_values("bin")
    cut = pd.qcut(pdf["v"], q=min(bins, pdf["v"].nunique()), duplicates="drop")
    want = pdf.groupby(cut, observed=True).agg(x=("v", "mean"), y=("y", "mean"), n=("v", "size"))
    assert np.allclose(got[["x_mean", "y_mean", "n"]].to_numpy(float), want.to_numpy(float))


def test_variance_split(skewed):
    df, pdf = skewed
    got = describe.variance_split(df, "k", "v").first()
    means = pdf.groupby("k")["v"].transform("mean")
    assert got["overall_var"] == pytest.approx(pdf["v"].var(ddof=0))
    assert got["between_var"] == pytest.approx(pdf.groupby("k")["v"].mean().var(ddof=0))
    assert got["within_var"] == pytest.approx(((pdf["v"] - means) ** 2).mean())


def test_concentration_curve_ends_at_one(skewed):
    df, pdf = skewed
    got = describe.concentration_curve(df, "k", "v").toPandas().sort_values("entity_share")
    want = pdf.groupby("k")["v"].sum().sort_values(ascending=False)
    assert got["cumulative_share"].tolist() == pytest.approx((want.cumsum() / want.sum()).tolist())
    assert got["k"].iloc[0] == want.index[0]


def test_empty_input_has_no_bins_and_no_statistics(skewed):
    df, _ = skewed
    assert describe.quantile_bins(df.limit(0), "v", "y", 5).count() == 0
    assert describe.summary_stats(df.limit(0), ["v", "y"]).count() == 0


def test_summary_stats_match_pandas(skewed):
    df, pdf = skewed
    wide = df.withColumn("none", F.lit(None).cast("double"))
    got = describe.summary_stats(wide, ["v", "y", "none"], {"v": "Value"}).toPandas().set_index("variable")
    assert sorted(got.index) == ["Value", "y"]
    for name, column in (("Value", "v"), ("y", "y")):
        s = pdf[column]
        want = [len(s), s.mean(), s.std(), *s.quantile([0.1, 0.25, 0.5, 0.75, 0.9]), s.min(), s.max()]
        have = got.loc[name, ["n", "mean", "sd", "p10", "p25", "median", "p75", "p90", "min", "max"]]
        assert np.allclose(have.to_numpy(float), want)


def test_partitions_follow_the_tables_read_not_the_estimate_of_a_join(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).write.parquet(path)
    rows = spark.read.parquet(path)
    product = rows.join(rows.withColumnRenamed("id", "b"), F.col("id") == F.col("b")).join(rows.withColumnRenamed("id", "c"), F.col("id") == F.col("c"))
    made = spark.createDataFrame([(1,)], "x int")
    set_by = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [ranking._partitions(df) for df in (rows, product, made)] == [set_by] * 3
