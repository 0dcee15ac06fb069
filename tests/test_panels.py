import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates, edges, joins
from panelwright.plans import countries


def test_firm_year_panel_counts_rows_over_items(spark):
    df = spark.createDataFrame(
        [(1, 2000, "001000", "ACME", 0, 2001), (2, 2000, "001000", "ACME", 1, 2002), (2, 2000, "001000", "ACME", 1, 2002), (3, 2001, "001000", "ACME", 0, 2003)],
        "patent_id int, appYear int, gvkeyUO string, clean_name string, privateSubsidiary int, grantYear int",
    )
    out = aggregates.firm_year_panel(df, "gvkeyUO", "appYear", "patent_id", "grantYear", "privateSubsidiary", "clean_name")
    row = out.where("year = 2000").first()
    assert (row["gvkey"], row["patents_applied"], row["private_subsidiary_patents"], row["private_subsidiary_share"]) == ("001000", 2, 2, 1.0)
    assert row["patents_granted"] == 3 and row["distinct_assignee_names"] == 1


def test_weights_sum_to_one_per_source(spark):
    xwalk = aggregates.build_crosswalk(
        spark.createDataFrame([("0111", "111.0"), ("0111", "112"), ("20", "311111"), ("20", "311111"), ("x", "1")], "s string, n string"), "n", "s"
    )
    for level in (2, 3, 4):
        w = aggregates.fractional_weights(xwalk, "sic_key", f"naics{level}")
        sums = w.groupBy("sic_key").agg(F.sum(1 / F.col("n_codes")).alias("t"))
        assert all(r["t"] == pytest.approx(1) for r in sums.collect())


def test_policy_means_skip_missing_values(spark):
    items = spark.createDataFrame(
        [("1", 2000, 1, 0.5, 3.0), ("1", 2000, 0, None, None), ("2", 2000, 1, 1.0, None), (None, 2000, 1, 1.0, 1.0), ("1", None, 1, 1.0, 1.0)],
        "sic_key string, y int, flag int, score double, policy double",
    )
    w = spark.createDataFrame([("1", "A", 2), ("1", "B", 2), ("2", "A", 1)], "sic_key string, naics_code string, n_codes int")
    out = aggregates.industry_year_weighted(items, w, "sic_key", "y", "flag", ["score"], [], {"policy_mean": "policy"})
    a = out.where("naics_code = 'A'").first()
    assert a["patent_count"] == pytest.approx(2.0) and a["data_driven_patent_count"] == pytest.approx(1.5)
    assert a["score_mean"] == pytest.approx((0.25 + 1.0) / 2.0) and a["policy_mean"] == pytest.approx(3.0)
    assert a["raw_links"] == 3


def test_citation_windows_are_monotone_and_keep_zeros(spark):
    edge = spark.createDataFrame([("p", f"c{i}", "x") for i in range(30)] + [("q", "c1", "y")], "p string, c string, k string")
    universe = spark.createDataFrame([("p", 2000), ("q", 2000), ("r", 2000), ("s", None)], "p string, y int")
    years = spark.createDataFrame([(f"c{i}", 1998 + i) for i in range(25)], "c string, y int")
    out = edges.forward_citations(edge, universe, years, "p", "c", "k", "y", {"n5": 5, "n10": 10}, {"x10": ("x", 10)})
    got = {r["p"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"p": (30, 6, 11, 11), "q": (1, 0, 0, 0), "r": (0, 0, 0, 0), "s": (0, 0, 0, 0)}


def test_small_firm_shares(spark):
    pairs = spark.createDataFrame([("p", f"c{i}") for i in range(6)], "p string, c string")
    universe = spark.createDataFrame([("p", 2000), ("q", 2000)], "p string, y int")
    years = spark.createDataFrame([(f"c{i}", 2000 + i) for i in range(6)], "c string, y int")
    sizes = spark.createDataFrame([("c0", 10.0), ("c1", 900.0), ("c2", None), ("c5", 1.0)], "c string, e double")
    out = {r["p"]: r for r in edges.small_firm_citations(pairs, universe, years, sizes, "p", "c", "y", "e", span=3).collect()}
    assert tuple(out["p"])[1:] == (4, 2, 1, 0.5, 0.5)
    assert tuple(out["q"])[1:] == (0, 0, 0, None, None)


def test_class_ahead_of_introduction(spark, rows):
    classes = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), ("c", None)], "p string, k string")
    universe = spark.createDataFrame([("a", 2000), ("b", 2010), ("c", 2000), ("d", None)], "p string, y int")
    intro = spark.createDataFrame([("X", 2003), ("Y", 1990)], "k string, i int")
    assert rows(edges.class_ahead(classes, universe, intro, "p", "k", "y", "i")) == [("a", 3, 1), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0)]


def test_country_match_provenance(spark, rows):
    names = spark.createDataFrame([("EUROPEAN UNION",), ("KOREA",), ("Côte d'Ivoire",), ("Trinidad & Tobago",), ("Nowhere",), ("KOREA",), (None,)], "n string")
    registry = spark.createDataFrame([("Trinidad and Tobago", "TTO"), ("Côte d’Ivoire", "CIV")], "r string, c string")
    got = rows(joins.country_match(names, "n", registry, "r", "c", countries.MANUAL_CODES, countries.NOT_COUNTRIES))
    assert got == [
        ("Côte d'Ivoire", "CIV", "exact_normalized"), ("EUROPEAN UNION", None, "excluded_non_country"), ("KOREA", "KOR", "manual"),
        ("Nowhere", None, "unmatched"), ("Trinidad & Tobago", "TTO", "exact_normalized"),
    ]


def test_rd_series_and_indicator_pivot(spark):
    base = {"REF_AREA": "deu", "TIME_PERIOD": "2001", "OBS_VALUE": "2.0", "MEASURE": "G", "SECT_PERF": "_T", "TYPE_COST": "_T", "UNIT_MEASURE": "USD_PPP", "PRICE_BASE": "Q"}
    gerd = [base, {**base, "OBS_VALUE": "4.0"}, {**base, "SECT_PERF": "BES"}, {**base, "REF_AREA": "OECD"}, {**base, "OBS_VALUE": ".."}, {**base, "PRICE_BASE": "V", "OBS_VALUE": "99"}]
    ind = {"REF_AREA": "FRA", "TIME_PERIOD": "2001", "OBS_VALUE": "1.5", "MEASURE": "B", "UNIT_MEASURE": "PT_B1GQ", "PRICE_BASE": "_Z", "TRANSFORMATION": "_Z"}
    out = countries.rd_series({"gerd": spark.createDataFrame(gerd)}, spark.createDataFrame([ind]))
    got = {r["iso3c"]: r.asDict() for r in out.collect()}
    assert got["DEU"]["oecd_gerd_total_usd_ppp_const2015"] == 3.0 and got["DEU"]["oecd_gerd_business_usd_ppp_const2015"] == 2.0
    assert got["DEU"]["oecd_gerd_government_usd_ppp_const2015"] is None and got["FRA"]["oecd_msti_b_pct_gdp"] == 1.5
    assert sum(len(s) for s in countries.RD_SERIES.values()) == 17


def test_one_citation_profile_equals_the_three_measures(spark):
    import random

    from panelwright.operators import edges

    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else f"p{rng.randrange(12)}", f"c{rng.randrange(30)}", rng.choice(["x", "y", None])) for _ in range(400)]
    rows += [(None, "c1", "x"), ("p1", None, "x"), ("p1", "unknown", "y")] + rows[:20]
    cited = spark.createDataFrame(rows, "p string, c string, cat string")
    universe = spark.createDataFrame([(f"p{i}", 2000 + i % 4) for i in range(14)] + [("hot", 2001), ("late", None)], "p string, y int")
    years = spark.createDataFrame([(f"c{i}", 1999 + i % 9) for i in range(28)], "c string, y int")
    sizes = spark.createDataFrame([(f"c{i}", None if i % 5 == 0 else 100.0 * i) for i in range(30)], "c string, n double")
    classes = spark.createDataFrame(
        [(f"c{i % 25}", k) for i in range(60) for k in (f"A0{i % 3}B", f"A0{i % 3}B-{i % 7}", "abc", None)], "c string, s string"
    )
    spans, kinds = {"all5": 5, "all3": 3}, {"x3": ("x", 3), "y5": ("y", 5)}
    got = edges.citation_profile(cited, universe, years, classes, sizes, "p", "c", "cat", "s", "n", "y", spans, kinds, span=4)
    pairs = edges.distinct_edges(cited, "p", "c")
    want = (
        edges.forward_citations(cited, universe, years, "p", "c", "cat", "y", spans, kinds)
        .join(edges.citation_breadth(pairs, universe, years, classes, "p", "c", "s", "y", span=4), "p")
        .join(edges.small_firm_citations(pairs, universe, years, sizes, "p", "c", "y", "n", span=4), "p")
    )
    assert set(got.columns) == set(want.columns)
    a, b = (sorted(map(tuple, df.select(*sorted(want.columns)).collect()), key=str) for df in (got, want))
    assert a == b and len(a) == 16 and sum(r[sorted(want.columns).index("forward_citation_count_all")] for r in a) > 300
