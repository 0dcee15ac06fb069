"""Windows, rankings, reshaping and descriptive tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, describe, joins, ranking
from .aggregating import PRIOR_SQL, country_scores_sql, scored_with_codes
from .base import Tables, query, rounded


@query(
    "first_by_sequence",
    """
    WITH x AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN '' ELSE p_brand END AS country,
                      CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS seq
               FROM lineitem JOIN part ON l_partkey = p_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq NULLS LAST, country) AS rn FROM x WHERE country <> '')
    SELECT l_orderkey, country AS country_primary FROM r WHERE rn = 1
    """,
)
def _first_by_sequence(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("p_brand")).alias("country"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("seq"),
    )
    return ranking.first_by_sequence(rows, "l_orderkey", "seq", "country", "country_primary")


@query(
    "mode_by_key",
    """
    WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT l_suppkey, p_brand AS mode_brand
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS rn FROM c) WHERE rn = 1
    """,
)
def _mode_by_key(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return ranking.mode_by_key(rows, "l_suppkey", "p_brand", "mode_brand")


@query(
    "primary_name_map",
    """
    WITH c AS (SELECT l_suppkey, p_name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT l_suppkey, p_name AS firm_name, n AS patent_count
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_name) AS rn FROM c) WHERE rn = 1
    """,
)
def _primary_name_map(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return ranking.primary_name(rows, "l_suppkey", "p_name", "l_orderkey", "firm_name", "patent_count")


OWNER_ROWS = """
    SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS owner,
           CASE WHEN l_linestatus = 'F' THEN CAST(year(l_shipdate) AS INT) END AS y
    FROM {lineitem}
"""


@query(
    "best_owner_row",
    f"""
    WITH x AS ({OWNER_ROWS}),
    d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY owner IS NULL, y DESC NULLS LAST, owner) AS rn FROM x),
    a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY owner IS NULL, y ASC NULLS LAST, owner) AS rn FROM x)
    SELECT d.l_orderkey, d.owner AS latest_owner, d.y AS latest_year, a.owner AS earliest_owner, a.y AS earliest_year
    FROM d JOIN a ON d.l_orderkey = a.l_orderkey WHERE d.rn = 1 AND a.rn = 1
    """,
)
def _best_owner_row(t: Tables) -> DataFrame:
    rows = t.sql(OWNER_ROWS)
    late = ranking.best_owner(rows, "l_orderkey", "owner", "y").toDF("l_orderkey", "latest_owner", "latest_year")
    early = ranking.best_owner(rows, "l_orderkey", "owner", "y", False).toDF("l_orderkey", "earliest_owner", "earliest_year")
    return late.join(early, "l_orderkey")


@query("prior_count", PRIOR_SQL)
def _prior_count(t: Tables) -> DataFrame:
    return ranking.prior_count(t.view("owner_links"), "owner_id", "patent_id", "app_year", "prior_count")


@query(
    "cumulative_policy",
    """
    WITH x AS (SELECT s_nationkey AS k, CAST(year(l_shipdate) AS INT) AS year, count(*)::BIGINT AS n_measures
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
    SELECT k, year, n_measures, sum(n_measures) OVER (PARTITION BY k ORDER BY year)::BIGINT AS n_measures_cum,
           1 AS any_measure, min(year) OVER (PARTITION BY k) AS first_year, 1 AS post_any
    FROM x
    """,
)
def _cumulative_policy(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("k"), F.year("l_shipdate").alias("year"), F.lit(1).alias("one")
    )
    return ranking.cumulative_policy(rows, "k", "year", "one")


MONTHLY = """
    SELECT c_nationkey AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS period,
           count(*) AS n_orders, round(sum(o_totalprice), 2) AS price
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2
"""


@query(
    "lead_change",
    f"""
    WITH m AS ({MONTHLY})
    SELECT k, period, n_orders, price, lead(n_orders, 5) OVER (PARTITION BY k ORDER BY period) - n_orders AS d5_n_orders,
           round(lead(price, 5) OVER (PARTITION BY k ORDER BY period) - price, 2) AS d5_price
    FROM m
    """,
)
def _lead_change(t: Tables) -> DataFrame:
    return rounded(ranking.lead_change(t.sql(MONTHLY), "k", "period", ["n_orders", "price"]), 2)


@query(
    "lead_change_exact",
    f"""
    WITH m AS ({MONTHLY})
    SELECT a.k, a.period, a.n_orders, a.price, b.n_orders - a.n_orders AS d5_n_orders, round(b.price - a.price, 2) AS d5_price
    FROM m a LEFT JOIN m b ON a.k = b.k AND b.period = a.period + 5
    """,
)
def _lead_change_exact(t: Tables) -> DataFrame:
    return rounded(ranking.lead_change_exact(t.sql(MONTHLY), "k", "period", ["n_orders", "price"]), 2)


@query(
    "ntile_profile",
    """
    WITH x AS (SELECT *, ntile(20) OVER (ORDER BY benchmark_score, patent_id) AS tile FROM {scored})
    SELECT tile, count(*) AS n, round(avg(metadata_score), 8) AS metadata_mean, round(avg(num_claims), 8) AS claims_mean,
           round(avg(has_ml_cpc), 8) AS public_share
    FROM x GROUP BY 1
    """,
)
def _ntile_profile(t: Tables) -> DataFrame:
    rows = t.view("scored").select("patent_id", "benchmark_score", "metadata_score", "num_claims", "has_ml_cpc")
    tiles = ranking.ntile(rows, 20, ["benchmark_score", "patent_id"])
    out = tiles.groupBy("tile").agg(
        F.count("*").alias("n"),
        F.avg("metadata_score").alias("metadata_mean"),
        F.avg("num_claims").alias("claims_mean"),
        F.avg("has_ml_cpc").alias("public_share"),
    )
    return rounded(out)


DENSITY_SQL = """
    WITH b AS (SELECT CASE WHEN has_data_processing_cpc = 1 AND has_measurement_cpc = 0 AND has_testing_cpc = 0 THEN 'generic'
                           WHEN has_measurement_cpc = 1 OR has_testing_cpc = 1 OR has_ml_cpc = 1 THEN 'evidence' ELSE 'other' END AS grp,
                      floor(benchmark_score * 20) / 20 AS bin FROM {scored}),
    h AS (SELECT grp, bin, count(*) AS n FROM b GROUP BY 1, 2)
    SELECT grp, round(bin, 6) AS bin, n, round(n / sum(n) OVER (PARTITION BY grp), 8) AS density FROM h
"""


def density(t: Tables) -> DataFrame:
    from ..functions.numbers import grid_floor

    dp, m, s, k = (F.col(c) == 1 for c in ("has_data_processing_cpc", "has_measurement_cpc", "has_testing_cpc", "has_ml_cpc"))
    group = F.when(dp & ~m & ~s, "generic").when(m | s | k, "evidence").otherwise("other")
    return describe.within_group_density(t.view("scored"), group, grid_floor("benchmark_score", 20))


@query("share_of_total", DENSITY_SQL)
def _share_of_total(t: Tables) -> DataFrame:
    return rounded(density(t))


@query(
    "concentration_curve",
    """
    WITH c AS (SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS total FROM orders GROUP BY 1)
    SELECT o_custkey, total, round(row_number() OVER (ORDER BY total DESC, o_custkey) / count(*) OVER (), 8) AS entity_share,
           round(sum(total) OVER (ORDER BY total DESC, o_custkey ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 8) AS cumulative_share
    FROM c
    """,
)
def _concentration_curve(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("v", F.floor("o_totalprice"))
    return rounded(describe.concentration_curve(rows, "o_custkey", "v"))


EXTREMES_SQL = """
    WITH x AS (SELECT patent_id, round(benchmark_score, 10) AS benchmark_score, round(abs(benchmark_score - 0.5), 10) AS dist_to_threshold FROM {scored}),
    r AS (SELECT *, row_number() OVER (ORDER BY benchmark_score DESC, patent_id) AS a,
                 row_number() OVER (ORDER BY benchmark_score, patent_id) AS b,
                 row_number() OVER (ORDER BY dist_to_threshold, patent_id) AS c FROM x)
"""


@query(
    "score_extremes",
    EXTREMES_SQL
    + """
    SELECT 'top' AS bucket, patent_id, benchmark_score, dist_to_threshold FROM r WHERE a <= 500 UNION ALL
    SELECT 'bottom', patent_id, benchmark_score, dist_to_threshold FROM r WHERE b <= 500 UNION ALL
    SELECT 'ambiguous', patent_id, benchmark_score, dist_to_threshold FROM r WHERE c <= 500
    """,
)
def _score_extremes(t: Tables) -> DataFrame:
    rows = t.view("scored").select("patent_id", "benchmark_score")
    return rounded(describe.score_extremes(rows, "benchmark_score", "patent_id", 0.5, 500), 10)


@query(
    "validation_examples",
    EXTREMES_SQL
    + """
    SELECT 'Top score' AS bucket, patent_id, benchmark_score, dist_to_threshold FROM r WHERE a <= 8 UNION ALL
    SELECT 'Bottom score', patent_id, benchmark_score, dist_to_threshold FROM r WHERE b <= 8 UNION ALL
    SELECT 'Most ambiguous', patent_id, benchmark_score, dist_to_threshold FROM r WHERE c <= 8
    """,
)
def _validation_examples(t: Tables) -> DataFrame:
    rows = t.view("scored").select("patent_id", "benchmark_score")
    return rounded(describe.validation_examples(rows, "benchmark_score", "patent_id", 0.5), 10)


@query(
    "review_sample",
    """
    WITH s AS (SELECT patent_id, benchmark_score, dictionary_score, metadata_score, semantic_lsa_score FROM {scored}),
    d AS (SELECT patent_id, stddev_samp(v) AS dis FROM (
            SELECT patent_id, unnest([dictionary_score, metadata_score, semantic_lsa_score]) AS v FROM s) GROUP BY 1),
    r AS (SELECT s.*, round(dis, 10) AS dis, row_number() OVER (ORDER BY benchmark_score DESC, patent_id) AS a,
                 row_number() OVER (ORDER BY benchmark_score, patent_id) AS b,
                 row_number() OVER (ORDER BY round(abs(benchmark_score - 0.4), 10), patent_id) AS c,
                 row_number() OVER (ORDER BY round(dis, 10) DESC, patent_id) AS e FROM s JOIN d USING (patent_id))
    SELECT patent_id, round(benchmark_score, 10) AS benchmark_score, dis AS method_disagreement,
           CASE WHEN a <= 300 THEN 0 WHEN b <= 300 THEN 1 WHEN c <= 300 THEN 2 ELSE 3 END AS first_list
    FROM r WHERE a <= 300 OR b <= 300 OR c <= 300 OR e <= 300
    """,
)
def _review_sample(t: Tables) -> DataFrame:
    methods = ["dictionary_score", "metadata_score", "semantic_lsa_score"]
    rows = t.view("scored").select("patent_id", "benchmark_score", *methods)
    picked = describe.review_sample(rows, "patent_id", "benchmark_score", methods, 0.4)
    return rounded(picked.select("patent_id", "benchmark_score", "method_disagreement", "first_list"), 10)


GROUPS_SQL = """
    WITH y AS (SELECT assignee_iso2 AS iso2, app_year, sum(benchmark_flag) AS part, count(*) AS total, avg(benchmark_flag) AS share
               FROM {scored} GROUP BY 1, 2),
    g AS (SELECT iso2, sum(part)::BIGINT AS total_part, sum(total)::BIGINT AS total_all, round(avg(share), 8) AS avg_share,
                 count(DISTINCT app_year) AS years_observed FROM y GROUP BY 1),
    h AS (SELECT *, round(total_part / sum(total_part) OVER (), 8) AS global_share FROM g)
"""


@query(
    "top_groups",
    GROUPS_SQL
    + """
    SELECT * FROM (SELECT 'largest' AS list, * FROM h ORDER BY total_part DESC, iso2 LIMIT 15) UNION ALL
    SELECT * FROM (SELECT 'densest' AS list, * FROM h WHERE total_all >= 600 ORDER BY avg_share DESC, iso2 LIMIT 15)
    """,
)
def _top_groups(t: Tables) -> DataFrame:
    yearly = t.view("scored").groupBy(F.col("assignee_iso2").alias("iso2"), "app_year").agg(
        F.sum("benchmark_flag").alias("part"), F.count("*").alias("total"), F.avg("benchmark_flag").alias("share")
    )
    largest, dense = describe.top_groups(yearly, "iso2", "part", "total", "share", "app_year", 15, 600)
    return rounded(describe.stack_levels({"largest": largest, "densest": dense}, "list"))


@query(
    "top_k_series",
    """
    WITH y AS (SELECT assignee_iso2, app_year, sum(benchmark_flag)::BIGINT AS total FROM {scored} GROUP BY 1, 2),
    top AS (SELECT assignee_iso2 FROM y GROUP BY 1 ORDER BY sum(total) DESC, assignee_iso2 LIMIT 8)
    SELECT * FROM y WHERE assignee_iso2 IN (SELECT assignee_iso2 FROM top)
    """,
)
def _top_k_series(t: Tables) -> DataFrame:
    return describe.top_k_series(t.view("scored"), "assignee_iso2", "app_year", "benchmark_flag", 8)


VARIANTS = {
    ("assignee", "app"): ("assignee_iso3", "app_year"),
    ("assignee", "grant"): ("assignee_iso3", "grant_year"),
    ("inventor", "app"): ("inventor_iso2", "app_year"),
    ("inventor", "grant"): ("inventor_iso2", "grant_year"),
}
SQL_CODES = {"assignee_iso3": "assignee_iso2 || 'T'", "inventor_iso2": "inventor_iso2"}
VARIANTS_SQL = " UNION ALL ".join(
    f"SELECT *, '{a}' AS assignment_basis, '{y}' AS year_basis FROM ({country_scores_sql(SQL_CODES[c], k)})"
    for (a, y), (c, k) in VARIANTS.items()
)


@query("union_variants", VARIANTS_SQL)
def _union_variants(t: Tables) -> DataFrame:
    s = scored_with_codes(t)
    return rounded(aggregates.country_year_variants(s, VARIANTS), 12)


@query(
    "panel_with_evidence",
    f"""
    WITH panel AS (SELECT 'N' || chr(65 + s_nationkey) || 'T' AS iso3c, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_rows
                   FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
    SELECT iso3c, year, n_rows, v.patent_count AS pe_patent_count, v.benchmark_score_mean AS pe_benchmark_score_mean
    FROM panel LEFT JOIN ({country_scores_sql(SQL_CODES['assignee_iso3'], 'app_year')}) v USING (iso3c, year)
    """,
)
def _panel_with_evidence(t: Tables) -> DataFrame:
    code = F.concat(F.lit("N"), F.char(F.lit(65) + F.col("s_nationkey")), F.lit("T"))
    panel = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(code.alias("iso3c"), F.year("l_shipdate").alias("year"))
        .agg(F.count("*").alias("n_rows"))
    )
    scores = aggregates.country_year_scores(scored_with_codes(t), "assignee_iso3", "app_year")
    pe = describe.prefix_measures(scores, ["iso3c", "year"])
    out = panel.join(pe, ["iso3c", "year"], "left")
    return rounded(out.select("iso3c", "year", "n_rows", "pe_patent_count", "pe_benchmark_score_mean"), 12)


@query("distinct_edges", "SELECT DISTINCT l_partkey AS patent_id, l_orderkey AS citing_id FROM lineitem")
def _distinct_edges(t: Tables) -> DataFrame:
    from ..operators.edges import distinct_edges

    return distinct_edges(t.view("edges"), "patent_id", "citing_id")


def stats_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS sd,
            round(quantile_cont({c}, 0.1), 8) AS p10, round(quantile_cont({c}, 0.5), 8) AS p50,
            round(quantile_cont({c}, 0.9), 8) AS p90 FROM {table}"""
        for c in columns
    )


STAT_COLUMNS = ["benchmark_score", "metadata_score", "num_claims", "has_ml_cpc"]


@query("union_all_stats", stats_sql("{scored}", STAT_COLUMNS))
def _union_all_stats(t: Tables) -> DataFrame:
    return rounded(describe.union_all_stats(t.view("scored"), STAT_COLUMNS))


INDUSTRY_SQL = """
    SELECT substr('C' || CAST(o_custkey AS VARCHAR), 1, {n}) AS code, CAST(year(o_orderdate) AS INT) AS year,
           count(*) AS patent_count, sum(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END)::BIGINT AS data_count,
           avg(CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END) AS data_share
    FROM orders GROUP BY 1, 2
"""


def industry(t: Tables, n: int) -> DataFrame:
    flag = F.when(F.col("o_totalprice") >= 250000, 1).otherwise(0)
    code = F.substring(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), 1, n)
    return t.orders.groupBy(code.alias("code"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("patent_count"), F.sum(flag).alias("data_count"), F.avg(flag).alias("data_share")
    )


@query(
    "stack_levels",
    " UNION ALL ".join(
        f"""SELECT year, round(avg(data_share), 8) AS share, round(sum(data_count) / sum(patent_count), 8) AS weighted_share,
            sum(patent_count)::BIGINT AS total, 'level {n}' AS level FROM ({INDUSTRY_SQL.replace('{n}', str(n))}) GROUP BY 1"""
        for n in (2, 3, 4)
    ),
)
def _stack_levels(t: Tables) -> DataFrame:
    frames = {
        f"level {n}": describe.level_summary(industry(t, n), "year", "patent_count", "data_count", "data_share") for n in (2, 3, 4)
    }
    return rounded(describe.stack_levels(frames))


@query(
    "pivot_density",
    f"""
    SELECT bin, coalesce(max(CASE WHEN grp = 'generic' THEN density END), 0) AS generic_density,
           coalesce(max(CASE WHEN grp = 'evidence' THEN density END), 0) AS evidence_density,
           coalesce(max(CASE WHEN grp = 'other' THEN density END), 0) AS other_density
    FROM ({DENSITY_SQL}) GROUP BY 1
    """,
)
def _pivot_density(t: Tables) -> DataFrame:
    names = {"generic": "generic_density", "evidence": "evidence_density", "other": "other_density"}
    return rounded(describe.pivot_density(density(t), names))


@query(
    "summary_stats",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
            round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median,
            round(quantile_cont({c}, 0.75), 6) AS p75, round(quantile_cont({c}, 0.9), 6) AS p90, round(min({c}), 6) AS min,
            round(max({c}), 6) AS max FROM {{scored}}"""
        for c, label in (("benchmark_score", "Score"), ("metadata_score", "metadata_score"), ("num_claims", "Claims"))
    ),
)
def _summary_stats(t: Tables) -> DataFrame:
    rows = t.view("scored").withColumn("empty", F.lit(None).cast("double"))
    labels = {"benchmark_score": "Score", "num_claims": "Claims"}
    return rounded(describe.summary_stats(rows, ["benchmark_score", "metadata_score", "num_claims", "empty"], labels), 6)


@query(
    "variance_split",
    """
    WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1),
    x AS (SELECT count(*) AS n, count(DISTINCT c_nationkey) AS groups, var_pop(c_acctbal) AS o,
                 avg((c_acctbal - m) * (c_acctbal - m)) AS w FROM customer JOIN g USING (c_nationkey))
    SELECT n, groups, round(o, 4) AS overall_var, round((SELECT var_pop(m) FROM g), 4) AS between_var, round(w, 4) AS within_var,
           round(w / o, 8) AS within_share
    FROM x
    """,
)
def _variance_split(t: Tables) -> DataFrame:
    out = describe.variance_split(t.customer, "c_nationkey", "c_acctbal")
    return out.select(
        "n", "groups", *[F.round(c, 4).alias(c) for c in ("overall_var", "between_var", "within_var")],
        F.round("within_share", 8).alias("within_share"),
    )


def bins_sql(bins: int) -> str:
    points = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""
    WITH d AS (SELECT floor(o_totalprice / 1000) AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders),
    cuts AS (SELECT quantile_cont(x, [{points}]) AS c FROM d),
    cut AS (SELECT DISTINCT unnest(c) AS edge FROM cuts),
    vals AS (SELECT DISTINCT x FROM d),
    place AS (SELECT v.x, greatest(count(cut.edge), 1) AS bin FROM vals v LEFT JOIN cut ON cut.edge < v.x GROUP BY v.x)
    SELECT CAST(bin AS INT) AS bin, avg(d.x) AS x_mean, avg(y) AS y_mean, count(*) AS n FROM d JOIN place ON d.x = place.x GROUP BY 1
    """


def binned(t: Tables) -> DataFrame:
    rows = t.orders.select(F.floor(F.col("o_totalprice") / 1000).alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return describe.quantile_bins(rows, "x", "y", 15)


@query("quantile_bins", f"SELECT bin, round(x_mean, 6) AS x_mean, round(y_mean, 6) AS y_mean, n FROM ({bins_sql(15)})")
def _quantile_bins(t: Tables) -> DataFrame:
    return rounded(binned(t), 6)


@query(
    "linear_trend",
    f"SELECT round(regr_slope(y_mean, x_mean), 6) AS slope, round(regr_intercept(y_mean, x_mean), 4) AS intercept FROM ({bins_sql(15)})",
)
def _linear_trend(t: Tables) -> DataFrame:
    out = describe.linear_trend(binned(t), "x_mean", "y_mean")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


COUNTRY_YEAR = """
    SELECT assignee_iso2 AS iso2, app_year AS year, count(*) AS patents, sum(benchmark_flag) AS flagged,
           sum(CASE WHEN o_orderstatus = 'P' THEN num_claims END) AS pop, sum(num_claims) * 1.0e9 AS gdp,
           sum(has_bio_assay_cpc) % 3 AS rd_pct, sum(has_ml_cpc) % 2 AS law
    FROM {scored} GROUP BY 1, 2
"""


@query(
    "intensity_ratios",
    f"""
    SELECT iso2, year, round(flagged / nullif(pop, 0), 8) AS per_million, round(flagged / nullif(gdp / 1e12, 0), 6) AS per_trillion_gdp,
           round(flagged / nullif(gdp * rd_pct / 100.0 / 1e9, 0), 6) AS per_billion_rd, CASE WHEN law = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS privacy_law
    FROM ({COUNTRY_YEAR})
    """,
)
def _intensity_ratios(t: Tables) -> DataFrame:
    out = describe.intensity_ratios(t.sql(COUNTRY_YEAR), "flagged", "pop", "gdp", "rd_pct", "law")
    return out.select(
        "iso2", "year", F.round("per_million", 8).alias("per_million"), F.round("per_trillion_gdp", 6).alias("per_trillion_gdp"),
        F.round("per_billion_rd", 6).alias("per_billion_rd"), "privacy_law",
    )


@query(
    "yearly_share",
    f"""
    SELECT year, sum(patents)::BIGINT AS total, sum(flagged)::BIGINT AS data, round(sum(flagged) / sum(patents), 8) AS share
    FROM ({COUNTRY_YEAR}) GROUP BY 1
    """,
)
def _yearly_share(t: Tables) -> DataFrame:
    return rounded(describe.yearly_share(t.sql(COUNTRY_YEAR), ["year"], "patents", "flagged"))


@query(
    "income_group_trends",
    """
    WITH x AS (SELECT app_year AS year, CASE WHEN c_nationkey = 9 THEN NULL ELSE c_mktsegment END AS income, num_claims,
                      benchmark_flag, metadata_score FROM {scored})
    SELECT year, income, sum(num_claims)::BIGINT AS total, sum(benchmark_flag)::BIGINT AS data,
           round(sum(benchmark_flag) / nullif(sum(num_claims), 0), 8) AS share, round(median(metadata_score), 8) AS median_intensity
    FROM x WHERE income IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') GROUP BY 1, 2
    """,
)
def _income_group_trends(t: Tables) -> DataFrame:
    rows = t.view("scored").withColumns(
        {"income": F.when(F.col("c_nationkey") != 9, F.col("c_mktsegment")), "year": F.col("app_year")}
    )
    keep = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
    return rounded(describe.income_group_trends(rows, "year", "income", keep, "num_claims", "benchmark_flag", "metadata_score"))


@query(
    "overview_table",
    """
    SELECT 'all' AS dataset, 'item' AS unit, count(*) AS observations, count(DISTINCT assignee_iso2) AS entities,
           min(app_year) AS year_start, max(app_year) AS year_end, 1.0::DOUBLE AS coverage FROM {scored}
    UNION ALL
    SELECT 'flagged', 'item', count(*), count(DISTINCT assignee_iso2), min(app_year), max(app_year),
           round(count(*) / (SELECT count(*) FROM {scored}), 8)
    FROM {scored} WHERE benchmark_flag = 1
    """,
)
def _overview_table(t: Tables) -> DataFrame:
    s = t.view("scored")
    samples = [
        (s, "all", "item", "assignee_iso2", "app_year"),
        (s.where("benchmark_flag = 1"), "flagged", "item", "assignee_iso2", "app_year"),
    ]
    return rounded(describe.overview_table(samples, s))


@query(
    "missingness",
    """
    SELECT round(avg(CASE WHEN inventor_iso2 IS NULL THEN 1 ELSE 0 END), 8) AS missing_inventor_iso2,
           round(avg(CASE WHEN num_claims IS NULL THEN 1 ELSE 0 END), 8) AS missing_num_claims FROM {scored}
    """,
)
def _missingness(t: Tables) -> DataFrame:
    return rounded(describe.missingness(t.view("scored"), ["inventor_iso2", "num_claims"]))


@query(
    "claims_by_flag",
    """
    WITH b AS (SELECT benchmark_flag AS flag, num_claims AS v FROM {scored} WHERE o_orderstatus <> 'P'), p AS (SELECT quantile_cont(v, 0.9) AS q FROM b)
    SELECT CASE WHEN flag = 1 THEN 'flagged' ELSE 'rest' END AS group_name, count(*) AS n, round(avg(v), 8) AS mean_value,
           round(avg(CASE WHEN v >= q THEN 1 ELSE 0 END), 8) AS top_share, round(quantile_cont(v, 0.5), 8) AS median_value
    FROM b, p GROUP BY 1
    """,
)
def _claims_by_flag(t: Tables) -> DataFrame:
    rows = t.view("scored").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("num_claims")))
    return rounded(describe.claims_by_flag(rows, "benchmark_flag", "v", 0.9, "flagged", "rest"))


@query(
    "sample_rows",
    """
    SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders
    ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT, o_orderkey LIMIT 3000
    """,
)
def _sample_rows(t: Tables) -> DataFrame:
    return rounded(describe.sample_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 3000, "o_orderkey"), 2)


@query(
    "grid_mean",
    """
    SELECT CAST(floor(o_totalprice / 20000) AS BIGINT) AS x_cell, CAST(floor(c_acctbal / 1000) AS BIGINT) AS y_cell, count(*) AS n,
           round(avg(o_orderkey), 6) AS mean_value
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 20
    """,
)
def _grid_mean(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(describe.grid_mean(rows, "o_totalprice", "c_acctbal", "o_orderkey", 20000, 1000, 20), 6)


@query(
    "histogram",
    """
    WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
    SELECT CAST(least(floor((c_acctbal - lo) / (hi - lo) * 40) + 1, 40) AS INT) AS bin, count(*) AS n FROM customer, r GROUP BY 1
    """,
)
def _histogram(t: Tables) -> DataFrame:
    return describe.histogram(t.customer, "c_acctbal", 40)


@query(
    "run_summary",
    """
    SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities, CAST(min(year(o_orderdate)) AS INT) AS year_min,
           CAST(max(year(o_orderdate)) AS INT) AS year_max
    FROM orders
    """,
)
def _run_summary(t: Tables) -> DataFrame:
    return aggregates.run_summary(t.orders.withColumn("y", F.year("o_orderdate")), "o_custkey", "y")


@query(
    "front_columns",
    "SELECT n_name, n_nationkey, n_regionkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3",
)
def _front_columns(t: Tables) -> DataFrame:
    counted = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "n_nationkey", "n_regionkey", "n_name"
    ).agg(F.count("*").alias("n"))
    return joins.front_columns(counted, ["n_name", "absent"])
