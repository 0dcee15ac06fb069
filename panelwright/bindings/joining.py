"""Joins and linking over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, describe, edges, joins, linking, ranking
from .base import Tables, query, rounded


@query(
    "semi_join_universe",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, count(*) AS copies FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY ALL
    """,
)
def _semi_join_universe(t: Tables) -> DataFrame:
    universe = t.part.where("p_type = 'PROMO'")
    kept = joins.semi_join_universe(t.lineitem, universe, "l_partkey", "p_partkey")
    return kept.groupBy("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").agg(F.count("*").alias("copies"))


@query(
    "lookup_country",
    """
    SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN NULL ELSE n_name END AS country,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 999 ELSE CAST(c_custkey AS INT) END AS seq
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def _lookup_country(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey",
        F.concat(F.lit("LOC-"), F.col("c_nationkey").cast("string")).alias("location_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.col("c_custkey").cast("string")).alias("seq"),
    )
    places = t.nation.select(
        F.when(F.col("n_nationkey") != 4, F.concat(F.lit("Loc-"), F.col("n_nationkey").cast("string"))).alias("location_id"),
        F.lower("n_name").alias("country"),
    )
    return joins.lookup_country(rows, places, "location_id", "seq").select("c_custkey", "country", "seq")


@query(
    "star_left_join",
    """
    WITH a AS (SELECT l_orderkey AS k, count(*) AS n_lines, max(l_quantity) AS max_quantity FROM lineitem GROUP BY 1),
    b AS (SELECT l_orderkey AS k, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    c AS (SELECT o_orderkey AS k, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey
          WHERE c_acctbal > 5000)
    SELECT o_orderkey AS k, coalesce(n_lines, 0) AS n_lines, max_quantity, coalesce(n_returned, 0) AS n_returned, segment
    FROM orders LEFT JOIN a ON o_orderkey = a.k LEFT JOIN b ON o_orderkey = b.k LEFT JOIN c ON o_orderkey = c.k
    """,
)
def _star_left_join(t: Tables) -> DataFrame:
    key = F.col("l_orderkey").alias("k")
    parts = [
        t.lineitem.groupBy(key).agg(F.count("*").alias("n_lines"), F.max("l_quantity").alias("max_quantity")),
        t.lineitem.groupBy(key).agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned")),
        t.orders.join(t.customer, F.col("o_custkey") == F.when(F.col("c_acctbal") > 5000, F.col("c_custkey"))).select(
            F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("segment")
        ),
    ]
    base = t.orders.select(F.col("o_orderkey").alias("k"))
    return joins.star_left_join(base, parts, "k", ["n_lines", "n_returned"])


@query(
    "outer_join_chain",
    """
    WITH a AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE c_acctbal > 9000) AS n_rich FROM customer GROUP BY 1),
    b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1),
    c AS (SELECT c_nationkey + 9 AS k, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n_orders
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT k, n_rich, n_suppliers, n_orders FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)
    """,
)
def _outer_join_chain(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count_if(F.col("c_acctbal") > 9000).alias("n_rich"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    low = F.count_if(F.col("o_orderpriority") == "5-LOW")
    # Keys are shifted, so that some exist on one side only.
    c = placed.groupBy((F.col("c_nationkey") + 9).alias("k")).agg(low.alias("n_orders"))
    return joins.outer_join_chain([a, b, c], ["k"])


@query(
    "union_keys_panel",
    """
    WITH o AS (SELECT c_nationkey AS k, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS ordered
               FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY 1, 2),
    l AS (SELECT s_nationkey AS k, CAST(year(l_shipdate) AS INT) AS year, round(sum(l_quantity), 2) AS shipped
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    keys AS (SELECT k, year FROM o UNION SELECT k, year FROM l),
    r AS (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation)
    SELECT k, year, n_name, ordered, shipped, n_regionkey
    FROM keys LEFT JOIN o USING (k, year) LEFT JOIN l USING (k, year) LEFT JOIN r USING (k)
    WHERE k IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 4)
    """,
)
def _union_keys_panel(t: Tables) -> DataFrame:
    ordered = (
        t.orders.join(t.customer, F.col("o_custkey") == F.when(F.col("c_nationkey") != 3, F.col("c_custkey")))
        .groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("year"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
    )
    shipped = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("k"), F.year("l_shipdate").alias("year"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("shipped"))
    )
    static = t.nation.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    valid = static.withColumn("k", F.when(F.col("n_regionkey") != 4, F.col("k")))
    return joins.union_keys_panel([ordered, shipped], [static], "k", "year", valid, ["n_name"])


CONFIG = linking.LinkConfig(fuzzy_threshold=0.86, score_gap_for_conflict=0.03, top_n_candidates=5)


def norm_sql(column: str) -> str:
    words = "['inc','corp','corporation','co','company','ltd','llc','plc','sa','ag','nv','group','holdings','holding']"
    split = f"string_split(regexp_replace(lower({column}), '[^a-z0-9 ]+', ' ', 'g'), ' ')"
    return f"array_to_string(list_filter({split}, lambda x: x <> '' AND NOT list_contains({words}, x)), ' ')"


def sim_sql(a: str, b: str) -> str:
    return f"(1.0 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE))"


def score_sql(a: str, b: str) -> str:
    sorted_a = f"array_to_string(list_sort(string_split({a}, ' ')), ' ')"
    sorted_b = f"array_to_string(list_sort(string_split({b}, ' ')), ' ')"
    return f"greatest({sim_sql(a, b)}, 0.95::DOUBLE * {sim_sql(sorted_a, sorted_b)})"


LINK_CTES = f"""
    f AS (SELECT fr.gvkey, fr.firm_name, fr.patent_count, {norm_sql('fr.firm_name')} AS fn,
                 coalesce(upper(trim(h.ticker)), '') AS hint
          FROM {{firms}} fr LEFT JOIN {{hints_raw}} h USING (gvkey)),
    r AS (SELECT lpad(cik, 10, '0') AS cik, upper(ticker) AS ticker, sec_name, exchange, {norm_sql('sec_name')} AS sn
          FROM {{registry_raw}}),
    names AS (SELECT DISTINCT fn FROM f),
    rnames AS (SELECT DISTINCT sn FROM r),
    exact AS (
      SELECT fn, NULL AS hint, cik, ticker, sec_name, exchange, 1.0::DOUBLE AS score, 'exact_normalized_name' AS method
      FROM names JOIN r ON fn = sn
      UNION ALL
      SELECT fn, NULL, cik, ticker, sec_name, exchange, 0.985::DOUBLE, 'exact_compact_name'
      FROM names JOIN r ON replace(fn, ' ', '') = replace(sn, ' ', '')
      UNION ALL
      SELECT fn, hint, cik, ticker, sec_name, exchange, least(1.0::DOUBLE, {score_sql('fn', 'sn')} + 0.08::DOUBLE), 'ticker_hint'
      FROM (SELECT DISTINCT fn, hint FROM f WHERE hint <> '') JOIN r ON hint = ticker),
    scored AS (SELECT fn, sn, {score_sql('fn', 'sn')} AS score FROM names, rnames),
    best20 AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY score DESC, sn) AS rn FROM scored WHERE score >= 0.86),
    fuzzy AS (SELECT fn, NULL AS hint, cik, ticker, sec_name, exchange, score, 'fuzzy_name' AS method
              FROM best20 JOIN r USING (sn) WHERE rn <= 20)
"""
RESOLVE_CTES = f"""
    {LINK_CTES},
    profiles AS (SELECT DISTINCT fn, hint FROM f),
    cands AS (
      SELECT p.fn, p.hint, e.cik, e.ticker, e.sec_name, e.exchange, e.score, e.method
      FROM (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy) e JOIN profiles p ON p.fn = e.fn AND e.hint IS NULL
      UNION ALL SELECT fn, hint, cik, ticker, sec_name, exchange, score, method FROM exact WHERE hint IS NOT NULL),
    ranked AS (SELECT *, CASE method WHEN 'exact_normalized_name' THEN 0 WHEN 'exact_compact_name' THEN 1
                              WHEN 'ticker_hint' THEN 2 ELSE 3 END AS mr FROM cands),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fn, hint, cik
               ORDER BY score DESC, mr, sec_name, ticker, exchange) AS rn FROM ranked) WHERE rn = 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY fn, hint ORDER BY score DESC, mr, cik) AS crank,
                   count(*) OVER (PARTITION BY fn, hint) AS n_cand,
                   lead(score) OVER (PARTITION BY fn, hint ORDER BY score DESC, mr, cik) AS second FROM best),
    links AS (
      SELECT f.gvkey, f.firm_name, f.patent_count, t.cik, t.ticker, t.sec_name, t.exchange,
             coalesce(t.method, 'unlinked') AS link_method, coalesce(t.score, 0.0) AS link_score,
             coalesce(t.score - t.second < 0.03, false) AS link_conflict, coalesce(t.n_cand, 0) AS candidate_count,
             f.hint AS ticker_hint
      FROM f LEFT JOIN top t ON t.fn = f.fn AND t.hint = f.hint AND t.crank = 1)
"""


def prepared(t: Tables) -> tuple[DataFrame, DataFrame]:
    firms = linking.prepare_firms(t.view("firms"), t.view("hints_raw"))
    return firms, linking.prepare_registry(t.view("registry_raw"))


@query(
    "link_exact",
    f"""WITH {LINK_CTES} SELECT fn AS firm_name_norm, hint AS ticker_hint, cik, ticker, sec_name, exchange,
        round(score, 8) AS score, method FROM exact""",
)
def _link_exact(t: Tables) -> DataFrame:
    return rounded(linking.link_exact(*prepared(t)))


@query(
    "link_fuzzy",
    f"WITH {LINK_CTES} SELECT fn AS firm_name_norm, cik, ticker, sec_name, exchange, round(score, 8) AS score, method FROM fuzzy",
)
def _link_fuzzy(t: Tables) -> DataFrame:
    return rounded(linking.link_fuzzy(*prepared(t), CONFIG))


@query(
    "link_resolve",
    f"WITH {RESOLVE_CTES} SELECT * REPLACE (round(link_score, 8) AS link_score) FROM links",
)
def _link_resolve(t: Tables) -> DataFrame:
    registry = linking.prepare_registry(t.view("registry_raw"))
    links, _, _ = linking.link_firms(t.view("firms"), registry, t.view("hints_raw"), CONFIG)
    return rounded(links)


@query(
    "link_candidates_top",
    f"""
    WITH {RESOLVE_CTES}
    SELECT f.gvkey, CAST(t.crank AS INT) AS candidate_rank, t.cik AS candidate_cik, t.method AS candidate_method,
           round(t.score, 8) AS candidate_score
    FROM f JOIN top t ON t.fn = f.fn AND t.hint = f.hint WHERE t.crank <= 5
    """,
)
def _link_candidates_top(t: Tables) -> DataFrame:
    registry = linking.prepare_registry(t.view("registry_raw"))
    _, top, _ = linking.link_firms(t.view("firms"), registry, t.view("hints_raw"), CONFIG)
    return rounded(top.select("gvkey", "candidate_rank", "candidate_cik", "candidate_method", "candidate_score"))


@query(
    "manual_override",
    f"""
    WITH {RESOLVE_CTES},
    m AS (SELECT 'F' || CAST(p_partkey AS VARCHAR) AS gvkey, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS mcik
          FROM part WHERE p_type = 'STANDARD')
    SELECT l.gvkey, l.firm_name, l.patent_count, coalesce(m.mcik, l.cik) AS cik, r.ticker, r.sec_name, r.exchange,
           CASE WHEN m.mcik IS NOT NULL THEN 'manual_override' ELSE l.link_method END AS link_method,
           round(CASE WHEN m.mcik IS NOT NULL THEN 1.0 ELSE l.link_score END, 8) AS link_score,
           CASE WHEN m.mcik IS NOT NULL THEN false ELSE l.link_conflict END AS link_conflict,
           l.candidate_count, l.ticker_hint
    FROM links l LEFT JOIN m USING (gvkey) LEFT JOIN r ON r.cik = coalesce(m.mcik, l.cik)
    """,
)
def _manual_override(t: Tables) -> DataFrame:
    registry = linking.prepare_registry(t.view("registry_raw"))
    links, _, _ = linking.link_firms(t.view("firms"), registry, t.view("hints_raw"), CONFIG)
    manual = t.part.where("p_type = 'STANDARD'").select(
        F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("gvkey"), F.col("p_partkey").cast("string").alias("cik")
    )
    return rounded(linking.manual_override(links, linking.manual_links(manual), registry))


@query(
    "attach_links_to_panel",
    """
    WITH panel AS (SELECT o_custkey AS gvkey, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_orders FROM orders GROUP BY 1, 2),
    links AS (SELECT c_custkey AS gvkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS cik, c_mktsegment AS link_method FROM customer),
    facts AS (SELECT s_nationkey AS cik, CAST(year(l_shipdate) AS INT) AS year, round(sum(l_extendedprice), 2) AS revenue
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    lf AS (SELECT DISTINCT gvkey, link_method, cik, year, revenue FROM links JOIN facts USING (cik))
    SELECT gvkey, year, n_orders, cik, link_method, revenue FROM panel LEFT JOIN lf USING (gvkey, year)
    """,
)
def _attach_links_to_panel(t: Tables) -> DataFrame:
    panel = t.orders.groupBy(F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n_orders")
    )
    links = t.customer.select(
        F.col("c_custkey").alias("gvkey"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("cik"),
        F.col("c_mktsegment").alias("link_method"),
    )
    facts = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("cik"), F.year("l_shipdate").alias("year"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    )
    return joins.attach_links_to_panel(panel, links, facts, "gvkey", "cik", "year")


@query(
    "attach_context",
    """
    WITH p AS (SELECT o_custkey, o_orderpriority AS sector, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n
               FROM orders GROUP BY 1, 2, 3),
    a AS (SELECT o_orderpriority AS sector, CAST(year(o_orderdate) AS INT) AS year, round(avg(o_totalprice), 4) AS sector_mean
          FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
    b AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS shipped FROM lineitem GROUP BY 1)
    SELECT p.*, sector_mean, shipped FROM p LEFT JOIN a USING (sector, year) LEFT JOIN b USING (year)
    """,
)
def _attach_context(t: Tables) -> DataFrame:
    o = t.orders.withColumn("year", F.year("o_orderdate")).withColumnRenamed("o_orderpriority", "sector")
    panel = o.groupBy("o_custkey", "sector", "year").agg(F.count("*").alias("n"))
    final = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    sector = o.groupBy("sector", "year").agg(F.round(F.avg(final), 4).alias("sector_mean"))
    yearly = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("shipped"))
    return joins.attach_context(panel, [(sector, ["sector", "year"]), (yearly, ["year"])])


@query(
    "window_citation_join",
    """
    SELECT u.patent_id, cy.app_year AS citing_year, u.app_year AS cited_year, e.category, count(*) AS n
    FROM {edges} e JOIN {citing_year} cy USING (citing_id) JOIN {cited} u ON e.patent_id = u.patent_id
    WHERE cy.app_year BETWEEN u.app_year AND u.app_year + 3 GROUP BY 1, 2, 3, 4
    """,
)
def _window_citation_join(t: Tables) -> DataFrame:
    joined = edges.window_citation_join(
        t.view("edges"), t.view("cited"), t.view("citing_year"), "patent_id", "citing_id", "app_year", 3
    )
    return joined.groupBy("patent_id", "citing_year", "cited_year", "category").agg(F.count("*").alias("n"))


@query(
    "year_or_mode_join",
    """
    WITH fy AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS year, min(o_orderpriority) AS sic
                FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
    c AS (SELECT k, sic, count(*) AS n FROM fy GROUP BY 1, 2),
    m AS (SELECT k, sic AS sic_mode FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, sic) AS rn FROM c) WHERE rn = 1)
    SELECT o_orderkey, coalesce(fy.sic, m.sic_mode) AS sic_raw
    FROM orders o LEFT JOIN fy ON fy.k = o_custkey AND fy.year = year(o_orderdate) LEFT JOIN m ON m.k = o_custkey
    """,
)
def _year_or_mode_join(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    final = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    fy = o.groupBy("k", "year").agg(F.min(final).alias("sic"))
    mode = ranking.mode_by_key(fy, "k", "sic", "sic_mode")
    out = joins.year_or_mode_join(o, fy, mode, "k", "year", "sic", "sic_mode", "sic_raw")
    return out.select("o_orderkey", "sic_raw")


CROSSWALK = "SELECT CAST(p_size AS VARCHAR(10)) AS sic_key, substr(p_brand, 7) AS naics_code FROM {part}"


@query(
    "fractional_allocate",
    f"""
    WITH pairs AS (SELECT DISTINCT sic_key, naics_code FROM ({CROSSWALK})),
    d AS (SELECT sic_key, count(*) AS n FROM pairs GROUP BY 1)
    SELECT naics_code, round(sum(1.0::DOUBLE / n), 6) AS items, count(*) AS raw_links
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN pairs ON sic_key = CAST(p_size AS VARCHAR) JOIN d USING (sic_key)
    GROUP BY 1
    """,
)
def _fractional_allocate(t: Tables) -> DataFrame:
    weights = aggregates.fractional_weights(t.sql(CROSSWALK), "sic_key", "naics_code")
    facts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_size").cast("string").alias("sic_key"), F.lit(0).alias("year"), F.lit(1).alias("flag")
    )
    out = aggregates.industry_year_weighted(facts, weights, "sic_key", "year", "flag", [], [])
    return rounded(out.select("naics_code", F.col("patent_count").alias("items"), "raw_links"), 6)


@query(
    "build_crosswalk",
    """
    SELECT DISTINCT CAST(p_size AS VARCHAR) AS sic_key, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS naics6,
           substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 1, 2) AS naics2,
           substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 1, 3) AS naics3,
           substr(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), 1, 4) AS naics4
    FROM part WHERE p_type <> 'PROMO'
    """,
)
def _build_crosswalk(t: Tables) -> DataFrame:
    raw = t.part.select(
        F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.concat(F.lit("0"), F.col("p_size").cast("string"))).alias("old"),
        F.concat(F.col("p_partkey").cast("string"), F.lit(" T")).alias("new"),
    )
    return aggregates.build_crosswalk(raw, "new", "old")


@query(
    "policy_attach",
    """
    WITH policy AS (SELECT 'N' || chr(65 + s_nationkey) || 'T' AS iso3c, CAST(year(l_shipdate) AS INT) AS year,
                           count(*) AS n_measures
                    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 2 GROUP BY 1, 2)
    SELECT s.patent_id, m.iso3 AS iso3c, p.n_measures
    FROM {scored} s LEFT JOIN {iso_map} m ON s.assignee_iso2 = m.iso2
    LEFT JOIN policy p ON p.iso3c = m.iso3 AND p.year = s.app_year
    """,
)
def _policy_attach(t: Tables) -> DataFrame:
    code = F.concat(F.lit("N"), F.char(F.lit(65) + F.col("s_nationkey")), F.lit("T"))
    policy = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.when(F.col("s_nationkey") != 2, F.col("s_suppkey")))
        .groupBy(code.alias("iso3c"), F.year("l_shipdate").alias("year"))
        .agg(F.count("*").alias("n_measures"))
    )
    rows = t.view("scored").select("patent_id", F.lower("assignee_iso2").alias("iso2"), "app_year")
    out = joins.policy_attach(rows, t.view("iso_map"), policy, "iso2", "app_year")
    return out.select("patent_id", "iso3c", "n_measures")


@query(
    "threshold_cross_join",
    """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.9) AS threshold FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice >= threshold THEN 1 ELSE 0 END AS top_decile FROM orders, q
    """,
)
def _threshold_cross_join(t: Tables) -> DataFrame:
    marked = ranking.with_quantile(t.orders, "o_totalprice", 0.9, "threshold")
    return joins.threshold_flag(marked, "o_totalprice", "threshold", "top_decile").select("o_orderkey", "top_decile")


@query(
    "variant_inner_join",
    """
    WITH a AS (SELECT assignee_iso2 || 'T' AS iso3c, app_year AS year, avg(benchmark_flag) AS v FROM {scored} GROUP BY 1, 2),
    b AS (SELECT inventor_iso2 AS iso3c, app_year AS year, avg(benchmark_flag) AS v FROM {scored}
          WHERE inventor_iso2 IS NOT NULL GROUP BY 1, 2)
    SELECT iso3c, year, round(a.v, 8) AS left_value, round(b.v, 8) AS right_value, round(a.v - b.v, 8) AS difference
    FROM a JOIN b USING (iso3c, year)
    """,
)
def _variant_inner_join(t: Tables) -> DataFrame:
    s = t.view("scored")
    a = s.groupBy(F.concat("assignee_iso2", F.lit("T")).alias("iso3c"), F.col("app_year").alias("year")).agg(
        F.avg("benchmark_flag").alias("v")
    )
    b = s.where("inventor_iso2 IS NOT NULL").groupBy(F.col("inventor_iso2").alias("iso3c"), F.col("app_year").alias("year")).agg(
        F.avg("benchmark_flag").alias("v")
    )
    return rounded(joins.variant_inner_join(a, b, ["iso3c", "year"], "v"))


@query(
    "top_firms",
    """
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25)
    SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_orders FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM n) GROUP BY 1, 2
    """,
)
def _top_firms(t: Tables) -> DataFrame:
    panel = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n_orders"))
    names = t.orders.groupBy("o_custkey").agg(F.count("*").alias("patent_count"))
    return describe.top_firms(panel, names, "o_custkey", "patent_count", 25)
