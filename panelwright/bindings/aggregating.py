"""Aggregates and edge metrics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, edges, ranking
from ..sources import payloads
from .base import Tables, query, rounded, sql_rounded
from .scalars import HTML_SQL, TERMS, keyword_sql
from .sources import FACTS_SQL, facts_payload

FIRM_YEAR_SQL = """
    SELECT l_suppkey AS gvkey, CAST(year(l_shipdate) AS INT) AS year, count(DISTINCT l_orderkey) AS patents_applied,
           count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS patents_granted,
           count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS private_subsidiary_patents,
           count(DISTINCT l_linenumber) AS distinct_assignee_names,
           round(count(CASE WHEN l_returnflag = 'R' THEN 1 END) / count(DISTINCT l_orderkey), 8) AS private_subsidiary_share
    FROM lineitem WHERE l_tax > 0 GROUP BY 1, 2
"""


@query("firm_year_panel", FIRM_YEAR_SQL)
def _firm_year_panel(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("owner"),
        F.year("l_shipdate").alias("year"),
        "l_orderkey",
        F.when(F.col("l_linestatus") == "F", 1).alias("granted"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("private"),
        "l_linenumber",
    )
    return rounded(aggregates.firm_year_panel(rows, "owner", "year", "l_orderkey", "granted", "private", "l_linenumber"))


@query(
    "patent_universe",
    """
    SELECT l_partkey AS patent_id, min(CAST(year(l_shipdate) AS INT)) AS app_year,
           max(CASE WHEN l_linestatus = 'F' THEN CAST(year(l_shipdate) AS INT) + 1 END) AS grant_year
    FROM lineitem GROUP BY 1
    """,
)
def _patent_universe(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_partkey").alias("patent_id"),
        F.year("l_shipdate").alias("a"),
        F.when(F.col("l_linestatus") == "F", F.year("l_shipdate") + 1).alias("g"),
    )
    return aggregates.patent_universe(rows, "patent_id", "a", "g")


@query(
    "app_year_map",
    """
    SELECT o_custkey AS patent_id, min(CAST(year(o_orderdate) AS INT)) AS app_year FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY 1
    """,
)
def _app_year_map(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("9"), day)).otherwise(F.concat(F.lit(" "), day))
    rows = t.orders.select(F.col("o_custkey").alias("patent_id"), date.alias("filing_date"))
    return aggregates.app_year_map(rows, "patent_id", "filing_date")


@query(
    "cpc_profile",
    """
    SELECT l_orderkey, count(*) AS cpc_total_count, count(DISTINCT p_brand) AS cpc_unique_subclass_count,
           max(CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END) AS has_first,
           max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_returned,
           sum(CASE WHEN upper(substr(p_name, 1, 1)) = 'B' THEN 1 ELSE 0 END)::BIGINT AS "cpc_section_B_count",
           sum(CASE WHEN upper(substr(p_name, 1, 1)) = 'S' THEN 1 ELSE 0 END)::BIGINT AS "cpc_section_S_count"
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def _cpc_profile(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        "p_brand",
        F.upper(F.substring("p_name", 1, 1)).alias("section"),
        F.col("p_brand").startswith("Brand#1").cast("int").alias("has_first"),
        (F.col("l_returnflag") == "R").cast("int").alias("has_returned"),
    )
    return aggregates.class_profile(rows, "l_orderkey", "p_brand", "section", ["has_first", "has_returned"], ["B", "S"])


@query(
    "gov_interest",
    """
    SELECT user_id, count(*) AS gov_interest_statement_count,
           max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS is_publicly_funded
    FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1
    """,
)
def _gov_interest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.when(F.col("event_type") == "purchase", "stated").otherwise("  ").alias("gi_statement"))
    universe = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return aggregates.gov_interest(rows, universe, "user_id", "gi_statement")


AGENCY = """
    SELECT user_id, CASE event_type WHEN 'purchase' THEN 'Army' WHEN 'click' THEN 'NASA Ames' WHEN 'view' THEN 'NSF'
                                    WHEN 'error' THEN ' ' ELSE 'Institutes of Health' END AS agency,
           CASE WHEN value > 20 THEN 'Department of Energy' WHEN value < 1 THEN 'Department of Defense' END AS department
    FROM {events}
"""


@query(
    "gov_org_profile",
    f"""
    SELECT user_id, CAST(len(n) AS BIGINT) AS gov_interest_org_count,
           CAST(list_contains(who, 'army') OR list_contains(who, 'navy') OR list_contains(who, 'air force')
                OR list_bool_or(list_transform(departments, lambda x: contains(x, 'defense'))) AS INT) AS has_dod_funding,
           CAST(list_bool_or(list_transform(who || departments, lambda x: contains(x, 'nasa'))) AS INT) AS has_nasa_funding,
           CAST(list_bool_or(list_transform(who || departments, lambda x: contains(x, 'health'))) AS INT) AS has_hhs_funding,
           CAST(list_bool_or(list_transform(who || departments, lambda x: contains(x, 'energy'))) AS INT) AS has_doe_funding,
           CAST(list_contains(who, 'nsf') OR list_bool_or(list_transform(who, lambda x: contains(x, 'science foundation'))) AS INT)
             AS has_nsf_funding,
           list_sort(list_transform(n, lambda x: {{'minus': -CAST(x.value AS BIGINT), 'name': x.key}}))[1].name AS top_funding_agency
    FROM (SELECT user_id, coalesce(map_entries(histogram(a) FILTER (WHERE a <> '')), []) AS n,
                 list(DISTINCT lower(coalesce(a, ''))) AS who, list(DISTINCT coalesce(lower(department), '')) AS departments
          FROM (SELECT *, trim(agency) AS a FROM ({AGENCY})) SEMI JOIN customer ON user_id = c_custkey GROUP BY user_id)
    """,
)
def _gov_org_profile(t: Tables) -> DataFrame:
    universe = t.customer.select(F.col("c_custkey").alias("user_id"))
    return aggregates.gov_org_profile(t.sql(AGENCY), universe, "user_id", "agency", "department")


DELAYS = """
    SELECT e.patent_id, e.citing_id, e.category, y.app_year - u.app_year AS delay
    FROM {edges} e JOIN {cited} u USING (patent_id) LEFT JOIN {citing_year} y ON y.citing_id = e.citing_id
"""
FORWARD_SQL = f"""
    WITH seen AS (SELECT patent_id, list(delay) AS delays, list(delay) FILTER (WHERE category = 'A') AS examined, count(citing_id) AS n
                  FROM ({DELAYS}) GROUP BY patent_id)
    SELECT patent_id, coalesce(n, 0) AS forward_citation_count_all,
           coalesce(len(list_filter(delays, lambda x: x IN (0, 1, 2))), 0) AS forward_citation_count_2y,
           coalesce(len(list_filter(delays, lambda x: x IN (0, 1, 2, 3, 4))), 0) AS forward_citation_count_4y,
           coalesce(len(list_filter(examined, lambda x: x IN (0, 1, 2, 3, 4))), 0) AS forward_citation_examiner_4y
    FROM (SELECT patent_id FROM {{cited}}) LEFT JOIN seen USING (patent_id)
"""


@query("forward_citations", FORWARD_SQL)
def _forward_citations(t: Tables) -> DataFrame:
    return edges.forward_citations(
        t.view("edges"), t.view("cited"), t.view("citing_year"), "patent_id", "citing_id", "category", "app_year",
        {"forward_citation_count_2y": 2, "forward_citation_count_4y": 4},
        {"forward_citation_examiner_4y": ("A", 4)},
    )


@query(
    "backward_citations",
    """
    SELECT l_orderkey AS citing_id, count(*) AS backward_patent_citation_count FROM lineitem
    WHERE l_partkey % 7 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1
    """,
)
def _backward_citations(t: Tables) -> DataFrame:
    universe = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("citing_id"))
    cites = t.view("edges").withColumn("patent_id", F.when(F.col("patent_id") % 7 != 0, F.col("patent_id")))
    return edges.backward_citations(cites, universe, "citing_id", "patent_id")


@query(
    "citation_breadth",
    f"""
    WITH near AS (SELECT patent_id, list(DISTINCT subclass) AS found
                  FROM ({DELAYS}) JOIN {{citing_class}} USING (citing_id) WHERE delay IN (0, 1, 2, 3, 4) GROUP BY patent_id)
    SELECT c.patent_id, coalesce(len(list_distinct(list_transform(found, lambda x: left(x, 4)))), 0) AS citing_cpc4_count_4y,
           coalesce(len(found), 0) AS citing_cpc_subclass_count_4y
    FROM {{cited}} c LEFT JOIN near ON near.patent_id = c.patent_id
    """,
)
def _citation_breadth(t: Tables) -> DataFrame:
    pairs = edges.distinct_edges(t.view("edges"), "patent_id", "citing_id")
    return edges.citation_breadth(
        pairs, t.view("cited"), t.view("citing_year"), t.view("citing_class"), "patent_id", "citing_id", "subclass", "app_year", 4
    )


@query(
    "small_firm_citations",
    f"""
    WITH sized AS (SELECT patent_id, map(list(citing_id), list(employees)) AS size_of
                   FROM (SELECT DISTINCT patent_id, citing_id, employees
                         FROM ({DELAYS}) LEFT JOIN {{citing_size}} USING (citing_id) WHERE delay IN (0, 1, 2, 3, 4)) GROUP BY patent_id),
    counted AS (SELECT patent_id, coalesce(cardinality(size_of), 0)::BIGINT AS every,
                       coalesce(len(list_filter(map_values(size_of), lambda x: x IS NOT NULL)), 0) AS sized,
                       coalesce(len(list_filter(map_values(size_of), lambda x: x < 500)), 0) AS small
                FROM (SELECT patent_id FROM {{cited}}) LEFT JOIN sized USING (patent_id))
    SELECT patent_id, every AS citing_patents_4y, sized AS citing_patents_with_size_4y, small AS citing_small_firm_patents_4y,
           CASE WHEN sized > 0 THEN round(small / sized, 8) END AS small_firm_citation_share_4y_linked,
           CASE WHEN every > 0 THEN round(sized / every, 8) END AS small_firm_citation_size_coverage_4y
    FROM counted
    """,
)
def _small_firm_citations(t: Tables) -> DataFrame:
    pairs = edges.distinct_edges(t.view("edges"), "patent_id", "citing_id")
    out = edges.small_firm_citations(
        pairs, t.view("cited"), t.view("citing_year"), t.view("citing_size"), "patent_id", "citing_id", "app_year",
        "employees", 500, 4,
    )
    return rounded(out)


INTRO_SQL = "SELECT label, min(s.app_year) AS intro_year FROM {part_class} c JOIN {shipped} s USING (patent_id) GROUP BY 1"


@query("class_intro_year", INTRO_SQL)
def _class_intro_year(t: Tables) -> DataFrame:
    years = aggregates.patent_universe(t.view("shipped").withColumn("g", F.lit(None).cast("int")), "patent_id", "app_year", "g")
    return edges.class_intro_year(t.view("part_class"), years, "patent_id", "label", "app_year", "intro_year")


@query(
    "class_ahead",
    """
    WITH uses AS (SELECT label, min(app_year) AS first_use FROM {shipped} NATURAL JOIN {part_class} GROUP BY label),
    gaps AS (SELECT patent_id, first_use - app_year AS gap FROM {cited} NATURAL JOIN {part_class} NATURAL JOIN uses)
    SELECT c.patent_id,
           CASE WHEN EXISTS (FROM gaps g WHERE g.patent_id = c.patent_id)
                THEN coalesce((SELECT max(gap) FROM gaps g WHERE g.patent_id = c.patent_id AND gap > 0), 0) END AS years_ahead_of_cpc_intro,
           CAST(EXISTS (FROM gaps g WHERE g.patent_id = c.patent_id AND gap > 0) AS INT) AS opens_new_cpc_field_flag
    FROM {cited} c
    """,
)
def _class_ahead(t: Tables) -> DataFrame:
    classes = t.view("part_class")
    intro = edges.class_intro_year(classes, t.view("shipped"), "patent_id", "label", "app_year", "intro_year")
    return edges.class_ahead(classes, t.view("cited"), intro, "patent_id", "label", "app_year", "intro_year")


@query(
    "first_generation_flag",
    """
    WITH ranked AS (SELECT patent_id, app_year, min(app_year) OVER (PARTITION BY label) AS oldest FROM {cited} NATURAL JOIN {part_class})
    SELECT c.patent_id, (SELECT min(oldest) FROM ranked r WHERE r.patent_id = c.patent_id) AS patent_uspc_first_app_year_min,
           CAST(c.patent_id IN (SELECT patent_id FROM ranked WHERE app_year = oldest) AS INT) AS is_first_gen_uspc_class
    FROM {cited} c
    """,
)
def _first_generation_flag(t: Tables) -> DataFrame:
    return edges.first_generation_flag(t.view("part_class"), t.view("cited"), "patent_id", "label", "app_year")


PRIOR_SQL = """
    SELECT owner_id, patent_id, app_year,
           dense_rank() OVER (PARTITION BY owner_id ORDER BY {'year': app_year, 'item': patent_id}) - 1 AS prior_count
    FROM (SELECT owner_id, patent_id, app_year FROM {owner_links} GROUP BY ALL)
"""


@query(
    "owner_productivity",
    f"""
    SELECT patent_id, count(*) AS owner_count, round(avg(prior_count), 8) AS owner_productivity_mean_prior_count,
           max(prior_count) AS owner_productivity_max_prior_count
    FROM ({PRIOR_SQL}) GROUP BY 1
    """,
)
def _owner_productivity(t: Tables) -> DataFrame:
    prior = ranking.prior_count(t.view("owner_links"), "owner_id", "patent_id", "app_year", "prior_count")
    return rounded(edges.owner_productivity(prior, "patent_id", "prior_count", "owner"))


@query(
    "annual_mean_series",
    """
    SELECT CAST(day(ts) AS INT) AS year, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS s_click,
           round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS s_view
    FROM events WHERE event_type IN ('click', 'view') AND day(ts) BETWEEN 3 AND 25 GROUP BY 1
    """,
)
def _annual_mean_series(t: Tables) -> DataFrame:
    rows = t.events.select("ts", "event_type", F.col("value").cast("string").alias("value"))
    names = {"click": "s_click", "view": "s_view"}
    return rounded(aggregates.annual_mean_series(rows, F.dayofmonth("ts"), "event_type", "value", names, 3, 25), 6)


@query(
    "filtered_series_mean",
    """
    SELECT s_nationkey AS k, CAST(year(l_shipdate) AS INT) AS year,
           round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O'), 6) AS a_open,
           round(avg(l_extendedprice) FILTER (WHERE l_returnflag IN ('R', 'N')), 6) AS rn,
           round(avg(l_extendedprice) FILTER (WHERE l_linenumber = 7 AND l_linestatus = 'F'), 6) AS seventh
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
    HAVING a_open IS NOT NULL OR rn IS NOT NULL OR seventh IS NOT NULL
    """,
)
def _filtered_series_mean(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumns(
        {"k": F.col("s_nationkey"), "year": F.year("l_shipdate")}
    )
    specs = {
        "a_open": {"l_returnflag": "A", "l_linestatus": "O"},
        "rn": {"l_returnflag": ["R", "N"]},
        "seventh": {"l_linenumber": 7, "l_linestatus": "F"},
    }
    return rounded(aggregates.filtered_series_mean(rows, ["k", "year"], "l_extendedprice", specs), 6)


@query(
    "top_measures_pivot",
    """
    WITH low AS (SELECT user_id, CAST(day(ts) AS INT) AS day, event_type, if(value < 20, value, NULL) AS value FROM events),
    top AS (SELECT event_type, count(value) AS n FROM low GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3),
    e AS (SELECT user_id, day, event_type, value, dense_rank() OVER (ORDER BY event_type) AS i FROM low JOIN top USING (event_type))
    SELECT user_id, day, round(avg(value) FILTER (WHERE i = 1), 6) AS first_measure,
           round(avg(value) FILTER (WHERE i = 2), 6) AS second_measure, round(avg(value) FILTER (WHERE i = 3), 6) AS third_measure
    FROM e GROUP BY 1, 2
    """,
)
def _top_measures_pivot(t: Tables) -> DataFrame:
    low = F.when(F.col("value") < 20, F.col("value"))
    rows = t.events.withColumns({"day": F.dayofmonth("ts"), "value": low})
    out = aggregates.top_measures_pivot(rows, ["user_id", "day"], "event_type", "value", 3, "m_", "_mean")
    return rounded(out.toDF("user_id", "day", "first_measure", "second_measure", "third_measure"), 6)


@query(
    "oecd_clean",
    """
    SELECT patent_id, assignee_iso2 || 'T' AS iso3c, app_year AS year, round(benchmark_score, 10) AS obs_value
    FROM {scored} WHERE assignee_iso2 <> 'NE' AND o_orderstatus <> 'P'
    """,
)
def _oecd_clean(t: Tables) -> DataFrame:
    area = F.when(F.col("assignee_iso2") == "NE", "ne9").otherwise(F.concat(F.lower("assignee_iso2"), F.lit("t")))
    rows = t.view("scored").select(
        "patent_id",
        area.alias("REF_AREA"),
        F.concat(F.col("app_year").cast("string"), F.lit(".2")).alias("TIME_PERIOD"),
        F.when(F.col("o_orderstatus") == "P", "..").otherwise(F.col("benchmark_score").cast("string")).alias("OBS_VALUE"),
    )
    out = aggregates.oecd_clean(rows, "REF_AREA", "TIME_PERIOD", "OBS_VALUE")
    return rounded(out.select("patent_id", "iso3c", "year", "obs_value"), 10)


@query(
    "count_by",
    """
    SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS chapter, o_orderstatus, count(*) AS n_measures
    FROM orders GROUP BY 1, 2
    """,
)
def _count_by(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("chapter", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return aggregates.count_by(rows, ["chapter", "o_orderstatus"])


@query(
    "keyword_features_by_firm_year",
    f"""
    WITH p AS (SELECT page_id, url, {HTML_SQL} AS text FROM pages), k AS (SELECT url, {keyword_sql('text')} FROM p)
    SELECT regexp_extract(url, '//([^/:]+)', 1) AS host, max(kw_article) AS kw_article, max(kw_noun) AS kw_noun,
           max(kw_link) AS kw_link, max(kw_total) AS kw_total
    FROM k GROUP BY 1
    """,
)
def _keyword_features(t: Tables) -> DataFrame:
    clean = t.pages.select(F.regexp_extract("url", "//([^/:]+)", 1).alias("host"), text.clean_html_text("html").alias("text"))
    counted = clean.select("host", *text.keyword_counts("text", TERMS, "kw_total"))
    return aggregates.keyword_features_by_firm_year(counted, ["host"], [*TERMS, "kw_total"])


FACTS_CTES = f"""
    WITH f AS ({FACTS_SQL}),
    r AS (
      SELECT *, CASE tag WHEN 'Revenues' THEN 0 WHEN 'SalesRevenueNet' THEN 1 ELSE 0 END AS tr,
             CASE WHEN tag IN ('Revenues', 'SalesRevenueNet') THEN 'revenue'
                  WHEN tag = 'ResearchAndDevelopmentExpense' THEN 'rd_expense'
                  WHEN tag = 'NumberOfEmployees' THEN 'employees' ELSE 'capex' END AS metric FROM f),
    b AS (SELECT o_custkey, year, metric, value FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey, year, metric ORDER BY tr DESC, unit DESC, position DESC, value DESC) AS rn FROM r)
          WHERE rn = 1),
    w AS (SELECT o_custkey, year, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue,
                 max(CASE WHEN metric = 'rd_expense' THEN value END) AS rd_expense,
                 max(CASE WHEN metric = 'capex' THEN value END) AS capex,
                 max(CASE WHEN metric = 'employees' THEN value END) AS employees FROM b GROUP BY 1, 2)
"""


@query(
    "firm_year_facts",
    f"""{FACTS_CTES}
    SELECT o_custkey, year, round(revenue, 2) AS revenue, round(rd_expense, 2) AS rd_expense, round(capex, 2) AS capex,
           round(employees, 2) AS employees, round(rd_expense / nullif(revenue, 0), 8) AS rd_to_revenue,
           round(capex / nullif(revenue, 0), 8) AS capex_to_revenue
    FROM w
    """,
)
def _firm_year_facts(t: Tables) -> DataFrame:
    docs = t.orders.select("o_custkey", facts_payload().alias("j"))
    facts = payloads.flatten_facts_json(docs, "j", ["o_custkey"])
    wide = aggregates.firm_year_facts(facts, "o_custkey", "year", "tag", "unit", "value", "position")
    money = ["revenue", "rd_expense", "capex", "employees"]
    ratios = ["rd_to_revenue", "capex_to_revenue"]
    return wide.select(
        "o_custkey", "year", *[F.round(c, 2).alias(c) for c in money], *[F.round(c, 8).alias(c) for c in ratios]
    )


def submissions_payload() -> F.Column:
    """A submissions document built from one customer: its profile and three filings, the second not an annual one."""
    key, start = F.col("c_custkey"), 1993 + F.col("c_custkey") % 7

    def texts(*parts: F.Column | str) -> F.Column:
        return F.array(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def day(year: F.Column, rest: str) -> F.Column:
        return F.concat(year.cast("string"), F.lit(rest))

    recent = F.struct(
        texts(key * 10, key * 10 + 1, key * 10 + 2).alias("accessionNumber"),
        texts(day(start + 1, "-02-01"), day(start + 1, "-02-02"), day(start + 1, "-03-15")).alias("filingDate"),
        texts(day(start, "-12-31"), day(start, "-12-31"), "").alias("reportDate"),
        texts("10-K", "8-K", "20-F").alias("form"),
        texts(key * 7 % 97, key % 5, key * 11 % 89).alias("primaryDocument"),
    )
    return F.to_json(
        F.struct(
            (key % 90 + 10).cast("string").alias("sic"), F.col("c_mktsegment").alias("sicDescription"), F.lit("DE").alias("stateOfIncorporation"),
            F.lit("1231").alias("fiscalYearEnd"), F.lit("operating").alias("entityType"), F.col("c_name").alias("name"),
            F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(texts("T", "second")).alias("tickers"),
            F.struct(recent.alias("recent")).alias("filings"),
        )
    )


@query(
    "firm_year_facts_with_context",
    f"""{FACTS_CTES},
    filed AS (SELECT c_custkey, 1993 + c_custkey % 7 + late AS year, if(late = 0, c_custkey * 7 % 97, c_custkey * 11 % 89) AS page_id
              FROM customer, (VALUES (0), (1)) AS v(late)),
    words AS (SELECT page_id, {keyword_sql('text')} FROM (SELECT page_id, {HTML_SQL} AS text FROM pages)),
    texts AS (SELECT c_custkey, year, max(kw_article) AS kw_article, max(kw_noun) AS kw_noun, max(kw_link) AS kw_link,
                     max(kw_total) AS kw_total FROM filed JOIN words USING (page_id) GROUP BY 1, 2)
    SELECT o_custkey, w.year, round(revenue, 2) AS revenue, round(rd_expense / nullif(revenue, 0), 8) AS rd_to_revenue,
           kw_article, kw_noun, kw_link, kw_total, CAST(c.c_custkey % 90 + 10 AS VARCHAR) AS sic, c_mktsegment AS sic_description,
           if(c.c_custkey IS NULL, NULL, 'DE') AS state_of_incorporation, if(c.c_custkey IS NULL, NULL, '1231') AS fiscal_year_end,
           if(c.c_custkey IS NULL, NULL, 'operating') AS entity_type, c_name AS name_sec, if(c.c_custkey % 3 = 0, NULL, 'T') AS ticker_sec
    FROM w LEFT JOIN texts t ON t.c_custkey = o_custkey AND t.year = w.year LEFT JOIN customer c ON c.c_custkey = o_custkey
    """,
)
def _firm_year_facts_with_context(t: Tables) -> DataFrame:
    facts = payloads.flatten_facts_json(t.orders.select("o_custkey", facts_payload().alias("j")), "j", ["o_custkey"])
    wide = aggregates.firm_year_facts(facts, "o_custkey", "year", "tag", "unit", "value", "position")
    submissions = t.customer.select(F.col("c_custkey").alias("o_custkey"), submissions_payload().alias("j"))
    filings = payloads.flatten_filings_json(submissions, "j", ["o_custkey"])
    annual = aggregates.filing_year(filings, "form", "reportDate", "filingDate", ["accessionNumber", "primaryDocument"])
    annual = annual.select("o_custkey", "year", F.col("primaryDocument").cast("long").alias("page_id"))
    features = aggregates.filing_features(annual, t.pages, "page_id", "html", ["o_custkey", "year"], TERMS, "kw_total")
    out = aggregates.facts_with_context(wide, "o_custkey", "year", features, payloads.firm_profile_json(submissions, "j", ["o_custkey"]))
    return out.select(
        "o_custkey", "year", F.round("revenue", 2).alias("revenue"), F.round("rd_to_revenue", 8).alias("rd_to_revenue"), *TERMS, "kw_total",
        "sic", "sic_description", "state_of_incorporation", "fiscal_year_end", "entity_type", "name_sec", "ticker_sec",
    )


def country_scores_sql(country: str, year: str) -> str:
    """Sums per country, year and number of claims; every measure is then a ratio of such sums."""
    names = [*aggregates.SCORE_COLUMNS, "benchmark_score", "benchmark_confidence"]
    sums = ", ".join(f"sum({c}) AS {c}_sum" for c in names)
    means = ", ".join(f"round(sum({c}_sum) / sum(n), 12) AS {c}_mean" for c in names)
    return f"""
    WITH cut AS (SELECT quantile_cont(benchmark_score, 0.9) AS top FROM {{scored}}),
    cell AS (SELECT {country} AS iso3c, {year} AS year, num_claims AS claims, count(*) AS n, sum(benchmark_flag) AS flagged,
                    count(*) FILTER (WHERE benchmark_score >= (SELECT top FROM cut)) AS tops, {sums}
             FROM {{scored}} GROUP BY ALL)
    SELECT iso3c, year, CAST(sum(n) AS BIGINT) AS patent_count, CAST(sum(flagged) AS BIGINT) AS data_driven_patent_count,
           round(sum(flagged) / sum(n), 12) AS data_driven_patent_share, round(sum(tops) / sum(n), 12) AS benchmark_top_decile_share,
           {means},
           round(sum(claims * benchmark_score_sum) FILTER (WHERE claims > 0) / sum(claims * n) FILTER (WHERE claims > 0), 12)
             AS claims_weighted_benchmark_score_mean
    FROM cell WHERE iso3c IS NOT NULL GROUP BY iso3c, year
    """


def scored_with_codes(t: Tables) -> DataFrame:
    s = t.view("scored").withColumn("assignee_iso3", F.concat("assignee_iso2", F.lit("T")))
    return ranking.with_quantile(s, "benchmark_score", 0.9, "threshold")


@query("country_year_scores", country_scores_sql("assignee_iso2 || 'T'", "app_year"))
def _country_year_scores(t: Tables) -> DataFrame:
    return rounded(aggregates.country_year_scores(scored_with_codes(t), "assignee_iso3", "app_year"), 12)


@query(
    "country_year_derived",
    """
    SELECT assignee_iso2, app_year, count(*) AS patent_count, round(avg(benchmark_score), 8) AS benchmark_score_mean,
           round(avg(coalesce(CASE WHEN o_orderstatus <> 'P' THEN benchmark_flag END, 0)), 8) AS empirical_driven_share,
           round(avg(CASE WHEN num_claims > 10 THEN num_claims END), 8) AS claims_mean
    FROM {scored} GROUP BY 1, 2
    """,
)
def _country_year_derived(t: Tables) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") != "P", F.col("benchmark_flag"))
    means = {
        "benchmark_score_mean": "benchmark_score",
        "empirical_driven_share": F.coalesce(flag, F.lit(0)),
        "claims_mean": F.when(F.col("num_claims") > 10, F.col("num_claims")),
    }
    return rounded(aggregates.country_year_derived(t.view("scored"), "assignee_iso2", "app_year", means))


@query(
    "firm_year_derived",
    """
    WITH fy AS (SELECT o_custkey AS gvkey, CAST(year(o_orderdate) AS INT) AS year,
                       sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS revenue, count(*) AS employees
                FROM orders GROUP BY 1, 2),
    fp AS (SELECT gvkey, app_year AS year, count(*) AS patent_count_linked, avg(benchmark_score) AS benchmark_score_mean,
                  avg(benchmark_flag) AS empirical_driven_share
           FROM {scored} WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
    SELECT gvkey, year, round(revenue, 2) AS revenue, employees, patent_count_linked,
           round(benchmark_score_mean, 8) AS benchmark_score_mean, round(empirical_driven_share, 8) AS empirical_driven_share,
           round(ln(greatest(coalesce(revenue, 0), 0) + 1), 8) AS ln_sales_plus1,
           round(ln(greatest(coalesce(patent_count_linked, 0), 0) + 1), 8) AS ln_patent_count_plus1,
           round(ln(greatest(coalesce(revenue / nullif(employees, 0), 0), 0) + 1), 8) AS ln_sales_per_worker_plus1
    FROM fy LEFT JOIN fp USING (gvkey, year)
    """,
)
def _firm_year_derived(t: Tables) -> DataFrame:
    from ..plans.derived import firm_year_derived

    facts = t.orders.groupBy(F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").alias("year")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("revenue"),
        F.count("*").alias("employees"),
    )
    items = t.view("scored").withColumn("gvkey", F.when(F.col("o_orderstatus") != "P", F.col("gvkey")))
    out = firm_year_derived(
        facts, items, "gvkey", "app_year",
        {"benchmark_score_mean": "benchmark_score", "empirical_driven_share": F.coalesce("benchmark_flag", F.lit(0))},
        {"ln_sales_plus1": "revenue", "ln_patent_count_plus1": "patent_count_linked"},
    )
    return rounded(out.withColumn("revenue", F.round("revenue", 2)))


WEIGHTED_SQL = """
    WITH codes AS (SELECT CAST(p_size AS VARCHAR) AS sic_key, list(DISTINCT substr(p_brand, 7)) AS naics FROM part GROUP BY p_size),
    totals AS (SELECT CAST(p_size AS VARCHAR) AS sic_key, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n,
                      count(*) FILTER (WHERE l_returnflag = 'R') AS flagged, sum(l_discount) AS score,
                      count(*) FILTER (WHERE l_linestatus = 'O') AS open,
                      sum(l_tax * 100) FILTER (WHERE l_tax > 0.02) AS level, count(*) FILTER (WHERE l_tax > 0.02) AS levelled,
                      count(*) FILTER (WHERE l_linenumber = 3) AS law, count(*) FILTER (WHERE l_linenumber > 2) AS judged
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    shared AS (SELECT unnest(naics) AS naics_code, year, n, n / len(naics) AS items, flagged / len(naics) AS flags, score / len(naics) AS scores,
                      open / len(naics) AS opens, level / len(naics) AS levels, levelled / len(naics) AS levelled,
                      law / len(naics) AS laws, judged / len(naics) AS judged
               FROM totals JOIN codes USING (sic_key))
    SELECT naics_code, year, round(sum(items), 6) AS patent_count, round(sum(flags), 6) AS data_driven_patent_count,
           round(sum(scores) / sum(items), 8) AS score_mean, round(sum(opens) / sum(items), 8) AS open_share,
           CASE WHEN sum(levelled) > 0 THEN round(sum(levels) / sum(levelled), 8) END AS policy_level_mean,
           CASE WHEN sum(judged) > 0 THEN round(sum(laws) / sum(judged), 8) END AS policy_law_share,
           CAST(sum(n) AS BIGINT) AS raw_links, round(sum(flags) / sum(items), 8) AS data_driven_patent_share
    FROM shared GROUP BY naics_code, year
"""


@query("industry_year_weighted", WEIGHTED_SQL)
def _industry_year_weighted(t: Tables) -> DataFrame:
    from .joining import CROSSWALK

    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_size").cast("string").alias("sic_key"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("flag"),
        F.col("l_discount").alias("score"),
        (F.col("l_linestatus") == "O").cast("int").alias("open"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100).alias("level"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber") - 2).alias("law"),
    )
    weights = aggregates.fractional_weights(t.sql(CROSSWALK), "sic_key", "naics_code")
    out = aggregates.industry_year_weighted(
        rows, weights, "sic_key", "year", "flag", ["score"], ["open"], {"policy_level_mean": "level"}, ("policy_law_share", "law")
    )
    six = {"patent_count", "data_driven_patent_count"}
    return out.select(
        *[F.round(c, 6 if c in six else 8).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes]
    )


@query(
    "coverage_report",
    """
    SELECT count(*) AS n_rows, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_with_done,
           count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n_with_big, count(o_orderkey) AS n_with_o_orderkey
    FROM orders
    """,
)
def _coverage_report(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", 1).alias("done"),
        F.when(F.col("o_totalprice") > 100000, 1).alias("big"),
    )
    return aggregates.coverage_report(rows, ["done", "big", "o_orderkey"])


TECH_FLAGS = (
    "has_measurement_cpc", "has_testing_cpc", "has_ml_cpc", "has_data_processing_cpc", "has_bio_assay_cpc", "has_statistics_cpc",
)


@query(
    "tech_breakdown",
    """
    SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE has_measurement_cpc END AS has_measurement_cpc, has_testing_cpc, has_ml_cpc,
           has_data_processing_cpc, has_bio_assay_cpc, has_statistics_cpc, count(*) AS n_patents,
           round(avg(benchmark_score), 8) AS benchmark_score_mean, round(avg(benchmark_flag), 8) AS benchmark_flag_share
    FROM {scored} GROUP BY 1, 2, 3, 4, 5, 6
    """,
)
def _tech_breakdown(t: Tables) -> DataFrame:
    rows = t.view("scored").withColumn(
        "has_measurement_cpc", F.when(F.col("o_orderstatus") != "P", F.col("has_measurement_cpc"))
    )
    means = {"benchmark_score_mean": "benchmark_score", "benchmark_flag_share": "benchmark_flag"}
    return rounded(aggregates.breakdown(rows, TECH_FLAGS, means, 200))


@query(
    "tech_group_mix",
    """
    WITH truth(grp, measured, learned, tested, processed) AS (VALUES
      ('Other/none', [0], [0], [0], [0]), ('ML only', [0], [1], [0, 1], [0, 1]), ('Testing only', [0], [0], [1], [0, 1]),
      ('Measurement only', [1], [0], [0, 1], [0, 1]), ('Data-processing only', [0], [0], [0], [1]),
      ('Measurement + ML', [1], [1], [0, 1], [0, 1]))
    SELECT grp, count(*) AS n_patents, round(sum(benchmark_flag) / count(*), 8) AS share_flag
    FROM {scored} JOIN truth ON has_measurement_cpc IN measured AND has_ml_cpc IN learned
      AND has_testing_cpc IN tested AND has_data_processing_cpc IN processed GROUP BY grp
    """,
)
def _tech_group_mix(t: Tables) -> DataFrame:
    group = aggregates.technology_group("has_measurement_cpc", "has_testing_cpc", "has_ml_cpc", "has_data_processing_cpc")
    rows = t.view("scored").withColumn("grp", group)
    return rounded(aggregates.breakdown(rows, ["grp"], {"share_flag": "benchmark_flag"}))


@query(
    "yearly_distribution",
    """
    SELECT app_year, count(*) AS n_patents, round(avg(benchmark_score), 8) AS benchmark_mean,
           round(quantile_cont(benchmark_score, 0.1), 8) AS p10, round(quantile_cont(benchmark_score, 0.5), 8) AS p50,
           round(quantile_cont(benchmark_score, 0.9), 8) AS p90
    FROM {scored} GROUP BY 1
    """,
)
def _yearly_distribution(t: Tables) -> DataFrame:
    return rounded(aggregates.yearly_distribution(t.view("scored"), "app_year", "benchmark_score"))


@query(
    "country_distribution",
    """
    SELECT inventor_iso2 AS iso3c, count(*) AS n_patents, round(avg(benchmark_score), 8) AS benchmark_mean,
           round(avg(benchmark_flag), 8) AS benchmark_share
    FROM {scored} WHERE inventor_iso2 IS NOT NULL GROUP BY 1
    """,
)
def _country_distribution(t: Tables) -> DataFrame:
    rows = t.view("scored").where(F.col("inventor_iso2").rlike("^[A-Z]{3}$")).withColumnRenamed("inventor_iso2", "iso3c")
    means = {"benchmark_mean": "benchmark_score", "benchmark_share": "benchmark_flag"}
    return rounded(aggregates.breakdown(rows, ["iso3c"], means))


@query(
    "funding_time_trend",
    """
    SELECT app_year AS year, has_ml_cpc AS is_publicly_funded, count(*) AS n_patents, round(avg(benchmark_flag), 8) AS empirical_share,
           round(avg(benchmark_score), 8) AS benchmark_score_mean
    FROM {scored} WHERE app_year BETWEEN 1996 AND 2000 GROUP BY 1, 2
    """,
)
def _funding_time_trend(t: Tables) -> DataFrame:
    rows = t.view("scored").where(F.col("app_year").between(1996, 2000))
    rows = rows.withColumnsRenamed({"app_year": "year", "has_ml_cpc": "is_publicly_funded"})
    means = {"empirical_share": F.coalesce("benchmark_flag", F.lit(0)), "benchmark_score_mean": "benchmark_score"}
    return rounded(aggregates.breakdown(rows, ["year", "is_publicly_funded"], means))


@query(
    "agency_leaders",
    """
    SELECT coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) END, 'Unknown') AS agency,
           count(*) AS patent_count, round(avg(benchmark_flag), 8) AS empirical_share, round(avg(benchmark_score), 8) AS benchmark_score_mean
    FROM {scored} WHERE has_ml_cpc = 1 GROUP BY 1 HAVING count(*) >= 30 ORDER BY patent_count DESC, agency LIMIT 20
    """,
)
def _agency_leaders(t: Tables) -> DataFrame:
    agency = F.when(F.col("c_mktsegment") != "BUILDING", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")))
    means = {"empirical_share": F.coalesce("benchmark_flag", F.lit(0)), "benchmark_score_mean": "benchmark_score"}
    rows = t.view("scored").where("has_ml_cpc = 1")
    return rounded(aggregates.having_count(rows, F.coalesce(agency, F.lit("Unknown")), "agency", means, 30, 20))


@query(
    "country_pattern",
    """
    SELECT assignee_iso2 AS iso2, count(*) AS patent_count, round(avg(benchmark_flag), 8) AS empirical_share,
           round(avg(has_ml_cpc), 8) AS public_share
    FROM {scored} GROUP BY 1 HAVING count(*) >= 600
    """,
)
def _country_pattern(t: Tables) -> DataFrame:
    means = {"empirical_share": F.coalesce("benchmark_flag", F.lit(0)), "public_share": "has_ml_cpc"}
    rows = t.view("scored").where("assignee_iso2 IS NOT NULL")
    return rounded(aggregates.having_count(rows, F.col("assignee_iso2"), "iso2", means, 600))
