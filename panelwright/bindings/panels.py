"""Whole panels, composed from the operators, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, linking
from ..plans import backbone, countries, derived, evidence, firms, industries
from .aggregating import AGENCY
from .base import Tables, query, rounded
from .describing import VARIANTS_SQL
from .joining import RESOLVE_CTES

STATIC = """
    SELECT CASE WHEN l_returnflag <> 'N' THEN 'us' ELSE 'xx' END || CAST(l_orderkey AS VARCHAR(20)) AS patent_id,
           CAST(year(l_shipdate) AS VARCHAR(4)) AS "appYear",
           CASE WHEN l_linestatus = 'F' THEN CAST(year(l_shipdate) + 2 AS VARCHAR(8)) || '.0' END AS "grantYear"
    FROM {lineitem}
"""
CLASS_ROWS = """
    SELECT 'uS' || CAST(l_orderkey AS VARCHAR(20)) AS patent_id,
           CASE WHEN p_size % 4 = 0 THEN 'g06n' WHEN p_size % 4 = 1 THEN 'G01N' WHEN p_size % 4 = 2 THEN 'H04L' ELSE 'A61B' END AS cpc_subclass,
           CASE WHEN p_size % 4 = 0 THEN 'G06N7/00' WHEN p_size % 4 = 1 THEN 'G01N33/' || p_brand ELSE 'X' END AS cpc_group
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


@query(
    "backbone",
    f"""
    WITH u AS (SELECT if(l_returnflag = 'N', 'XX', 'US') || CAST(l_orderkey AS VARCHAR) AS patent_id,
                      CAST(min(year(l_shipdate)) AS INT) AS app_year,
                      CAST(max(CASE WHEN l_linestatus = 'F' THEN year(l_shipdate) + 2 END) AS INT) AS grant_year
               FROM lineitem GROUP BY 1),
    core AS (SELECT 'US' || CAST(o_orderkey AS VARCHAR) AS patent_id, CAST(year(o_orderdate) AS INT) AS patent_date_year,
                    CAST(o_orderdate AS DATE) AS patent_date, 'utility' AS patent_type, o_orderstatus AS patent_abstract,
                    o_orderpriority AS patent_title, CAST(round(o_totalprice / 1000) AS INT) AS num_claims FROM orders),
    pl AS (SELECT 'US' || CAST(l_orderkey AS VARCHAR) AS patent_id, 'N' || chr(65 + s_nationkey) AS country, l_linenumber AS seq
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 5),
    md AS (SELECT patent_id, country FROM (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY n DESC, country) AS rn
             FROM (SELECT patent_id, country, count(*) AS n FROM pl GROUP BY 1, 2)) WHERE rn = 1),
    fs AS (SELECT patent_id, country FROM (SELECT *, row_number() OVER (PARTITION BY patent_id ORDER BY seq, country) AS rn FROM pl) WHERE rn = 1),
    c AS (SELECT upper(patent_id) AS patent_id, count(*) AS cpc_total_count, count(DISTINCT upper(cpc_subclass)) AS cpc_unique_subclass_count,
                 max(CASE WHEN cpc_subclass = 'g06n' THEN 1 ELSE 0 END) AS has_ml_cpc,
                 max(CASE WHEN cpc_subclass = 'G01N' THEN 1 ELSE 0 END) AS has_measurement_cpc,
                 max(CASE WHEN cpc_group LIKE 'G06N7%' THEN 1 ELSE 0 END) AS has_statistics_cpc,
                 sum(CASE WHEN upper(cpc_subclass) LIKE 'G%' THEN 1 ELSE 0 END)::BIGINT AS "cpc_section_G_count"
          FROM ({CLASS_ROWS}) GROUP BY 1)
    SELECT patent_id, app_year, grant_year, patent_date, patent_date_year, patent_type, patent_abstract, patent_title, num_claims,
           md.country AS assignee_country_mode, fs.country AS assignee_country_primary, md.country AS inventor_country_mode,
           fs.country AS inventor_country_primary, cpc_total_count, cpc_unique_subclass_count, has_ml_cpc, has_measurement_cpc,
           has_statistics_cpc, "cpc_section_G_count"
    FROM u LEFT JOIN core USING (patent_id) LEFT JOIN md USING (patent_id) LEFT JOIN fs USING (patent_id) LEFT JOIN c USING (patent_id)
    """,
)
def _backbone(t: Tables) -> DataFrame:
    key = F.concat(F.lit(' us'), F.col("o_orderkey").cast("string")).alias("patent_id")
    parties = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit('"Us'), F.col("l_orderkey").cast("string"), F.lit('"')).alias("patent_id"),
        F.concat(F.lit("L"), F.col("s_nationkey").cast("string")).alias("location_id"),
        F.col("l_linenumber").cast("string").alias("assignee_sequence"),
    )
    places = t.nation.select(
        F.concat(F.lit("l"), F.col("n_nationkey").cast("string")).alias("location_id"),
        F.when(F.col("n_nationkey") != 5, F.concat(F.lit("n"), F.char(F.lit(65) + F.col("n_nationkey")))).alias("disambig_country"),
    )
    inputs = backbone.BackboneInputs(
        static=t.sql(STATIC.replace('"', "`")),
        core=t.orders.select(
            key,
            F.lit("utility").alias("patent_type"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("patent_date"),
            F.col("o_orderpriority").alias("patent_title"),
            (F.col("o_totalprice") / 1000).cast("string").alias("num_claims"),
        ),
        abstracts=t.orders.select(key, F.col("o_orderstatus").alias("patent_abstract")),
        assignees=parties,
        inventors=parties.withColumnRenamed("assignee_sequence", "inventor_sequence"),
        locations=places,
        classes=t.sql(CLASS_ROWS).withColumn("cpc_section", F.substring("cpc_subclass", 1, 1)),
    )
    return backbone.build_backbone(inputs).select(
        "patent_id", "app_year", "grant_year", "patent_date", "patent_date_year", "patent_type", "patent_abstract", "patent_title", "num_claims", "assignee_country_mode",
        "assignee_country_primary", "inventor_country_mode", "inventor_country_primary", "cpc_total_count", "cpc_unique_subclass_count", "has_ml_cpc", "has_measurement_cpc",
        "has_statistics_cpc", "cpc_section_G_count",
    )


# Items are parts ('P...'); the items that cite them are orders ('O...').
ITEMS = """
    SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS patent_id, CAST(1992 + p_size % 8 AS INT) AS app_year,
           CAST(1994 + p_size % 8 AS INT) AS grant_year, 'N' || chr(CAST(65 + p_partkey % 25 AS INT)) AS assignee_country_mode,
           'N' || chr(CAST(65 + p_size % 25 AS INT)) AS inventor_country_mode, p_size AS num_claims
    FROM {part}
"""
EVIDENCE = """
    SELECT 'P' || CAST(p_partkey AS VARCHAR(20)) AS patent_id, (p_retailprice - 900) / 1103 AS benchmark_score,
           CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS benchmark_flag
    FROM {part}
"""
DERIVED_SQL = f"""
    WITH u AS ({ITEMS}), e AS ({EVIDENCE}),
    ay AS (SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS citing, CAST(year(o_orderdate) AS INT) AS y FROM orders),
    cit AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS patent_id, 'O' || CAST(l_orderkey AS VARCHAR) AS citing,
                   CASE WHEN l_returnflag = 'A' THEN 'cited by examiner' ELSE 'cited by applicant' END AS cat FROM lineitem),
    cls AS (SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS citing, c_mktsegment || '-' || o_orderpriority AS sub
            FROM orders JOIN customer ON o_custkey = c_custkey),
    fy AS (SELECT if(o_orderstatus = 'F', o_custkey, -o_custkey) AS gvkey, CAST(year(o_orderdate) AS INT) AS year,
                  CAST(count(*) * 97 AS DOUBLE) AS employees FROM orders GROUP BY 1, 2),
    fm AS (SELECT gvkey, list_sort(list_transform(map_entries(histogram(round(employees))), lambda x: [-CAST(x.value AS DOUBLE), x.key]))[1][2] AS b
           FROM fy GROUP BY gvkey),
    sz AS (SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS citing, coalesce(fy.employees, fm.b) AS employees
           FROM orders LEFT JOIN fy ON fy.gvkey = o_custkey AND fy.year = year(o_orderdate) LEFT JOIN fm ON fm.gvkey = o_custkey),
    dated AS (SELECT patent_id, citing, cat, y - app_year AS delay, sub, employees
              FROM cit JOIN u USING (patent_id) LEFT JOIN ay USING (citing) LEFT JOIN cls USING (citing) LEFT JOIN sz USING (citing)),
    cites AS (SELECT patent_id, count(*) AS f_all, count(*) FILTER (WHERE delay BETWEEN 0 AND 5) AS f5,
                     count(*) FILTER (WHERE delay BETWEEN 0 AND 10) AS f10,
                     count(*) FILTER (WHERE delay BETWEEN 0 AND 10 AND cat = 'cited by examiner') AS fe,
                     count(DISTINCT sub) FILTER (WHERE delay BETWEEN 0 AND 10) AS n_sub,
                     count(DISTINCT left(sub, 4)) FILTER (WHERE delay BETWEEN 0 AND 10) AS n_sub4,
                     count(DISTINCT citing) FILTER (WHERE delay BETWEEN 0 AND 10) AS n_citing,
                     count(DISTINCT citing) FILTER (WHERE delay BETWEEN 0 AND 10 AND employees IS NOT NULL) AS n_sized,
                     count(DISTINCT citing) FILTER (WHERE delay BETWEEN 0 AND 10 AND employees < 500) AS n_small
              FROM dated GROUP BY patent_id),
    intro AS (SELECT upper(p_brand) AS label, min(CAST(year(o_orderdate) AS INT)) AS y0
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    ahead AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS patent_id, greatest(y0 - (1992 + p_size % 8), 0) AS years_ahead
              FROM part JOIN intro ON label = upper(p_brand)),
    ref AS (SELECT 'P' || CAST(doc_id AS VARCHAR) AS patent_id, count(*) AS n_ref,
                   count(*) FILTER (WHERE regexp_matches(lower(text), '{aggregates.SCIENCE_REFERENCE}')) AS n_sci FROM documents GROUP BY 1),
    gi AS (SELECT 'P' || CAST(user_id AS VARCHAR) AS patent_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS funded FROM events GROUP BY 1),
    lk AS (SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS owner, 'P' || CAST(l_partkey AS VARCHAR) AS patent_id FROM lineitem),
    pr AS (SELECT patent_id, dense_rank() OVER (PARTITION BY owner ORDER BY {{'year': app_year, 'item': patent_id}}) - 1 AS prior
           FROM lk JOIN u USING (patent_id)),
    iv AS (SELECT patent_id, count(*) AS n_inv, avg(prior) AS mean_prior, max(prior) AS max_prior FROM pr GROUP BY 1)
    SELECT u.patent_id, u.app_year, round(benchmark_score, 9) AS benchmark_score, coalesce(funded, 0) AS is_publicly_funded,
           coalesce(n_ref, 0) AS other_reference_count, coalesce(n_sci, 0) AS science_reference_count,
           coalesce(f_all, 0) AS forward_citation_count_all, coalesce(f5, 0) AS forward_citation_count_5y,
           coalesce(f10, 0) AS forward_citation_count_10y, coalesce(fe, 0) AS forward_citation_examiner_10y,
           round(ln(1 + coalesce(f10, 0)), 9) AS ln_forward_citation_count_10y_plus1,
           coalesce(n_sub, 0) AS citing_cpc_subclass_count_10y, coalesce(n_sized, 0) AS citing_patents_with_size_10y,
           coalesce(n_small, 0) AS citing_small_firm_patents_10y, coalesce(n_sub4, 0) AS citing_cpc4_count_10y,
           coalesce(n_citing, 0) AS citing_patents_10y,
           round(n_sized / nullif(n_citing, 0), 9) AS small_firm_citation_size_coverage_10y,
           round(n_small / nullif(n_sized, 0), 9) AS small_firm_citation_share_10y_linked,
           coalesce(years_ahead, 0) AS years_ahead_of_cpc_intro, coalesce(n_inv, 0) AS inventor_count,
           round(coalesce(mean_prior, 0), 9) AS inventor_productivity_mean_prior_count, coalesce(max_prior, 0) AS inventor_productivity_max_prior_count
    FROM u LEFT JOIN e USING (patent_id) LEFT JOIN gi USING (patent_id) LEFT JOIN ref USING (patent_id) LEFT JOIN cites USING (patent_id)
    LEFT JOIN ahead USING (patent_id) LEFT JOIN iv USING (patent_id)
"""
# The same without rounding, for tables built on top of it.
DERIVED_RAW_SQL = DERIVED_SQL.replace("round(benchmark_score, 9)", "benchmark_score").replace("round(ln(1 + coalesce(f10, 0)), 9)", "ln(1 + coalesce(f10, 0))")
DERIVED_COLUMNS = [
    "patent_id", "app_year", "benchmark_score", "is_publicly_funded", "other_reference_count", "science_reference_count",
    "forward_citation_count_all", "forward_citation_count_5y", "forward_citation_count_10y", "forward_citation_examiner_10y",
    "ln_forward_citation_count_10y_plus1", "citing_cpc_subclass_count_10y", "citing_patents_with_size_10y",
    "citing_small_firm_patents_10y", "citing_cpc4_count_10y", "citing_patents_10y", "small_firm_citation_size_coverage_10y",
    "small_firm_citation_share_10y_linked", "years_ahead_of_cpc_intro", "inventor_count",
    "inventor_productivity_mean_prior_count", "inventor_productivity_max_prior_count",
]


def tagged(tag: str, column: str) -> F.Column:
    return F.concat(F.lit(tag), F.col(column).cast("string"))


def derived_inputs(t: Tables) -> derived.DerivedInputs:
    with_part = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    order_class = t.view("citing_class").select(tagged("O", "citing_id").alias("patent_id"), F.col("subclass").alias("cpc_subclass"))
    part_class = t.part.select(tagged("P", "p_partkey").alias("patent_id"), F.upper("p_brand").alias("cpc_subclass"))
    agency = t.sql(AGENCY)
    facts = (
        t.orders.groupBy(
            F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-F.col("o_custkey")).alias("gvkey"),
            F.year("o_orderdate").alias("year"),
        )
        .agg(
            (F.count("*") * 97).cast("double").alias("employees"),
            F.sum("o_totalprice").alias("revenue"),
            F.max("o_totalprice").alias("rd_expense"),
            F.min("o_totalprice").alias("capex"),
        )
    )
    cited_by = F.when(F.col("l_returnflag") == "A", "cited by examiner").otherwise("cited by applicant")
    return derived.DerivedInputs(
        universe=t.sql(ITEMS),
        evidence=t.sql(EVIDENCE),
        applications=t.orders.select(tagged("O", "o_orderkey").alias("patent_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date")),
        gov_interest=t.events.select(
            tagged("P", "user_id").alias("patent_id"), F.when(F.col("event_type") == "purchase", "stated").alias("gi_statement")
        ),
        gov_org=agency.select(
            tagged("P", "user_id").alias("patent_id"), F.col("agency").alias("fedagency_name"), F.col("department").alias("level_one")
        ),
        references=t.documents.select(tagged("P", "doc_id").alias("patent_id"), F.col("text").alias("other_reference_text")),
        citations=t.lineitem.select(
            tagged("P", "l_partkey").alias("patent_id"), tagged("O", "l_orderkey").alias("citing_patent_id"), cited_by.alias("citation_category")
        ),
        current_classes=order_class.unionByName(part_class),
        issue_classes=with_part.select(tagged("O", "l_orderkey").alias("patent_id"), F.upper("p_brand").alias("cpc_subclass")),
        main_classes=t.part.select(tagged("P", "p_partkey").alias("patent_id"), F.col("p_type").alias("uspc_mainclass_id")),
        inventors=t.lineitem.select(tagged("P", "l_partkey").alias("patent_id"), tagged("S", "l_suppkey").alias("inventor_id")),
        assignees=t.lineitem.select(tagged("P", "l_partkey").alias("patent_id"), tagged("A", "l_linenumber").alias("assignee_id")),
        owners=t.orders.select(tagged("O", "o_orderkey").alias("patent_id"), F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").alias("app_year")),
        firm_year=facts,
    )


@query("derived_variables", DERIVED_SQL)
def _derived_variables(t: Tables) -> DataFrame:
    return rounded(derived.patent_variables(derived_inputs(t)).select(*DERIVED_COLUMNS), 9)


@query(
    "derived_country_years",
    f"""
    SELECT u.assignee_country_mode AS iso2c, d.app_year AS year, count(*) AS patent_count, round(avg(d.benchmark_score), 7) AS benchmark_score_mean,
           round(avg(d.is_publicly_funded), 8) AS public_funded_share,
           round(avg(d.science_reference_count / nullif(d.other_reference_count, 0)), 8) AS science_reference_share_mean,
           round(avg(d.ln_forward_citation_count_10y_plus1), 7) AS ln_forward_citation_10y_plus1_mean,
           round(avg(d.years_ahead_of_cpc_intro), 8) AS years_ahead_cpc_mean
    FROM ({DERIVED_RAW_SQL}) d JOIN ({ITEMS}) u USING (patent_id) GROUP BY 1, 2
    """,
)
def _derived_country_years(t: Tables) -> DataFrame:
    panel = derived.country_year_panel(derived.patent_variables(derived_inputs(t)))
    short = {"benchmark_score_mean", "ln_forward_citation_10y_plus1_mean"}
    columns = [
        "iso2c", "year", "patent_count", "benchmark_score_mean", "public_funded_share", "science_reference_share_mean",
        "ln_forward_citation_10y_plus1_mean", "years_ahead_cpc_mean",
    ]
    kinds = dict(panel.dtypes)
    return panel.select(
        *[F.round(c, 7 if c in short else 8).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]
    )


FIRM_CHANGES = (
    "ln_sales_plus1", "ln_rd_plus1", "ln_capital_proxy_plus1", "ln_patent_count_plus1", "ln_sales_per_worker_plus1",
    "empirical_driven_share", "public_funded_share", "science_reference_share_mean",
)


@query(
    "firm_year_changes",
    f"""
    WITH d AS ({DERIVED_RAW_SQL}), flags AS ({EVIDENCE}),
    facts AS (SELECT if(o_orderstatus = 'F', o_custkey, -o_custkey) AS gvkey, CAST(year(o_orderdate) AS INT) AS year,
                     sum(o_totalprice) AS revenue, max(o_totalprice) AS rd_expense, min(o_totalprice) AS capex, count(*) * 97 AS workers
              FROM orders GROUP BY 1, 2),
    held AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS patent_id, p_partkey * 3 % 200 AS gvkey FROM part),
    linked AS (SELECT gvkey, app_year AS year, count(*) AS n, sum(benchmark_flag) / count(*) AS empirical_driven_share,
                      sum(is_publicly_funded) / count(*) AS public_funded_share,
                      avg(science_reference_count / nullif(other_reference_count, 0)) AS science_reference_share_mean
               FROM d JOIN flags USING (patent_id) JOIN held USING (patent_id) GROUP BY 1, 2),
    p AS (SELECT gvkey, year, n AS patent_count_linked, ln(1 + revenue) AS ln_sales_plus1, ln(1 + rd_expense) AS ln_rd_plus1,
                 ln(1 + capex) AS ln_capital_proxy_plus1, ln(1 + coalesce(n, 0)) AS ln_patent_count_plus1,
                 ln(1 + revenue / workers) AS ln_sales_per_worker_plus1, empirical_driven_share, public_funded_share, science_reference_share_mean
          FROM facts LEFT JOIN linked USING (gvkey, year))
    SELECT gvkey, year, patent_count_linked, {", ".join(f"round({c}, 7) AS {c}" for c in FIRM_CHANGES)},
           {", ".join(f"round(lead({c}, 5) OVER w - {c}, 7) AS d5_{c}" for c in FIRM_CHANGES)}
    FROM p WINDOW w AS (PARTITION BY gvkey ORDER BY year)
    """,
)
def _firm_year_changes(t: Tables) -> DataFrame:
    given = derived_inputs(t)
    owners = t.part.select(
        tagged("P", "p_partkey").alias("patent_id"), (F.col("p_partkey") * 3 % 200).alias("gvkey"), (1992 + F.col("p_size") % 8).alias("app_year")
    )
    panel = derived.firm_year_panel_with_changes(derived.patent_variables(given), owners, given.firm_year)
    names = [*FIRM_CHANGES, *[f"d5_{c}" for c in FIRM_CHANGES]]
    return panel.select("gvkey", "year", "patent_count_linked", *[F.round(c, 7).alias(c) for c in names])


INDUSTRY_ITEMS = """
    SELECT s.*, s.assignee_iso2 AS assignee_country_mode FROM {scored} s
"""
INDUSTRY_PANEL_SQL = f"""
    WITH own AS (SELECT o_orderkey AS patent_id, o_custkey AS gvkey FROM orders WHERE o_orderstatus <> 'P'),
    fy AS (SELECT o_custkey AS gvkey, CAST(year(o_orderdate) AS INT) AS year, min(CAST(1 + o_orderkey % 50 AS INT)) AS sic
           FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2),
    fm AS (SELECT gvkey, list_sort(list_transform(map_entries(histogram(sic)), lambda x: {{'minus': -CAST(x.value AS INT),
                    'name': CAST(x.key AS VARCHAR), 'sic': x.key}}))[1].sic AS sic FROM fy GROUP BY gvkey),
    pol AS (SELECT 'N' || chr(65 + s_nationkey) || 'T' AS iso3, CAST(year(l_shipdate) AS INT) AS year, count(*) AS cum
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 15 GROUP BY 1, 2),
    p AS (SELECT s.*, coalesce(fy.sic, fm.sic) AS sic, pol.cum FROM {{scored}} s LEFT JOIN own USING (patent_id)
          LEFT JOIN fy ON fy.gvkey = own.gvkey AND fy.year = s.app_year LEFT JOIN fm ON fm.gvkey = own.gvkey
          LEFT JOIN pol ON pol.iso3 = s.assignee_iso2 || 'T' AND pol.year = s.app_year),
    codes AS (SELECT p_size AS sic, list(DISTINCT substr(lpad(CAST(p_partkey * 7 AS VARCHAR), 6, '0'), 1, {{level}})) AS naics
              FROM part GROUP BY p_size),
    totals AS (SELECT sic, app_year AS year, count(*) AS n, sum(benchmark_flag) AS flagged, sum(benchmark_score) AS score, sum(has_ml_cpc) AS ml,
                      sum(cum) AS cum, count(cum) AS known FROM p GROUP BY ALL),
    shared AS (SELECT unnest(naics) AS naics_code, year, n, n / len(naics) AS items, flagged / len(naics) AS flags,
                      score / len(naics) AS scores, ml / len(naics) AS mls, cum / len(naics) AS cums, known / len(naics) AS knowns
               FROM totals JOIN codes USING (sic))
    SELECT naics_code, year, round(sum(items), 6) AS patent_count, round(sum(flags), 6) AS data_driven_patent_count,
           round(sum(scores) / sum(items), 8) AS benchmark_score_mean, round(sum(mls) / sum(items), 8) AS has_ml_cpc_share,
           CASE WHEN sum(knowns) > 0 THEN round(sum(cums) / sum(knowns), 6) END AS policy_ecipe_cum_mean,
           CAST(sum(n) AS BIGINT) AS raw_links, {{level}} AS naics_level
    FROM shared GROUP BY naics_code, year
"""


def industry_items(t: Tables) -> tuple[DataFrame, DataFrame]:
    owners = t.orders.select(
        F.col("o_orderkey").alias("patent_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("gvkey"), F.year("o_orderdate").alias("app_year")
    )
    firm_year = (
        t.orders.groupBy(F.col("o_custkey").alias("gvkey"), F.year("o_orderdate").alias("year"))
        .agg(F.min(F.when(F.col("o_orderpriority") != "5-LOW", 1 + F.col("o_orderkey") % 50).cast("int")).cast("string").alias("sic"))
    )
    code = F.concat(F.lit("N"), F.char(F.lit(65) + F.col("s_nationkey")), F.lit("T"))
    policy = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.when(F.col("s_nationkey") < 15, F.col("s_suppkey")))
        .groupBy(code.alias("iso3c"), F.year("l_shipdate").alias("year"))
        .agg(
            F.count("*").alias("ecipe_dte_n_measures_cum"),
            F.max("l_linenumber").alias("datagouv_privacy_level_ordinal"),
            F.min("l_linenumber").alias("unctad_privacy_and_data_protection_code"),
        )
    )
    items = t.sql(INDUSTRY_ITEMS).drop("gvkey")
    crosswalk = aggregates.build_crosswalk(
        t.part.select(F.col("p_size").cast("string").alias("old"), (F.col("p_partkey") * 7).cast("string").alias("new")), "new", "old"
    )
    return industries.items_with_industry(items, owners, firm_year, t.view("iso_map"), policy), crosswalk


@query("industry_panels", " UNION ALL ".join(f"SELECT * FROM ({INDUSTRY_PANEL_SQL.replace('{level}', str(n))})" for n in (2, 3, 4)))
def _industry_panels(t: Tables) -> DataFrame:
    items, crosswalk = industry_items(t)
    levels = industries.industry_levels(items, crosswalk)
    out = levels[2].unionByName(levels[3]).unionByName(levels[4])
    six = {"patent_count", "data_driven_patent_count", "policy_ecipe_cum_mean"}
    columns = [
        "naics_code", "year", "patent_count", "data_driven_patent_count", "benchmark_score_mean", "has_ml_cpc_share",
        "policy_ecipe_cum_mean", "raw_links", "naics_level",
    ]
    kinds = dict(out.dtypes)
    return out.select(*[F.round(c, 6 if c in six else 8).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


@query("evidence_country_years", VARIANTS_SQL)
def _evidence_country_years(t: Tables) -> DataFrame:
    scored = t.view("scored").withColumns(
        {"assignee_country_mode": F.lower("assignee_iso2"), "inventor_country_mode": F.col("inventor_iso2")}
    )
    return rounded(evidence.country_year_variants(scored, t.view("iso_map"))["all_variants"], 12)


@query(
    "country_panel",
    """
    WITH reg AS (SELECT if(n_nationkey = 11, 'ZZZ', 'N' || chr(65 + n_nationkey) || 'T') AS iso3c,
                        'Nation ' || CAST(n_nationkey AS VARCHAR) AS nm, n_nationkey AS k FROM nation),
    a AS (SELECT 'N' || chr(65 + c_nationkey) || 'T' AS iso3c, CAST(year(o_orderdate) AS INT) AS year, count(*)::DOUBLE AS resd
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY 1, 2),
    m AS (SELECT iso3c, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN reg ON k = if(l_returnflag = 'R', s_nationkey, NULL) GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY iso3c ORDER BY year)::BIGINT AS cum FROM m),
    keys AS (SELECT iso3c, year FROM a UNION SELECT iso3c, year FROM c)
    SELECT iso3c, year, nm AS country_name, round(ln(1 + resd), 9) AS log_patent_resident_plus1, n AS n_measures, cum AS n_measures_cum
    FROM keys JOIN reg USING (iso3c) LEFT JOIN a USING (iso3c, year) LEFT JOIN c USING (iso3c, year)
    """,
)
def _country_panel(t: Tables) -> DataFrame:
    def code(column: str) -> F.Column:
        return F.concat(F.lit("N"), F.char(F.lit(65) + F.col(column)), F.lit("T"))

    registry = t.nation.select(
        F.when(F.col("n_nationkey") != 11, code("n_nationkey")).otherwise("ZZZ").alias("iso3c"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("wb_country_name")
    )
    accounts = (
        t.orders.join(t.customer, F.col("o_custkey") == F.when(F.col("c_nationkey") != 3, F.col("c_custkey")))
        .groupBy(code("c_nationkey").alias("iso3c"), F.year("o_orderdate").alias("year"))
        .agg(F.count("*").cast("double").alias("IP.PAT.RESD"))
    )
    place = F.when(F.col("l_returnflag") == "R", F.lit("nation  ")).otherwise("no such nation ")
    measures = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(place, F.col("s_nationkey").cast("string")).alias("Country"),
        F.year("l_shipdate").cast("string").alias("year_from_timeframe"),
    )
    policy, _ = countries.policy_panel(measures, registry)
    panel = countries.build_country_panel([accounts, policy], [], registry)
    return rounded(
        panel.select("iso3c", "year", "country_name", "log_patent_resident_plus1", "n_measures", "n_measures_cum"), 9
    )


@query(
    "firm_years_enriched",
    f"""
    WITH {RESOLVE_CTES.replace('{firms}', '{static_firms}').replace('{hints_raw}', '{no_hints}')},
    panel AS (SELECT p_brand AS gvkey, CAST(year(l_shipdate) AS INT) AS year, count(DISTINCT l_orderkey) AS patents_applied
              FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2),
    facts AS (SELECT lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS cik, CAST(year(l_shipdate) AS INT) AS year, round(sum(l_extendedprice), 2) AS revenue
              FROM lineitem GROUP BY 1, 2)
    SELECT p.gvkey, p.year, p.patents_applied, x.cik, x.link_method, round(x.link_score, 8) AS link_score, x.candidate_count, x.revenue
    FROM panel p LEFT JOIN (SELECT l.gvkey, f.year, l.cik, l.link_method, l.link_score, l.candidate_count, f.revenue
                            FROM links l JOIN facts f USING (cik)) x ON x.gvkey = p.gvkey AND x.year = p.year
    """,
)
def _firm_years_enriched(t: Tables) -> DataFrame:
    static = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("gvkeyUO"),
        F.year("l_shipdate").alias("appYear"),
        F.col("l_orderkey").alias("patent_id"),
        F.lit(1).alias("grantYear"),
        F.lit(0).alias("privateSubsidiary"),
        F.col("p_name").alias("clean_name"),
    )
    facts = t.lineitem.groupBy(
        F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("cik"), F.year("l_shipdate").alias("year")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    registry = linking.prepare_registry(t.view("registry_raw"))
    out = firms.enriched_firm_years(static, registry, facts, firms.FirmPanelConfig(1996, 2000))["firm_year_enriched"]
    return rounded(out.select("gvkey", "year", "patents_applied", "cik", "link_method", "link_score", "candidate_count", "revenue"))

