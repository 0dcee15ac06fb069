"""Scoring end to end: backbone rows with texts to features, country-year measures and the country panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..operators.aggregates import SCORE_COLUMNS
from ..plans import backbone, countries, evidence, industries
from .aggregating import country_scores_sql
from .base import Tables, query, rounded
from .scalars import PATTERNS, hits_sql

# Items are orders; the document of the same number is the abstract, and most items have none.
BACKBONE = """
    SELECT s.patent_id, s.gvkey, s.app_year, s.grant_year, s.num_claims, s.c_nationkey, lower(s.assignee_iso2) AS assignee_country_mode,
           s.inventor_iso2 AS inventor_country_mode, s.o_orderpriority AS patent_title, d.text AS patent_abstract,
           s.has_measurement_cpc, s.has_testing_cpc, s.has_ml_cpc, s.has_data_processing_cpc, s.has_bio_assay_cpc,
           s.has_statistics_cpc, s.text_supervised_score, s.semantic_lsa_score, s.benchmark_score, s.benchmark_flag,
           s.benchmark_confidence
    FROM {scored} s LEFT JOIN {documents} d ON s.patent_id = d.doc_id
"""
PARTS = [c for c in SCORE_COLUMNS if c.endswith("_score") and c.removesuffix("_score") in PATTERNS]
HITS = [f"{d}_hits" for d in PATTERNS]

# Definitions: hits per pattern, saturating parts, the weighted sum and the two label rules over named conditions.
FEATURES_SQL = f"""
    WITH low AS (SELECT *, lower(patent_title || ' ' || coalesce(patent_abstract, '')) AS txt FROM ({BACKBONE})),
    h AS (SELECT *, len(regexp_extract_all(txt, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')) AS n_tokens, {hits_sql('txt')} FROM low),
    p AS (SELECT *, {', '.join(f"1 - exp(-{c.removesuffix('_score')}_hits / 2) AS {c}" for c in PARTS)},
                 1 - exp(-boilerplate_digital_hits / 2) AS boilerplate_score,
                 {' + '.join(h for h in HITS if not h.startswith('boilerplate'))} AS wording,
                 CAST(has_measurement_cpc + has_testing_cpc + has_ml_cpc + has_bio_assay_cpc + has_statistics_cpc AS DOUBLE)
                   AS metadata_signal_count,
                 1 / (1 + exp(1.2 - (1.2 * has_measurement_cpc + has_testing_cpc + 1.15 * has_ml_cpc
                   + 0.9 * has_data_processing_cpc + 1.1 * has_bio_assay_cpc + has_statistics_cpc))) AS metadata_score FROM h),
    w AS (SELECT *, 1.15 * data_collection_score + 1.25 * empirical_analysis_score + 1.35 * experimental_validation_score
                  + 1.05 * measurement_instrumentation_score + 1.25 * data_quality_calibration_score
                  + 1.20 * ml_training_data_score AS weighted FROM p),
    f AS (SELECT *, weighted / (weighted + 2.5 + 1.4 * boilerplate_score) AS dictionary_score FROM w)
"""
LABEL_SQL = """
    CASE WHEN (wording - data_collection_hits - empirical_analysis_hits >= 2 AND dictionary_score >= 0.30 AND boilerplate_score <= 0.65)
           OR (wording >= 2 AND dictionary_score >= 0.28 AND metadata_signal_count >= 1)
           OR least(ml_training_data_hits, experimental_validation_hits) >= 1
           OR least(data_quality_calibration_hits, empirical_analysis_hits) >= 1 THEN 1
         WHEN wording + metadata_signal_count = 0 AND (
              (dictionary_score <= 0.06 AND greatest(boilerplate_score / 0.20, has_data_processing_cpc) >= 1)
              OR (dictionary_score <= 0.03 AND boilerplate_score >= 0.45)) THEN 0 END
"""
SHOWN = [*PARTS, "boilerplate_score", "dictionary_score", "metadata_score"]


def features(t: Tables) -> DataFrame:
    return evidence.with_features(t.sql(BACKBONE), PATTERNS)


@query(
    "evidence_features",
    f"""
    {FEATURES_SQL}
    SELECT patent_id, app_year, grant_year, assignee_country_mode, inventor_country_mode, CAST(n_tokens AS INT) AS n_tokens,
           {', '.join(HITS)}, metadata_signal_count, {', '.join(f'round({c}, 9) AS {c}' for c in SHOWN)}, {LABEL_SQL} AS seed_label
    FROM f
    """,
)
def _evidence_features(t: Tables) -> DataFrame:
    return rounded(
        features(t).select(
            "patent_id", "app_year", "grant_year", "assignee_country_mode", "inventor_country_mode", "n_tokens", *HITS,
            "metadata_signal_count", *SHOWN, "seed_label",
        ),
        9,
    )


MEASURES = [
    "patent_count", "data_driven_patent_count", "data_driven_patent_share", "benchmark_score_mean", "benchmark_top_decile_share",
    *[f"{c}_mean" for c in SCORE_COLUMNS], "claims_weighted_benchmark_score_mean", "benchmark_confidence_mean",
]


@query(
    "evidence_panel",
    f"""
    {FEATURES_SQL},
    m AS ({country_scores_sql("upper(assignee_country_mode) || 'T'", "app_year").replace("{scored}", "f").replace(", 12)", ", 9)")})
    SELECT iso3 AS iso3c, CAST(y AS INT) AS year, {', '.join(f'{c} AS pe_{c}' for c in MEASURES)}
    FROM {{iso_map}} CROSS JOIN range(1990, 2002) AS r(y) LEFT JOIN m ON m.iso3c = iso3 AND m.year = y
    """,
)
def _evidence_panel(t: Tables) -> DataFrame:
    found = evidence.country_year_variants(features(t), t.view("iso_map"))["benchmark"]
    years = F.explode(F.sequence(F.lit(1990), F.lit(2001)))
    panel = t.view("iso_map").select(F.col("iso3").alias("iso3c"), years.alias("year"))
    return rounded(evidence.merge_into_panel(panel, found), 9)


@query(
    "backbone_coverage",
    """
    SELECT count(*) AS n_rows, count(o_orderpriority) AS n_with_patent_title, count(text) AS n_with_patent_abstract,
           count(*) AS n_with_assignee_country_mode, count(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END) AS n_with_inventor_country_mode,
           count(l_orderkey) AS n_with_cpc_total_count
    FROM orders LEFT JOIN documents ON o_orderkey = doc_id
      LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey
    """,
)
def _backbone_coverage(t: Tables) -> DataFrame:
    classes = t.lineitem.groupBy(F.col("l_orderkey").alias("patent_id")).agg(F.count("*").alias("cpc_total_count"))
    return backbone.backbone_coverage(t.sql(BACKBONE).join(classes, "patent_id", "left"))


@query(
    "mapping_coverage",
    """
    SELECT count(*) AS n_rows, count(o_custkey) AS n_with_gvkey, count(CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 END) AS n_with_sic_key,
           count(CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END) AS n_with_iso3c
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def _mapping_coverage(t: Tables) -> DataFrame:
    sic = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return industries.mapping_coverage(t.view("scored").withColumns({"sic_key": sic, "iso3c": F.col("inventor_iso2")}))


# One line item is an observation of every source (a price by a large prime, so that no mean ends on a rounding edge); its number, return flag and status stand for the dimensions.
OBSERVATIONS = """
    SELECT 'N' || chr(65 + s_nationkey) || 'T' AS REF_AREA, CAST(year(l_shipdate) AS INT) AS TIME_PERIOD,
           CAST(l_extendedprice AS DOUBLE) / 100003 AS OBS_VALUE, l_linenumber, l_returnflag, l_linestatus
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""
SECTORS = {"total": 0, "business": 1, "government": 2, "highered": 3}
KEPT = "l_returnflag = 'N'"
SERIES_SQL = (
    {f"oecd_gerd_{n}_usd_ppp_const2015": f"{KEPT} AND l_linenumber % 5 = {k}" for n, k in SECTORS.items()}
    | {f"oecd_rd_personnel_fte_{n}": f"l_linestatus = 'O' AND l_linenumber % 5 = {k}" for n, k in SECTORS.items()}
    | {
        f"oecd_{n}_pct_gdp": f"{KEPT} AND l_linenumber = {k}"
        for n, k in {"rdtax": 1, "direct_funding": 2, "total_support": 3, "gbard": 4}.items()
    }
    | {
        f"oecd_b_index_{size}_{profit}": f"(l_returnflag = 'N') = {size == 'sme'} AND (l_linestatus = 'O') = {profit == 'profitable'}"
        for size in ("sme", "large")
        for profit in ("profitable", "loss_making")
    }
    | {"oecd_iptax_pct_gdp": "l_linenumber = 7"}
)
LEADING = 5
TOP_SQL = {f"indicator_{i}": f"l_returnflag = 'A' AND place = {i}" for i in range(1, LEADING + 1)}
ALL_SERIES = SERIES_SQL | TOP_SQL


@query(
    "country_panel_sources",
    f"""
    WITH o AS ({OBSERVATIONS}),
    top AS (SELECT l_linenumber, row_number() OVER (ORDER BY l_linenumber) AS place FROM (
              SELECT l_linenumber FROM o WHERE l_returnflag = 'A' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {LEADING})),
    s AS (SELECT REF_AREA AS iso3c, TIME_PERIOD AS year, {', '.join(f'avg(OBS_VALUE) FILTER (WHERE {w}) AS {n}' for n, w in ALL_SERIES.items())}
          FROM o LEFT JOIN top USING (l_linenumber) GROUP BY 1, 2),
    seen AS (SELECT * FROM s WHERE coalesce({', '.join(ALL_SERIES)}) IS NOT NULL),
    a AS (SELECT 'N' || chr(65 + c_nationkey) || 'T' AS iso3c, CAST(year(o_orderdate) AS INT) AS year, count(*) AS resd,
                 count(*) FILTER (WHERE o_totalprice > 200000) AS nres, avg(o_totalprice) AS gdp
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    best AS (SELECT 'N' || chr(65 + s_nationkey) || 'T' AS iso3c, max_by(s_suppkey, (s_acctbal, -s_suppkey)) AS static_s_suppkey,
                    max(s_acctbal) AS static_s_acctbal FROM supplier WHERE s_nationkey <> 5 GROUP BY 1),
    names AS (SELECT 'N' || chr(65 + n_nationkey) || 'T' AS iso3c, n_name AS country_name FROM nation WHERE n_nationkey <> 11),
    keys AS (SELECT iso3c, year FROM a UNION SELECT iso3c, year FROM seen)
    SELECT iso3c, year, country_name, static_s_suppkey, static_s_acctbal, round(ln(1 + resd), 9) AS log_patent_resident_plus1,
           round(ln(1 + resd + nres), 9) AS log_patent_total_plus1, round(ln(gdp), 9) AS log_gdp_per_capita_const_2015,
           {', '.join(f'round({n}, 9) AS {n}' for n in ALL_SERIES)}
    FROM keys JOIN names USING (iso3c) LEFT JOIN a USING (iso3c, year) LEFT JOIN seen USING (iso3c, year) LEFT JOIN best USING (iso3c)
    """,
)
def _country_panel_sources(t: Tables) -> DataFrame:
    rows = t.sql(OBSERVATIONS)
    number, kept, opened = F.col("l_linenumber"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"

    def source(**dimensions) -> DataFrame:
        columns = {k: v if isinstance(v, F.Column) else F.lit(v) for k, v in dimensions.items()}
        return rows.withColumn("REF_AREA", F.lower("REF_AREA")).withColumns(columns)

    def either(test: F.Column, yes: str, no: str) -> F.Column:
        return F.when(test, yes).otherwise(no)

    sector = F.element_at(F.array(*[F.lit(s) for s in ("_T", "BES", "GOV", "HES", "PNP")]), (number % 5 + 1).cast("int"))
    support = F.when(number < 5, F.element_at(F.array(*[F.lit(s) for s in ("RDTAX", "DF", "RDTAXSUB", "GBARD")]), F.least(number, F.lit(4)).cast("int")))
    whole = {"PROFIT_SCENARIO": "_Z", "UNIT_MEASURE": "PT_B1GQ", "PRICE_BASE": "_Z"}
    staff = {c: "_T" for c in ("FORD", "ACTIVITY", "FUNCTION", "EDUCATION_LEV", "SEX")}
    sources = {
        "gerd": source(MEASURE="G", TYPE_COST="_T", UNIT_MEASURE=either(kept, "USD_PPP", "XDC"), PRICE_BASE="Q", SECT_PERF=sector),
        "personnel": source(
            MEASURE="T_RD", **staff, EMP_STATUS=either(opened, "INT", "EXT"), UNIT_MEASURE="PS_FTE", SECT_PERF=sector
        ),
        "support": source(MEASURE=support, SIZE=either(kept, "_Z", "SME"), **whole),
        "subsidy": source(
            MEASURE="RDSUB", UNIT_MEASURE="IX", SIZE=either(kept, "SME", "LARGE"),
            PROFIT_SCENARIO=either(opened, "PROFITABLE", "LOSS_MAKING"),
        ),
        "ip_tax": source(MEASURE=either(number == 7, "IPTAX", "OTHER"), SIZE="_Z", **whole),
    }
    indicators = source(
        MEASURE=F.concat(F.lit("M"), number.cast("string")), UNIT_MEASURE="PT_B1GQ", PRICE_BASE="_Z",
        TRANSFORMATION=either(F.col("l_returnflag") == "A", "_Z", "G1"),
    )
    series = countries.rd_series(sources, indicators, LEADING)
    leading = sorted(c for c in series.columns if c.startswith("oecd_msti_"))
    series = series.withColumnsRenamed({c: f"indicator_{i}" for i, c in enumerate(leading, 1)})

    two = F.concat(F.lit("N"), F.char(F.lit(65) + F.col("s_nationkey")))
    suppliers = t.supplier.withColumn("iso2", two)
    mapping = t.view("iso_map").withColumn("iso2", F.when(F.col("iso2") != "NF", F.col("iso2")))
    best = [F.desc("s_acctbal"), F.col("s_suppkey")]
    static = joins.static_country_table(suppliers, mapping, "iso2", ["s_suppkey", "s_acctbal"], "static_", best)

    def code(column: str) -> F.Column:
        return F.concat(F.lit("N"), F.char(F.lit(65) + F.col(column)), F.lit("T"))

    accounts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    accounts = accounts.groupBy(code("c_nationkey").alias("iso3c"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").cast("double").alias("IP.PAT.RESD"),
        F.count_if(F.col("o_totalprice") > 200000).cast("double").alias("IP.PAT.NRES"),
        F.avg("o_totalprice").alias("NY.GDP.PCAP.KD"),
    )
    registry = t.nation.select(
        F.when(F.col("n_nationkey") != 11, code("n_nationkey")).otherwise("ZZZ").alias("iso3c"), F.col("n_name").alias("wb_country_name")
    )
    panel = countries.build_country_panel([accounts, series], [static], registry)
    return rounded(
        panel.select(
            "iso3c", "year", "country_name", "static_s_suppkey", "static_s_acctbal", "log_patent_resident_plus1",
            "log_patent_total_plus1", "log_gdp_per_capita_const_2015", *ALL_SERIES,
        ),
        9,
    )
