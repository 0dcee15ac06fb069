"""Projections, filters and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, evidence, numbers, text
from ..operators import aggregates, joins
from ..sources import payloads
from .base import Tables, query, rounded

NAMED = """
    SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ', '
           || CASE p_size % 5 WHEN 0 THEN 'Inc.' WHEN 1 THEN 'Corp' WHEN 2 THEN 'Holdings & Co, Ltd'
                              WHEN 3 THEN 'GmbH' ELSE 'Group  PLC' END AS name
    FROM {part}
"""
SUFFIX_LIST = "['inc','corp','corporation','co','company','ltd','llc','plc','sa','ag','nv','group','holdings','holding']"
NORM_SQL = (
    "array_to_string(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'), ' '), "
    f"lambda x: x <> '' AND NOT list_contains({SUFFIX_LIST}, x)), ' ')"
)


@query("normalize_name", f"SELECT p_partkey, {NORM_SQL} AS norm FROM ({NAMED})")
def _normalize_name(t: Tables) -> DataFrame:
    return t.sql(NAMED).select("p_partkey", text.normalize_name("name").alias("norm"))


@query("compact_name", f"SELECT p_partkey, replace({NORM_SQL}, ' ', '') AS compact FROM ({NAMED})")
def _compact_name(t: Tables) -> DataFrame:
    return t.sql(NAMED).select("p_partkey", text.compact_name("name").alias("compact"))


@query(
    "pad_id",
    """
    SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded, lpad(substr(c_name, 10), 10, '0') AS from_text,
           '1' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS long_id
    FROM customer
    """,
)
def _pad_id(t: Tables) -> DataFrame:
    long_id = F.concat(F.lit("1-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return t.customer.select(
        "c_custkey",
        text.pad_id("c_custkey").alias("padded"),
        text.pad_id("c_name").alias("from_text"),
        text.pad_id(long_id).alias("long_id"),
    )


@query(
    "to_int_or_null",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate::VARCHAR AS shipped,
           CAST(round_even(l_extendedprice / 10, 0) AS INT) AS rounded_year,
           CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_orderkey END AS parsed, CAST(NULL AS BIGINT) AS from_decimal
    FROM lineitem
    """,
)
def _to_int_or_null(t: Tables) -> DataFrame:
    mixed = F.when(F.col("l_returnflag") == "A", F.concat("l_returnflag", F.col("l_orderkey").cast("string")))
    mixed = mixed.otherwise(F.col("l_orderkey").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        numbers.to_year((F.col("l_extendedprice") / 10).cast("string")).alias("rounded_year"),
        numbers.parse_int(mixed).alias("parsed"),
        numbers.parse_int(F.col("l_quantity").cast("string")).alias("from_decimal"),
    )


@query(
    "safe_ratio",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio,
           CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 6) END AS other
    FROM lineitem
    """,
)
def _safe_ratio(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.round(numbers.safe_ratio("l_extendedprice", "l_discount"), 4).alias("ratio"),
        F.round(numbers.safe_ratio("l_quantity", "l_tax"), 6).alias("other"),
    )


@query(
    "strip_quotes_upper",
    "SELECT o_orderkey, upper(o_orderpriority) AS clean, upper('x ' || o_orderstatus) AS inner_kept FROM orders",
)
def _strip_quotes_upper(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit(' \t"'), F.lower("o_orderpriority"), F.lit('" \n'))
    return t.orders.select(
        "o_orderkey",
        text.strip_quotes_upper(quoted).alias("clean"),
        text.strip_quotes_upper(F.concat(F.lit('""x '), "o_orderstatus", F.lit('"'))).alias("inner_kept"),
    )


@query(
    "normalize_country_name",
    """
    SELECT c_custkey, 'NATION ' || CAST(c_nationkey AS VARCHAR) || ' AND ' || c_mktsegment || ' S REP' AS norm
    FROM customer
    """,
)
def _normalize_country_name(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("  "), F.lower("n_name"), F.lit(" & "), "c_mktsegment", F.lit("'s   (Rep.) "))
    return joined.select("c_custkey", text.normalize_country_name(name).alias("norm"))


@query(
    "slugify",
    """
    SELECT o_orderkey, trim(regexp_replace(lower('-' || o_orderpriority || ' / ' || o_orderstatus || '!'),
                                           '[^a-z0-9]+', '_', 'g'), '_') AS slug
    FROM orders
    """,
)
def _slugify(t: Tables) -> DataFrame:
    label = F.concat(F.lit("-"), "o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("!"))
    return t.orders.select("o_orderkey", text.slugify(label).alias("slug"))


@query(
    "normalize_digits",
    """
    SELECT c_custkey, CAST(CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR) AS digits,
           CAST(NULL AS VARCHAR) AS none
    FROM customer
    """,
)
def _normalize_digits(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", text.normalize_digits("c_name").alias("digits"), text.normalize_digits("c_mktsegment").alias("none")
    )


@query(
    "bucket_sic_to_naics",
    """
    WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                      lpad(CAST(l_partkey * 5 AS VARCHAR), 4, '0') AS code FROM lineitem),
    y AS (SELECT *, CAST(substr(code, 1, 2) AS INT) AS n FROM x)
    SELECT code, count(*) AS n_rows,
           CASE WHEN n BETWEEN 1 AND 9 THEN '11' WHEN n BETWEEN 10 AND 14 THEN '21' WHEN n BETWEEN 15 AND 17 THEN '23'
                WHEN n BETWEEN 20 AND 39 THEN '31-33' WHEN n BETWEEN 40 AND 47 THEN '48-49' WHEN n = 48 THEN '51'
                WHEN n = 49 THEN '22' WHEN n BETWEEN 50 AND 51 THEN '42' WHEN n BETWEEN 52 AND 59 THEN '44-45'
                WHEN n BETWEEN 60 AND 67 THEN '52' WHEN n BETWEEN 70 AND 89 THEN '54' END AS bucket
    FROM y GROUP BY code, n
    """,
)
def _bucket_sic(t: Tables) -> DataFrame:
    # Codes are grouped before they are looked up; the shorter table is bucketed.
    plain = F.col("l_partkey") * 5
    counted = t.lineitem.groupBy(plain.cast("string").alias("p")).agg(F.count("*").alias("n_rows"))
    code = F.when(F.length("p") < 4, F.lpad("p", 4, "0")).otherwise(F.substring("p", 1, 4))
    merged = counted.groupBy(code.alias("code")).agg(F.sum("n_rows").alias("n_rows"))
    return merged.select("code", "n_rows", codes.bucket_sic_to_naics(F.concat(F.lit(" "), "code")).alias("bucket"))


@query(
    "bucket_industry_code",
    """
    WITH x AS (
      SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(10 + l_partkey % 90 AS INT) AS n, l_extendedprice AS v FROM lineitem)
    SELECT year,
           CASE WHEN n IN (11,21,22,23,42,51,52,53,54,55,56,61,62,71,72,81) THEN CAST(n AS VARCHAR)
                WHEN n IN (31,32,33) THEN '31-33' WHEN n IN (44,45) THEN '44-45' WHEN n IN (48,49) THEN '48-49' END AS naics2_proxy,
           round(avg(v), 4) AS bea_gdp_by_industry_value
    FROM x WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2 HAVING naics2_proxy IS NOT NULL
    """,
)
def _bucket_industry_code(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.year("l_shipdate").cast("string").alias("y"),
        F.concat((F.lit(10) + F.col("l_partkey") % 90).cast("string"), F.lit("X")).alias("code"),
        F.format_number("l_extendedprice", 2).alias("v"),
    )
    return rounded(payloads.industry_sector_means(rows, "y", "code", "v", 1996, 2000), 4)


@query(
    "clean_year_range",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999",
)
def _clean_year_range(t: Tables) -> DataFrame:
    return clean_year_range(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")), 1996, 1999)


def clean_year_range(df: DataFrame, low: int, high: int) -> DataFrame:
    from ..plans.firms import clean_year_range as keep

    return keep(df, low, high)


@query(
    "load_panel",
    """
    WITH x AS (
      SELECT upper('n' || chr(65 + c_nationkey) || CASE WHEN c_nationkey = 3 THEN '3' ELSE 't' END) AS iso3c,
             CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS amount, o_orderkey AS k
      FROM orders JOIN customer ON o_custkey = c_custkey),
    y AS (SELECT *, row_number() OVER (PARTITION BY iso3c, year ORDER BY k) AS rn FROM x
          WHERE regexp_full_match(iso3c, '[A-Z]{3}'))
    SELECT iso3c, year, round(amount, 2) AS amount, k FROM y WHERE rn = 1
    """,
)
def _load_panel(t: Tables) -> DataFrame:
    code = F.concat(
        F.lit("n"), F.char(F.lit(65) + F.col("c_nationkey")), F.when(F.col("c_nationkey") == 3, "3").otherwise("t")
    )
    raw = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        code.alias("countrycode"), F.year("o_orderdate").cast("string").alias("yr"), "o_totalprice", "o_orderkey", "o_orderstatus"
    )
    rename = {"countrycode": "iso3c", "yr": "year", "o_totalprice": "amount", "o_orderkey": "k"}
    return rounded(joins.load_panel(raw, rename, "iso3c", "year", [F.col("k")]), 2)


@query(
    "static_country_table",
    """
    WITH x AS (
      SELECT m.iso3 AS iso3c, c.c_acctbal, c.c_mktsegment,
             row_number() OVER (PARTITION BY m.iso3 ORDER BY c.c_custkey) AS rn
      FROM customer c JOIN {iso_map} m ON m.iso2 = 'N' || chr(65 + c.c_nationkey) WHERE c.c_nationkey <> 7)
    SELECT iso3c, round(c_acctbal, 2) AS law_balance, c_mktsegment AS law_segment FROM x WHERE rn = 1
    """,
)
def _static_country_table(t: Tables) -> DataFrame:
    known = F.when(F.col("c_nationkey") != 7, F.concat(F.lit("N"), F.char(F.lit(65) + F.col("c_nationkey"))))
    rows = t.customer.select(
        known.alias("code"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), "c_custkey"
    )
    out = joins.static_country_table(rows, t.view("iso_map"), "code", ["balance", "segment"], "law_", [F.col("c_custkey")])
    return rounded(out, 2)


@query(
    "extract_year",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS from_label, CAST(NULL AS VARCHAR) AS none,
           nullif(regexp_extract('n' || CAST(o_orderkey AS VARCHAR) || CAST(o_custkey AS VARCHAR), '((?:19|20)[0-9]{2})', 1), '') AS found
    FROM orders
    """,
)
def _extract_year(t: Tables) -> DataFrame:
    label = F.concat(F.lit("in force since "), F.date_format("o_orderdate", "yyyy-MM"), F.lit(" (rev. 2199)"))
    number = F.concat(F.lit("n"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return t.orders.select(
        "o_orderkey",
        text.extract_year(label).alias("from_label"),
        text.extract_year("o_orderpriority").alias("none"),
        text.extract_year(number).alias("found"),
    )


LEVELS = {"1-URGENT": 5, "2-HIGH": 3, "4-NOT SPECIFIED": 0}


@query(
    "map_codes",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '4-NOT SPECIFIED' THEN 0 END AS level,
           CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS member
    FROM orders
    """,
)
def _map_codes(t: Tables) -> DataFrame:
    padded = F.concat("o_orderstatus", F.lit(" "))
    return t.orders.select(
        "o_orderkey",
        codes.map_codes("o_orderpriority", LEVELS).alias("level"),
        codes.map_codes(padded, {"F": 1, "O": 0}, trim=True).alias("member"),
    )


@query(
    "coalesce_cols",
    """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'first' END,
                                CASE WHEN o_orderpriority = '5-LOW' THEN 'second' END, o_orderstatus) AS best
    FROM orders
    """,
)
def _coalesce_cols(t: Tables) -> DataFrame:
    df = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "first").alias("a"),
        F.when(F.col("o_orderpriority") == "5-LOW", "second").alias("b"),
        F.col("o_orderstatus").alias("c"),
    )
    return joins.coalesce_cols(df, ["a", "absent", "b", "c"], "best").select("o_orderkey", "best")


@query(
    "log_features",
    """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 9) END AS ln_value,
           round(ln(1 + greatest(c_acctbal, 0)), 9) AS ln_floored,
           round(ln(1 + coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END, 0)), 9) AS ln_filled,
           CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 9) END AS ln_plus1
    FROM customer
    """,
)
def _log_features(t: Tables) -> DataFrame:
    some = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey"))
    df = t.customer.select(
        "c_custkey",
        numbers.log_positive("c_acctbal").alias("ln_value"),
        numbers.log_plus1("c_acctbal", floor=0).alias("ln_floored"),
        numbers.log_plus1(some, fill=0).alias("ln_filled"),
        numbers.log_plus1("c_acctbal").alias("ln_plus1"),
    )
    return rounded(df, 9)


HTML_SQL = """
    trim(lower(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
        '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
      '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')))
"""


# References of every kind behind each page, and what they stand for.
MORE_REFERENCES = " &eacute;&Eacute; &notin; &notit; &copy2 &AMP; &amplt; &unknown; &#65;&#x42 &#128; &#0;&#7; &hellip;"
RESOLVED = "éé ∉ ¬it; ©2 & &lt; &unknown; ab € \ufffd …"


@query("clean_html_text", f"SELECT page_id, trim({HTML_SQL} || ' {RESOLVED}') AS text FROM pages")
def _clean_html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.clean_html_text(F.concat("html", F.lit(MORE_REFERENCES))).alias("text"))


TERMS = {"kw_article": ["the", "then", "and"], "kw_noun": ["tion", "ment"], "kw_link": ["http", "www."]}


def _term_sql(column: str, term: str) -> str:
    return f"(length({column}) - length(replace({column}, '{term}', ''))) // {len(term)}"


def keyword_sql(column: str) -> str:
    sums = {k: " + ".join(_term_sql(column, w) for w in ws) for k, ws in TERMS.items()}
    parts = [f"CAST({v} AS BIGINT) AS {k}" for k, v in sums.items()]
    return ", ".join(parts + [f"CAST({' + '.join(sums.values())} AS BIGINT) AS kw_total"])


@query("keyword_counts", f"SELECT page_id, {keyword_sql('text')} FROM (SELECT page_id, {HTML_SQL} AS text FROM pages)")
def _keyword_counts(t: Tables) -> DataFrame:
    clean = t.pages.select("page_id", text.clean_html_text("html").alias("text"))
    return clean.select("page_id", *text.keyword_counts("text", TERMS, "kw_total"))


# Patterns made of ASCII words between blanks, so both regex engines see the same boundaries.
PATTERNS = {
    "data_collection": " (?:the|then|there[a-z]*) ",
    "empirical_analysis": " [a-z]*tion ",
    "experimental_validation": " (?:is|was) [a-z]+ ",
    "measurement_instrumentation": " an?d? ",
    "data_quality_calibration": "license",
    "ml_training_data": " [a-z]{12,} ",
    "boilerplate_digital": " (?:of|on|in) ",
}


def hits_sql(column: str) -> str:
    return ", ".join(f"CAST(len(regexp_extract_all({column}, '{p}')) AS DOUBLE) AS {d}_hits" for d, p in PATTERNS.items())


HITS_SQL = f"SELECT doc_id, {hits_sql('lower(text)')} FROM documents"


@query("regex_hits", HITS_SQL)
def _regex_hits(t: Tables) -> DataFrame:
    low = t.documents.select("doc_id", F.lower("text").alias("text"))
    return evidence.regex_hits(low, "text", PATTERNS).drop("text")


SCORES_SQL = f"""
    SELECT *, w / (w + 2.5 + 1.4 * boilerplate_score) AS dictionary_score FROM (
      SELECT *, 1.15 * data_collection_score + 1.25 * empirical_analysis_score + 1.35 * experimental_validation_score
              + 1.05 * measurement_instrumentation_score + 1.25 * data_quality_calibration_score
              + 1.20 * ml_training_data_score AS w FROM (
        SELECT *, 1 - exp(-data_collection_hits / 2) AS data_collection_score,
               1 - exp(-empirical_analysis_hits / 2) AS empirical_analysis_score,
               1 - exp(-experimental_validation_hits / 2) AS experimental_validation_score,
               1 - exp(-measurement_instrumentation_hits / 2) AS measurement_instrumentation_score,
               1 - exp(-data_quality_calibration_hits / 2) AS data_quality_calibration_score,
               1 - exp(-ml_training_data_hits / 2) AS ml_training_data_score,
               1 - exp(-boilerplate_digital_hits / 2) AS boilerplate_score
        FROM ({HITS_SQL})))
"""


@query(
    "saturating_scores",
    f"""SELECT doc_id, round(data_collection_score, 9) AS data_collection_score,
               round(ml_training_data_score, 9) AS ml_training_data_score,
               round(boilerplate_score, 9) AS boilerplate_score, round(dictionary_score, 9) AS dictionary_score
        FROM ({SCORES_SQL})""",
)
def _saturating_scores(t: Tables) -> DataFrame:
    low = t.documents.select("doc_id", F.lower("text").alias("text"))
    scored = evidence.saturating_scores(evidence.regex_hits(low, "text", PATTERNS))
    return rounded(
        scored.select("doc_id", "data_collection_score", "ml_training_data_score", "boilerplate_score", "dictionary_score"), 9
    )


FLAGS_SQL = """
    SELECT l_orderkey AS patent_id, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS has_measurement_cpc,
           max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_testing_cpc,
           max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS has_ml_cpc,
           max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS has_data_processing_cpc,
           max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS has_bio_assay_cpc, count(*) AS cpc_total_count
    FROM {lineitem} GROUP BY l_orderkey
"""
METADATA_SQL = f"""
    SELECT patent_id, CAST(has_measurement_cpc + has_testing_cpc + has_ml_cpc + has_bio_assay_cpc AS DOUBLE) AS metadata_signal_count,
           round(1 / (1 + exp(-(1.2 * has_measurement_cpc + 1.0 * has_testing_cpc + 1.15 * has_ml_cpc
             + 0.9 * has_data_processing_cpc + 1.1 * has_bio_assay_cpc + 0.12 * ln(1 + cpc_total_count) - 1.2))), 9) AS metadata_score
    FROM ({FLAGS_SQL})
"""


@query("metadata_score", METADATA_SQL)
def _metadata_score(t: Tables) -> DataFrame:
    scored = evidence.metadata_score(t.sql(FLAGS_SQL))
    return rounded(scored.select("patent_id", "metadata_signal_count", "metadata_score"), 9)


# The class flags of a document come from its source; one source stands for generic data processing.
DOC_FLAGS = """
    SELECT doc_id, lower(text) AS text, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS has_measurement_cpc,
           CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS has_data_processing_cpc
    FROM {documents}
"""


@query(
    "seed_labels",
    f"""
    WITH x AS (
      SELECT s.*, f.has_measurement_cpc AS sig, f.has_data_processing_cpc AS dp,
             data_collection_hits + empirical_analysis_hits + experimental_validation_hits + measurement_instrumentation_hits
               + data_quality_calibration_hits + ml_training_data_hits AS ev,
             experimental_validation_hits + ml_training_data_hits + data_quality_calibration_hits
               + measurement_instrumentation_hits AS strong
      FROM ({SCORES_SQL}) s JOIN ({DOC_FLAGS}) f USING (doc_id)),
    y AS (
      SELECT *, (strong >= 2 AND dictionary_score >= 0.30 AND boilerplate_score <= 0.65)
             OR (ev >= 2 AND dictionary_score >= 0.28 AND sig >= 1)
             OR (ml_training_data_hits >= 1 AND experimental_validation_hits >= 1)
             OR (data_quality_calibration_hits >= 1 AND empirical_analysis_hits >= 1) AS pos FROM x)
    SELECT doc_id, CASE WHEN pos THEN 1
        WHEN ev = 0 AND sig = 0 AND ((dictionary_score <= 0.06 AND (boilerplate_score >= 0.20 OR dp >= 1))
             OR (dictionary_score <= 0.03 AND boilerplate_score >= 0.45)) THEN 0 END AS seed_label
    FROM y
    """,
)
def _seed_labels(t: Tables) -> DataFrame:
    return evidence.evidence_features(t.sql(DOC_FLAGS), "text", PATTERNS).select("doc_id", "seed_label")


@query(
    "prefix_flags",
    """
    SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END AS has_first,
           CASE WHEN p_brand LIKE 'Brand#2%' OR p_brand LIKE 'Brand#5%' THEN 1 ELSE 0 END AS has_other,
           CASE WHEN p_name LIKE 'red %' OR p_name LIKE 'blue%' THEN 1 ELSE 0 END AS has_color
    FROM part
    """,
)
def _prefix_flags(t: Tables) -> DataFrame:
    flagged = codes.prefix_flags(t.part, "p_brand", {"has_first": ["Brand#1"], "has_other": ["Brand#2", "Brand#5"]})
    flagged = codes.prefix_flags(flagged, "p_name", {"has_color": ["red ", "blue"]})
    return flagged.select("p_partkey", "has_first", "has_other", "has_color")


@query(
    "iso2_to_iso3",
    """
    SELECT patent_id, CASE WHEN assignee_iso2 IN ('NB', 'NC') THEN NULL ELSE assignee_iso2 || 'T' END AS assignee_iso3,
           inventor_iso2 AS inventor_iso3
    FROM {scored}
    """,
)
def _iso2_to_iso3(t: Tables) -> DataFrame:
    raw = t.view("scored").select(
        "patent_id", F.concat(F.lit(" "), F.lower("assignee_iso2")).alias("a"), F.col("inventor_iso2").alias("i")
    )
    table = t.view("iso_map").withColumn("iso2", F.when(~F.col("iso2").isin("NB", "NC"), F.col("iso2")))
    out = joins.iso2_to_iso3(joins.iso2_to_iso3(raw, table, "a", "assignee_iso3"), table, "i", "inventor_iso3")
    return out.select("patent_id", "assignee_iso3", "inventor_iso3")


@query(
    "iso_country_table",
    """
    WITH iso AS (FROM (VALUES ('AD', 'AND'), ('AE', 'ARE'), ('AF', 'AFG'), ('AG', 'ATG'), ('AI', 'AIA'), ('AL', 'ALB'), ('AM', 'ARM'),
      ('AN', 'ANT'), ('AO', 'AGO'), ('AQ', 'ATA'), ('AR', 'ARG'), ('AS', 'ASM'), ('AT', 'AUT'), ('AU', 'AUS'), ('AW', 'ABW'),
      ('AX', 'ALA')) AS v(iso2, iso3))
    SELECT c_custkey, iso3 FROM customer LEFT JOIN iso ON iso2 = 'A' || chr(65 + c_nationkey)
    """,
)
def _iso_country_table(t: Tables) -> DataFrame:
    raw = t.customer.select("c_custkey", F.concat(F.lit("a"), F.char(F.lit(97) + F.col("c_nationkey"))).alias("code"))
    return joins.iso2_to_iso3(raw, codes.iso_country_table(t.spark), "code", "iso3").select("c_custkey", "iso3")


@query(
    "country_match",
    """
    WITH d AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer)
    SELECT CASE WHEN s = 'BUILDING' THEN 'EUROPEAN UNION' WHEN s = 'MACHINERY' THEN 'KOREA'
                WHEN s = 'HOUSEHOLD' THEN 'Atlantis ' || CAST(k AS VARCHAR) ELSE 'nation ' || CAST(k AS VARCHAR) END AS country,
           CASE WHEN s = 'BUILDING' THEN NULL WHEN s = 'MACHINERY' THEN 'KOR' WHEN s = 'HOUSEHOLD' THEN NULL
                ELSE 'N' || chr(65 + k) || 'T' END AS iso3c,
           CASE WHEN s = 'BUILDING' THEN 'excluded_non_country' WHEN s = 'MACHINERY' THEN 'manual'
                WHEN s = 'HOUSEHOLD' THEN 'unmatched' ELSE 'exact_normalized' END AS matched_by
    FROM d GROUP BY 1, 2, 3
    """,
)
def _country_match(t: Tables) -> DataFrame:
    key = F.col("c_nationkey").cast("string")
    name = (
        F.when(F.col("c_mktsegment") == "BUILDING", "EUROPEAN UNION")
        .when(F.col("c_mktsegment") == "MACHINERY", "KOREA")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("Atlantis "), key))
        .otherwise(F.concat(F.lit("nation "), key))
    )
    registry = t.nation.select(
        F.col("n_name").alias("wb_name"),
        F.concat(F.lit("N"), F.char(F.lit(65) + F.col("n_nationkey")), F.lit("T")).alias("code"),
    )
    return joins.country_match(
        t.customer.select(name.alias("country")), "country", registry, "wb_name", "code",
        {"KOREA": "KOR", "TAIWAN": "TWN"}, ["EUROPEAN UNION"],
    )


SCIENCE, DOI = r"doi\s*[:]|journal|vol\.|license|ment ", r"doi\s*[:]?10\.|tion\."


@query(
    "science_reference_flags",
    f"""
    SELECT source, count(*) AS other_reference_count,
           count(*) FILTER (WHERE regexp_matches(lower(coalesce(text, '')), '{SCIENCE}')) AS science_reference_count,
           count(*) FILTER (WHERE regexp_matches(lower(coalesce(text, '')), '{DOI}')) AS doi_reference_count
    FROM documents GROUP BY 1
    """,
)
def _science_reference_flags(t: Tables) -> DataFrame:
    return aggregates.science_reference_flags(t.documents, "source", "text", SCIENCE, DOI)


@query(
    "filing_year",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderstatus <> 'P'
    """,
)
def _filing_year(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "20-F")
        .otherwise("8-K")
        .alias("form"),
        F.when(F.col("o_orderstatus") == "F", day).when(F.col("o_orderstatus") == "O", " ").otherwise("n/a").alias("reportDate"),
        F.when(F.col("o_orderstatus") == "O", day).alias("filingDate"),
    )
    return aggregates.filing_year(rows, "form", "reportDate", "filingDate", ["o_orderkey"]).select("o_orderkey", "year")
