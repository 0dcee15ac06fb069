"""Sources, sinks and payload flatteners over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking
from ..session import scratch_path
from ..sources import payloads, tables
from .base import Tables, query, rounded


def _tranche_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("patent_id"),
        F.year("l_shipdate").alias("appYear"),
        F.when(F.col("l_returnflag") != "N", F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("gvkeyUO"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("gvkeyFR"),
        F.concat(F.lit("NAME, "), F.col("l_suppkey").cast("string")).alias("clean_name"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("privateSubsidiary"),
        (F.year("l_shipdate") + 2).alias("grantYear"),
        F.lit("unread").alias("cnLink_y1"),
        "l_linestatus",
    )


@query(
    "scan_tranches",
    """
    SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS owner, CAST(year(l_shipdate) AS INT) AS app_year,
           count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_patents,
           max(CAST(year(l_shipdate) AS INT) + 2) AS last_grant
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2
    """,
)
def _scan_tranches(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "tranches")
    rows = _tranche_rows(t)
    for i, status in enumerate(("O", "F"), 1):
        part = rows.where(F.col("l_linestatus") == status).drop("l_linestatus")
        tables.write_table(part, f"{folder}/staticTranche{i}.csv", "csv")
    scanned = tables.scan_tranches(t.spark, folder)
    return scanned.groupBy(F.col("gvkeyUO").alias("owner"), F.col("appYear").alias("app_year")).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("patent_id").alias("n_patents"),
        F.max("grantYear").alias("last_grant"),
    )


@query(
    "combine_tranches",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority,
           (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS n_files, (SELECT count(*) FROM orders) AS n_rows
    FROM orders
    """,
)
def _combine_tranches(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "yearly")
    rows = t.orders.withColumn("y", F.year("o_orderdate")).drop("o_orderdate")
    tables.write_table(rows, folder, "csv", partition_by=["y"])
    paths = tables.matching_paths(t.spark, f"{folder}/y=*")
    out = scratch_path(t.spark, "combined")
    seen = tables.combine_tranches(t.spark, paths, out)
    combined = tables.coerce(
        tables.read_delimited(t.spark, out),
        {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
         "o_orderpriority": "string"},
    )
    return rounded(combined, 2).withColumns(
        {"n_files": F.lit(seen["files"]).cast("bigint"), "n_rows": F.lit(seen["rows"]).cast("bigint")}
    )


@query(
    "scan_tsv_filtered",
    """
    SELECT 'C' || CAST(o_custkey AS VARCHAR) AS owner_id, o_orderpriority AS priority,
           count(*) AS n_rows, min(o_orderkey) AS first_key
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    GROUP BY 1, 2
    """,
)
def _scan_tsv_filtered(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders-tsv")
    raw = t.orders.select(
        F.concat(F.lit(' "c'), F.col("o_custkey").cast("string"), F.lit('" ')).alias(' "owner_id"'),
        F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')).alias("priority"),
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_orderstatus").alias("unused"),
    )
    raw.write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    universe = t.customer.where("c_acctbal > 0").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("owner_id")
    )
    kept = tables.scan_tsv_filtered(t.spark, path, ["owner_id", "priority", "key"], universe, "owner_id")
    return kept.groupBy("owner_id", "priority").agg(
        F.count("*").alias("n_rows"), F.min(F.col("key").try_cast("bigint")).alias("first_key")
    )


@query(
    "scan_parquet",
    """
    SELECT c_custkey, nullif(trim(c_name), '') AS c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal,
           upper(nullif(trim(c_mktsegment), '')) AS c_mktsegment
    FROM customer
    """,
)
def _scan_parquet(t: Tables) -> DataFrame:
    schema = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
    return rounded(tables.scan_parquet(t.spark, t.path("customer"), schema, upper=["c_mktsegment"]), 2)


@query(
    "coerce_all_varchar",
    """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           TRY_CAST(event_type AS DOUBLE) AS bad, TRY_CAST(CAST(round(value, 1) AS VARCHAR) AS INTEGER) AS whole,
           round(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 4) AS value
    FROM events
    """,
)
def _coerce_all_varchar(t: Tables) -> DataFrame:
    text = t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.get_json_object("props", "$.k").alias("k"),
        F.col("event_type").alias("bad"),
        F.round("value", 1).cast("string").alias("whole"),
        F.col("value").cast("string").alias("value"),
    )
    schema = {"event_id": "bigint", "k": "int", "bad": "double", "whole": "int", "value": "double"}
    return rounded(tables.coerce(text, schema), 4)


@query(
    "explode_fields_rows",
    """
    SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, upper('t' || CAST(s_nationkey AS VARCHAR)) AS ticker,
           s_name || ', Inc.' AS sec_name, 'supplier ' || substr(s_name, 10) AS sec_name_norm,
           'supplier' || substr(s_name, 10) AS sec_name_compact,
           CASE WHEN s_acctbal > 0 THEN 'NYSE' ELSE 'OTC' END AS exchange
    FROM supplier
    """,
)
def _explode_fields_rows(t: Tables) -> DataFrame:
    row = F.array(
        F.concat(F.lit("t"), F.col("s_nationkey").cast("string")),
        F.col("s_suppkey").cast("string"),
        F.when(F.col("s_acctbal") > 0, "NYSE").otherwise("OTC"),
        F.concat("s_name", F.lit(", Inc.")),
    )
    fields = F.array(*[F.lit(x) for x in ("ticker", "cik", "exchange", "name")])
    payload = F.to_json(F.struct(fields.alias("fields"), F.array(row).alias("data")))
    return payloads.explode_fields_rows(t.supplier.select(payload.alias("j")), "j")


SERIES = {"click": "m_click", "view": "m_view", "purchase": "m_purchase", "signup": "m_signup"}


@query(
    "flatten_series_json",
    """
    SELECT CAST(day(ts) AS INT) AS year,
           round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS m_click,
           round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS m_view,
           round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS m_purchase,
           round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS m_signup
    FROM events WHERE value >= 5 AND event_type <> 'error' GROUP BY 1
    """,
)
def _flatten_series_json(t: Tables) -> DataFrame:
    point = F.struct(
        F.dayofmonth("ts").cast("string").alias("year"),
        F.when(F.col("value") >= 5, "A01").otherwise("M01").alias("period"),
        F.col("value").cast("string").alias("value"),
    )
    series = F.struct(F.col("event_type").alias("seriesID"), F.array(point).alias("data"))
    payload = F.to_json(F.struct(F.struct(F.array(series).alias("series")).alias("Results")))
    return rounded(payloads.flatten_series_json(t.events.select(payload.alias("j")), "j", SERIES), 6)


@query(
    "flatten_header_row_json",
    """
    SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS census_cbp_emp, round(c_acctbal, 2) AS census_cbp_payann_thousand,
           CAST(c_custkey AS DOUBLE) AS census_cbp_estab,
           CASE WHEN c_nationkey > 0 THEN round(c_acctbal * 1000 / c_nationkey, 4) END AS census_cbp_payroll_per_employee
    FROM customer WHERE c_mktsegment <> 'BUILDING'
    """,
)
def _flatten_header_row_json(t: Tables) -> DataFrame:
    header = F.array(*[F.lit(x) for x in ("NAICS2017", "EMPSZES", "EMP", "PAYANN", "ESTAB")])
    size = F.when(F.col("c_mktsegment") == "BUILDING", "210").otherwise("001")
    row = F.array(
        F.lit("11"), size, F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string"),
        F.col("c_custkey").cast("string"),
    )
    other = F.array(F.lit("11"), F.lit("212"), F.lit("1"), F.lit("1"), F.lit("1"))
    payload = F.to_json(F.array(header, other, row, other))
    flat = payloads.flatten_header_row_json(t.customer.select("c_custkey", payload.alias("j")), "j", ["c_custkey"])
    return flat.withColumns(
        {
            "census_cbp_payann_thousand": F.round("census_cbp_payann_thousand", 2),
            "census_cbp_payroll_per_employee": F.round("census_cbp_payroll_per_employee", 4),
        }
    )


def facts_payload() -> F.Column:
    """A company-facts document built from one order: one tag, one unit, two values."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "P", "20-F").otherwise("10-Q")
    year = F.year("o_orderdate")
    items = F.array(
        F.struct(year.alias("fy"), F.col("o_totalprice").alias("val"), form.alias("form")),
        F.struct((year + 1).alias("fy"), (F.col("o_totalprice") * 2).alias("val"), form.alias("form")),
    )
    tag = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Revenues")
        .when(F.col("o_orderpriority") == "2-HIGH", "SalesRevenueNet")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ResearchAndDevelopmentExpense")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "PaymentsToAcquirePropertyPlantAndEquipment")
        .otherwise("NumberOfEmployees")
    )
    unit = F.when(F.col("o_orderpriority") == "5-LOW", "pure").otherwise("USD")
    node = F.struct(F.create_map(unit, items).alias("units"))
    return F.to_json(F.struct(F.struct(F.create_map(tag, node).alias("us-gaap")).alias("facts")))


FACTS_SQL = """
    SELECT o_orderkey, o_custkey,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'Revenues' WHEN '2-HIGH' THEN 'SalesRevenueNet'
                WHEN '3-MEDIUM' THEN 'ResearchAndDevelopmentExpense'
                WHEN '4-NOT SPECIFIED' THEN 'PaymentsToAcquirePropertyPlantAndEquipment'
                ELSE 'NumberOfEmployees' END AS tag,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'pure' ELSE 'USD' END AS unit,
           CAST(p AS INT) AS position, CAST(year(o_orderdate) + p AS INT) AS year,
           o_totalprice * (1 + p) AS value
    FROM orders, (VALUES (0), (1)) AS v(p) WHERE o_orderstatus IN ('F', 'P')
"""


@query(
    "flatten_facts_json",
    f"SELECT o_orderkey, tag, unit, position, year, round(value, 2) AS value FROM ({FACTS_SQL})",
)
def _flatten_facts_json(t: Tables) -> DataFrame:
    docs = t.orders.select("o_orderkey", facts_payload().alias("j"))
    return rounded(payloads.flatten_facts_json(docs, "j", ["o_orderkey"]), 2)


@query(
    "unpivot_map_json",
    """
    WITH s AS (SELECT s_name AS iso2c, s_suppkey, s_nationkey FROM supplier WHERE s_acctbal >= 0),
    l AS (
      SELECT iso2c, 'electronic_transactions' AS slug, s_suppkey % 4 AS code FROM s UNION ALL
      SELECT iso2c, 'consumer_protection', s_nationkey % 5 FROM s UNION ALL
      SELECT iso2c, 'privacy_and_data_protection', 1 FROM s UNION ALL
      SELECT iso2c, 'cybercrime', 2 FROM s UNION ALL
      SELECT iso2c, 'indirect_taxation', 3 FROM s)
    SELECT iso2c, slug AS law_domain_slug, CAST(code AS INT) AS status_code,
           CASE code WHEN 0 THEN 'no_data' WHEN 1 THEN 'legislation' WHEN 2 THEN 'draft_legislation'
                     WHEN 3 THEN 'no_legislation' ELSE 'unknown' END AS status_label
    FROM l
    """,
)
def _unpivot_map_json(t: Tables) -> DataFrame:
    codes = F.array(F.col("s_suppkey") % 4, F.col("s_nationkey") % 5, F.lit(1), F.lit(2), F.lit(3))
    short = F.array(F.lit(1).cast("bigint"))
    payload = F.to_json(F.create_map("s_name", F.when(F.col("s_acctbal") >= 0, codes).otherwise(short)))
    return payloads.unpivot_map_json(t.supplier.select(payload.alias("j")), "j").drop("law_domain")


LAW_SLUGS = ("electronic_transactions", "consumer_protection", "privacy_and_data_protection", "cybercrime", "indirect_taxation")


@query(
    "pivot_laws",
    """
    WITH names AS (SELECT ['no_data', 'legislation', 'draft_legislation', 'no_legislation'] AS label)
    SELECT s_name AS iso2c, CAST(s_suppkey % 4 AS INT) AS electronic_transactions_code,
           label[s_suppkey % 4 + 1] AS electronic_transactions_status, CAST(s_nationkey % 5 AS INT) AS consumer_protection_code,
           coalesce(label[s_nationkey % 5 + 1], 'unknown') AS consumer_protection_status, 1 AS privacy_and_data_protection_code,
           'legislation' AS privacy_and_data_protection_status, 2 AS cybercrime_code, 'draft_legislation' AS cybercrime_status,
           3 AS indirect_taxation_code, 'no_legislation' AS indirect_taxation_status
    FROM supplier, names WHERE s_acctbal >= 0
    """,
)
def _pivot_laws(t: Tables) -> DataFrame:
    codes = F.array(F.col("s_suppkey") % 4, F.col("s_nationkey") % 5, F.lit(1), F.lit(2), F.lit(3))
    short = F.array(F.lit(1).cast("bigint"))
    payload = F.to_json(F.create_map("s_name", F.when(F.col("s_acctbal") >= 0, codes).otherwise(short)))
    return payloads.pivot_laws(payloads.unpivot_map_json(t.supplier.select(payload.alias("j")), "j"), LAW_SLUGS)


@query(
    "flatten_industry_json",
    """
    WITH d AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(11 + l_partkey % 80 AS INT) AS h, 1200 + CAST(l_quantity AS INT) AS v
               FROM lineitem),
    r AS (SELECT year, v, CASE WHEN h BETWEEN 31 AND 33 THEN '31-33' WHEN h IN (44, 45) THEN '44-45' WHEN h IN (48, 49) THEN '48-49'
                 WHEN list_contains([11, 21, 22, 23, 42, 51, 52, 53, 54, 55, 56, 61, 62, 71, 72, 81], h) THEN CAST(h AS VARCHAR) END AS root FROM d)
    SELECT year, root AS naics2_proxy, round(avg(v), 8) AS bea_gdp_by_industry_value FROM r
    WHERE root IS NOT NULL AND year BETWEEN 1993 AND 1997 GROUP BY year, root
    """,
)
def _flatten_industry_json(t: Tables) -> DataFrame:
    cell = F.struct(
        F.year("l_shipdate").cast("string").alias("Year"),
        F.concat((11 + F.col("l_partkey") % 80).cast("string"), F.lit("1")).alias("Industry"),
        F.concat(F.lit("1,"), (200 + F.col("l_quantity").cast("int")).cast("string")).alias("DataValue"),
    )
    data = F.struct(F.struct(F.struct(F.collect_list(cell).alias("Data")).alias("Results")).alias("BEAAPI"))
    docs = t.lineitem.groupBy("l_orderkey").agg(F.to_json(data).alias("j"))
    return rounded(payloads.flatten_industry_json(docs, "j", 1993, 1997))


@query(
    "stack_indicators",
    """
    WITH e AS (SELECT user_id, CAST(day(ts) AS INT) AS year, event_type, value, event_id FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, year, event_type ORDER BY event_id) AS rn FROM e)
    SELECT user_id, year,
           max(CASE WHEN event_type = 'click' THEN round(value, 6) END) AS click,
           max(CASE WHEN event_type = 'purchase' THEN round(value, 6) END) AS purchase,
           max(CASE WHEN event_type = 'view' THEN round(value, 6) END) AS "view"
    FROM f WHERE rn = 1 GROUP BY 1, 2
    """,
)
def _stack_indicators(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.dayofmonth("ts").alias("year"), "event_type", "value", "event_id")
    frames = [e.where(F.col("event_type") == k) for k in ("click", "purchase", "view", "error", "signup")]
    wide = payloads.stack_indicators(
        frames, ["click", "purchase", "view"], ["user_id", "year"], "event_type", "value", ["event_id"]
    )
    return rounded(wide, 6)


@query(
    "flatten_country_metadata",
    """
    SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3c, 'N' || chr(65 + n_nationkey) AS iso2c,
           min(n_name || ' & Co') AS wb_country_name, min(r_name) AS wb_region, min(c_mktsegment) AS wb_income_level,
           min('L' || CAST(r_regionkey AS VARCHAR)) AS wb_lending_type,
           min(replace(n_name, '_', ' ') || ' AND CO') AS wb_name_norm
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name <> 'ASIA' GROUP BY 1, 2
    """,
)
def _flatten_country_metadata(t: Tables) -> DataFrame:
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    payload = F.to_json(
        F.struct(
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"),
            F.concat(F.lit("N"), F.char(F.lit(65) + F.col("n_nationkey"))).alias("iso2Code"),
            F.concat("n_name", F.lit(" & Co")).alias("name"),
            F.struct(
                F.when(F.col("r_name") == "ASIA", "NA").otherwise("XX").alias("id"), F.col("r_name").alias("value")
            ).alias("region"),
            F.struct(F.col("c_mktsegment").alias("value")).alias("incomeLevel"),
            F.struct(F.concat(F.lit("L"), F.col("r_regionkey").cast("string")).alias("value")).alias("lendingType"),
        )
    )
    return payloads.flatten_country_metadata(places.select(payload.alias("j")), "j")


@query(
    "flatten_indicator_records",
    """
    SELECT event_type AS indicator_id, 'U' || CAST(user_id AS VARCHAR) AS countryiso3code,
           'user ' || CAST(user_id AS VARCHAR) AS country_name, CAST(day(ts) AS VARCHAR) AS year,
           round(value, 6) AS value, 'x' AS unit, CAST(NULL AS VARCHAR) AS obs_status
    FROM events
    """,
)
def _flatten_indicator_records(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    record = F.struct(
        F.col("event_type").alias("indicator_id"),
        F.concat(F.lit("U"), user).alias("countryiso3code"),
        F.struct(F.concat(F.lit("user "), user).alias("value")).alias("country"),
        F.dayofmonth("ts").cast("string").alias("date"),
        F.col("value").alias("value"),
        F.lit("x").alias("unit"),
        F.lit(None).cast("string").alias("obs_status"),
    )
    payload = F.to_json(F.array(record))
    return rounded(payloads.flatten_indicator_records(t.events.select(payload.alias("j")), "j"), 6)


@query(
    "require_columns",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS gvkey, upper(s_name) AS ticker FROM supplier WHERE s_acctbal > 0
    """,
)
def _require_columns(t: Tables) -> DataFrame:
    ticker = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("  "), "s_name", F.lit(" "))).otherwise("  ")
    user = t.supplier.select(F.col("s_suppkey").cast("string").alias("gvkey"), ticker.alias("ticker"))
    return linking.ticker_hints(user)


@query(
    "normalize_delimited",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'two' || chr(10) || 'lines; ' || c_name AS note, c_mktsegment
    FROM customer
    """,
)
def _normalize_delimited(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "semicolons")
    rows = t.customer.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.concat(F.lit("two\nlines; "), "c_name").alias("note"),
        "c_mktsegment",
    )
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return tables.normalize_delimited(t.spark, path)


@query(
    "write_table",
    """
    SELECT f AS fmt, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, round(sum(l_quantity), 2) AS quantity
    FROM lineitem, (VALUES ('csv'), ('csv.gz'), ('parquet')) AS v(f) GROUP BY 1
    """,
)
def _write_table(t: Tables) -> DataFrame:
    out = None
    for fmt in ("csv", "csv.gz", "parquet"):
        path = scratch_path(t.spark, "sink")
        tables.write_table(t.lineitem.select("l_orderkey", "l_quantity"), path, fmt)
        back = t.spark.read.parquet(path) if fmt == "parquet" else tables.read_delimited(t.spark, path)
        back = tables.coerce(back, {"l_orderkey": "bigint", "l_quantity": "double"})
        one = back.agg(
            F.lit(fmt).alias("fmt"),
            F.count("*").alias("n_rows"),
            F.countDistinct("l_orderkey").alias("n_orders"),
            F.round(F.sum("l_quantity"), 2).alias("quantity"),
        )
        out = one if out is None else out.unionByName(one)
    return out
