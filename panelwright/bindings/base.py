"""Registry of queries over the test tables, and the views that give those tables their research roles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Input views in SQL that both engines read alike; ``{name}`` stands for a table or another view.
VIEWS = {
    # One scored item per order: owner, years, country codes, scores and class flags.
    "scored": """
        SELECT o.o_orderkey AS patent_id, o.o_custkey AS gvkey,
               CAST(year(o.o_orderdate) AS INT) AS app_year,
               CAST(year(o.o_orderdate) AS INT)
                 + CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS grant_year,
               'N' || chr(65 + c.c_nationkey) AS assignee_iso2,
               CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL
                    ELSE 'N' || chr(65 + (c.c_nationkey + 1) % 25) || 'T' END AS inventor_iso2,
               CAST(floor(o.o_totalprice / 10000) AS INT) AS num_claims,
               o.o_orderstatus, o.o_orderpriority, c.c_mktsegment, c.c_nationkey,
               o.o_totalprice / 499979 AS benchmark_score,
               CASE WHEN o.o_totalprice >= 250000 THEN 1 ELSE 0 END AS benchmark_flag,
               abs(o.o_totalprice / 499979 - 0.5) * 2 AS benchmark_confidence,
               sqrt(o.o_totalprice / 499979) AS dictionary_score,
               (c.c_acctbal + 1000) / 11000 AS metadata_score,
               o.o_totalprice / 600011 AS text_supervised_score,
               o.o_totalprice / 700001 AS semantic_lsa_score,
               o.o_totalprice / 800011 AS data_collection_score,
               o.o_totalprice / 900001 AS empirical_analysis_score,
               o.o_totalprice / 1000003 AS experimental_validation_score,
               o.o_totalprice / 1100009 AS measurement_instrumentation_score,
               o.o_totalprice / 1200007 AS data_quality_calibration_score,
               o.o_totalprice / 1300021 AS ml_training_data_score,
               o.o_totalprice / 1400017 AS boilerplate_score,
               CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS has_measurement_cpc,
               CASE WHEN o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS has_testing_cpc,
               CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS has_ml_cpc,
               CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END AS has_data_processing_cpc,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS has_bio_assay_cpc,
               CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS has_statistics_cpc
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    """,
    # Country codes: two letters to three.
    "iso_map": "SELECT 'N' || chr(65 + n_nationkey) AS iso2, 'N' || chr(65 + n_nationkey) || 'T' AS iso3 FROM {nation}",
    # Cited part -> citing order, and what is known about both ends.
    "edges": "SELECT l_partkey AS patent_id, l_orderkey AS citing_id, l_returnflag AS category FROM {lineitem}",
    "cited": "SELECT p_partkey AS patent_id, CAST(1992 + p_size % 8 AS INT) AS app_year FROM {part}",
    "citing_year": "SELECT o_orderkey AS citing_id, CAST(year(o_orderdate) AS INT) AS app_year FROM {orders}",
    "citing_class": """
        SELECT o.o_orderkey AS citing_id, c.c_mktsegment || '-' || o.o_orderpriority AS subclass
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    """,
    "citing_size": """
        SELECT o.o_orderkey AS citing_id, CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal / 10 END AS employees
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    """,
    # Classes of parts: brand now, type at issue.
    "part_class": "SELECT p_partkey AS patent_id, p_brand AS label FROM {part}",
    "shipped": "SELECT l_partkey AS patent_id, CAST(year(l_shipdate) AS INT) AS app_year FROM {lineitem}",
    # Owner links: suppliers of an order.
    "owner_links": """
        SELECT l.l_suppkey AS owner_id, l.l_orderkey AS patent_id, CAST(year(o.o_orderdate) AS INT) AS app_year
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
    """,
    # Names to link: parts as firms, with a legal form and the odd typo; parts as registry rows.
    "firms": """
        SELECT 'F' || CAST(p_partkey AS VARCHAR(20)) AS gvkey,
               CASE WHEN p_size % 3 = 0 THEN upper(p_name) || ' Inc.'
                    WHEN p_size % 3 = 1 THEN replace(p_name, 'e', 'a') || ' Holdings Ltd'
                    ELSE p_name || '-' || p_type || ' Co' END AS firm_name,
               CAST(p_size AS BIGINT) AS patent_count
        FROM {part}
    """,
    "registry_raw": """
        SELECT CAST(p_partkey AS VARCHAR(20)) AS cik, p_brand AS ticker,
               CASE WHEN p_size % 2 = 0 THEN p_name || ' Corp' ELSE p_name || ' ' || p_type END AS sec_name,
               p_type AS exchange
        FROM {part}
    """,
    # Owner names by brand: the part name on most orders.
    "static_firms": """
        SELECT gvkey, firm_name, patent_count FROM (
          SELECT gvkey, firm_name, patent_count, row_number() OVER (PARTITION BY gvkey ORDER BY patent_count DESC, firm_name) AS rn
          FROM (SELECT p_brand AS gvkey, p_name AS firm_name, count(DISTINCT l_orderkey) AS patent_count
                FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, p_name) c) r
        WHERE rn = 1
    """,
    "no_hints": "SELECT p_brand AS gvkey, '' AS ticker FROM {part} WHERE p_size < 0",
    "hints_raw": """
        SELECT 'F' || CAST(p_partkey AS VARCHAR(20)) AS gvkey, ' ' || lower(p_brand) || ' ' AS ticker
        FROM {part} WHERE p_type = 'PROMO'
    """,
}


class Tables:
    """Parquet tables of one folder by attribute, and views by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        used |= {n: self.view(n) for n in VIEWS if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _expand(sql: str) -> str:
    """Replace ``{name}`` by the table name or by the view as a subquery."""
    for name, body in VIEWS.items():
        if "{" + name + "}" in sql:
            sql = sql.replace("{" + name + "}", f"({_expand(body)})")
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def register(run: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, _expand(sql) if sql else None)
        return run

    return register


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Floating columns rounded so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())
