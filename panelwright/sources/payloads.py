"""Flattening of JSON payloads held in a string column, one payload per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import bucket_industry_code, numeric_with_commas
from ..functions.numbers import parse_int
from ..functions.text import compact_name, normalize_country_name, normalize_name, pad_id, slugify
from ..operators.aggregates import ANNUAL_FORMS
from ..operators.ranking import keep_best


def _by_name(header: str, row: str, name: str) -> Column:
    """Cell of an array row at the position the header array gives to a name."""
    at = F.array_position(header, F.lit(name)).cast("int")
    return F.when(at > 0, F.try_element_at(F.col(row), at))


def explode_fields_rows(df: DataFrame, payload: str) -> DataFrame:
    """``{fields: [...], data: [[...]]}`` to registry rows with padded id and name keys."""
    parsed = df.select(
        F.from_json(payload, "struct<fields: array<string>, data: array<array<string>>>").alias("p")
    ).select("p.fields", F.explode("p.data").alias("row"))
    cell = {n: _by_name("fields", "row", n) for n in ("cik", "name", "ticker", "exchange")}
    return parsed.select(
        pad_id(cell["cik"]).alias("cik"),
        F.upper(F.coalesce(cell["ticker"], F.lit(""))).alias("ticker"),
        cell["name"].alias("sec_name"),
        normalize_name(cell["name"]).alias("sec_name_norm"),
        compact_name(cell["name"]).alias("sec_name_compact"),
        cell["exchange"].alias("exchange"),
    )


SERIES_SCHEMA = (
    "struct<Results: struct<series: array<struct<seriesID: string, "
    "data: array<struct<year: string, period: string, value: string>>>>>>"
)


def flatten_series_json(df: DataFrame, payload: str, names: Mapping[str, str], period: str = "A01") -> DataFrame:
    """Annual values of the mapped series, one column per metric, averaged per year."""
    series = df.select(F.inline(F.from_json(payload, SERIES_SCHEMA)["Results"]["series"]))
    points = (
        series.where(F.col("seriesID").isin(*names))
        .select("seriesID", F.inline("data"))
        .where(F.col("period") == period)
        .select("seriesID", parse_int("year").cast("int").alias("year"), F.col("value").try_cast("double").alias("value"))
        .dropna(subset=["year", "value"])
    )
    return points.groupBy("year").agg(
        *[F.avg(F.when(F.col("seriesID") == s, F.col("value"))).alias(n) for s, n in names.items()]
    )


def flatten_header_row_json(df: DataFrame, payload: str, keys: Sequence[str], size_class: str = "001") -> DataFrame:
    """``[[header...], [row...], ...]``: the first row of the wanted size class per payload, with payroll per head."""
    rows = df.select(*keys, F.from_json(payload, "array<array<string>>").alias("p")).where(F.size("p") >= 2)
    header = F.element_at("p", 1)
    wanted = F.array_position(header, F.lit("EMPSZES")).cast("int")
    hits = F.filter(
        F.slice("p", F.lit(2), F.size("p") - 1), lambda r: F.try_element_at(r, wanted) == size_class
    )
    picked = rows.select(*keys, header.alias("h"), F.try_element_at(hits, F.lit(1)).alias("r")).where("r is not null")
    emp, pay, estab = (_by_name("h", "r", c).try_cast("double") for c in ("EMP", "PAYANN", "ESTAB"))
    return picked.select(
        *keys,
        emp.alias("census_cbp_emp"),
        pay.alias("census_cbp_payann_thousand"),
        estab.alias("census_cbp_estab"),
        F.when(emp > 0, pay * 1000 / emp).alias("census_cbp_payroll_per_employee"),
    )


FACTS_SCHEMA = (
    "struct<facts: struct<`us-gaap`: map<string, struct<units: "
    "map<string, array<struct<fy: int, val: double, form: string>>>>>>>"
)


def flatten_facts_json(
    df: DataFrame, payload: str, keys: Sequence[str], forms: Sequence[str] = ANNUAL_FORMS
) -> DataFrame:
    """Company facts to rows (keys, tag, unit, position, year, value) from annual forms."""
    tags = df.select(*keys, F.explode(F.from_json(payload, FACTS_SCHEMA)["facts"]["us-gaap"]).alias("tag", "node"))
    units = tags.select(*keys, "tag", F.explode("node.units").alias("unit", "items"))
    items = units.select(*keys, "tag", "unit", F.posexplode("items").alias("position", "item"))
    return (
        items.where(F.col("item.form").isin(*forms))
        .select(*keys, "tag", "unit", "position", F.col("item.fy").alias("year"), F.col("item.val").alias("value"))
        .dropna(subset=["year", "value"])
    )


FILINGS_SCHEMA = (
    "struct<sic: string, sicDescription: string, stateOfIncorporation: string, fiscalYearEnd: string, "
    "entityType: string, name: string, tickers: array<string>, filings: struct<recent: struct<"
    "accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, "
    "form: array<string>, primaryDocument: array<string>>>>"
)


def flatten_filings_json(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """Parallel arrays of recent filings to one row per filing."""
    recent = F.from_json(payload, FILINGS_SCHEMA)["filings"]["recent"]
    names = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
    zipped = F.arrays_zip(*[recent[n].alias(n) for n in names])
    return df.select(*keys, F.inline(zipped)).toDF(*keys, *names)


def firm_profile_json(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    p = F.from_json(payload, FILINGS_SCHEMA)
    return df.select(
        *keys,
        p["sic"].alias("sic"),
        p["sicDescription"].alias("sic_description"),
        p["stateOfIncorporation"].alias("state_of_incorporation"),
        p["fiscalYearEnd"].alias("fiscal_year_end"),
        p["entityType"].alias("entity_type"),
        p["name"].alias("name_sec"),
        F.try_element_at(p["tickers"], F.lit(1)).alias("ticker_sec"),
    )


INDUSTRY_SCHEMA = (
    "struct<BEAAPI: struct<Results: struct<Data: "
    "array<struct<Year: string, Industry: string, DataValue: string>>>>>"
)


def flatten_industry_json(df: DataFrame, payload: str, low: int, high: int) -> DataFrame:
    """Mean value per year and sector root of an industry accounts payload."""
    rows = df.select(F.inline(F.from_json(payload, INDUSTRY_SCHEMA)["BEAAPI"]["Results"]["Data"]))
    return industry_sector_means(rows, "Year", "Industry", "DataValue", low, high)


def industry_sector_means(df: DataFrame, year: str, code: str, value: str, low: int, high: int) -> DataFrame:
    """Sub-industry values averaged into their sector root; codes without a root are dropped."""
    return (
        df.select(
            parse_int(year).cast("int").alias("year"),
            bucket_industry_code(code).alias("naics2_proxy"),
            numeric_with_commas(value).alias("v"),
        )
        .where(F.col("year").between(low, high))
        .dropna()
        .groupBy("year", "naics2_proxy")
        .agg(F.avg("v").alias("bea_gdp_by_industry_value"))
    )


# Law domains in payload order, and the labels of the status codes.
LAW_DOMAINS = (
    "Electronic Transactions",
    "Consumer Protection",
    "Privacy and Data Protection",
    "Cybercrime",
    "Indirect Taxation",
)
LAW_STATUS = {0: "no_data", 1: "legislation", 2: "draft_legislation", 3: "no_legislation"}


def unpivot_map_json(
    df: DataFrame,
    payload: str,
    domains: Sequence[str] = LAW_DOMAINS,
    labels: Mapping[int, str] = LAW_STATUS,
    key: str = "iso2c",
) -> DataFrame:
    """``{code: [status...]}`` to long rows; lists of the wrong length are dropped."""
    entries = df.select(F.explode(F.from_json(payload, "map<string, array<int>>")).alias(key, "codes"))
    valid = entries.where(F.size("codes") == len(domains))
    long = valid.select(key, F.posexplode("codes").alias("at", "status_code"))
    names = F.array(*[F.lit(d) for d in domains])
    label = F.lit("unknown")
    for code, text in labels.items():
        label = F.when(F.col("status_code") == code, text).otherwise(label)
    domain = F.element_at(names, F.col("at") + 1)
    return long.select(
        key,
        domain.alias("law_domain"),
        slugify(domain).alias("law_domain_slug"),
        "status_code",
        label.alias("status_label"),
    )


def pivot_laws(long: DataFrame, slugs: Sequence[str], key: str = "iso2c") -> DataFrame:
    """Long law rows to ``<slug>_code`` and ``<slug>_status`` columns."""
    aggs = []
    for s in slugs:
        here = F.col("law_domain_slug") == s
        aggs.append(F.max(F.when(here, F.col("status_code"))).alias(f"{s}_code"))
        aggs.append(F.max(F.when(here, F.col("status_label"))).alias(f"{s}_status"))
    return long.groupBy(key).agg(*aggs)


COUNTRY_SCHEMA = (
    "struct<id: string, iso2Code: string, name: string, region: struct<id: string, value: string>, "
    "incomeLevel: struct<value: string>, lendingType: struct<value: string>>"
)


def flatten_country_metadata(df: DataFrame, payload: str) -> DataFrame:
    """Country records without aggregates, one per three-letter code, with a normalised name."""
    c = F.from_json(payload, COUNTRY_SCHEMA)
    rows = df.select(
        c["id"].alias("iso3c"),
        c["iso2Code"].alias("iso2c"),
        c["name"].alias("wb_country_name"),
        c["region"]["value"].alias("wb_region"),
        c["incomeLevel"]["value"].alias("wb_income_level"),
        c["lendingType"]["value"].alias("wb_lending_type"),
        c["region"]["id"].alias("__region"),
    )
    kept = rows.where((F.length("iso3c") == 3) & ~F.col("__region").eqNullSafe("NA")).drop("__region")
    best = keep_best(kept, ["iso3c"], [F.col(c) for c in kept.columns if c != "iso3c"])
    return best.withColumn("wb_name_norm", normalize_country_name("wb_country_name"))


INDICATOR_SCHEMA = (
    "array<struct<indicator_id: string, countryiso3code: string, country: struct<value: string>, "
    "date: string, value: double, unit: string, obs_status: string>>"
)


def flatten_indicator_records(df: DataFrame, payload: str) -> DataFrame:
    """A page of indicator records to long rows."""
    records = df.select(F.inline(F.from_json(payload, INDICATOR_SCHEMA)))
    return records.select(
        "indicator_id",
        "countryiso3code",
        F.col("country.value").alias("country_name"),
        F.col("date").alias("year"),
        "value",
        "unit",
        "obs_status",
    )


def stack_indicators(
    frames: Sequence[DataFrame], indicators: Sequence[str], keys: Sequence[str], indicator: str, value: str, order: Sequence[str]
) -> DataFrame:
    """Long tables stacked and widened by the first non-null value per cell in a stated order."""
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    long = long.dropna(subset=list(keys))

    def first(name: str) -> Column:
        here = (F.col(indicator) == name) & F.col(value).isNotNull()
        return F.min_by(value, F.when(here, F.struct(*order))).alias(name)

    return long.groupBy(*keys).agg(*[first(i) for i in indicators])
