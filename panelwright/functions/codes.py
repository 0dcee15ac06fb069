"""Classification codes: industry buckets, country codes, label dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import as_col, trim_all

# First two digits of the older code -> sector bucket.
SIC_SECTOR_RANGES = (
    (1, 9, "11"),
    (10, 14, "21"),
    (15, 17, "23"),
    (20, 39, "31-33"),
    (40, 47, "48-49"),
    (48, 48, "51"),
    (49, 49, "22"),
    (50, 51, "42"),
    (52, 59, "44-45"),
    (60, 67, "52"),
    (70, 89, "54"),
)

# Sector roots of the newer code.
SECTOR_ROOTS = (
    "11", "21", "22", "23", "31-33", "42", "44-45", "48-49", "51", "52",
    "53", "54", "55", "56", "61", "62", "71", "72", "81",
)

# Codes that are historical or not in the ISO list.
EXTRA_ISO_CODES = {"XK": "XKX", "SU": "SUN", "YU": "YUG", "AN": "ANT", "TP": "TMP", "ZR": "ZAR"}

# Class prefixes behind the six technology flags.
CLASS_PREFIXES = {
    "has_measurement_cpc": ("G01", "A61B5", "G06M", "G01N"),
    "has_testing_cpc": ("G01M", "G06F11", "G05B23", "H04L43"),
    "has_ml_cpc": ("G06N", "G06V", "G16H"),
    "has_data_processing_cpc": ("G06F17", "G06F19", "G06Q", "H04L"),
    "has_bio_assay_cpc": ("C12Q", "C12M", "A61B10", "G01N33"),
}
STATISTICS_GROUP_PREFIXES = ("G06F17/18", "G06N7", "G06F16")
STATISTICS_SUBCLASS_PREFIXES = ("G06N7",)

ISO3 = r"^[A-Z]{3}$"


def bucket_sic_to_naics(value: str | Column) -> Column:
    """Sector bucket of an older four-digit industry code kept as text."""
    head = F.substring(trim_all(as_col(value).cast("string")), 1, 2).try_cast("int")
    out = F.lit(None).cast("string")
    for low, high, bucket in reversed(SIC_SECTOR_RANGES):
        out = F.when(head.between(low, high), bucket).otherwise(out)
    return out


def bucket_industry_code(value: str | Column) -> Column:
    """Sector root of a newer industry code: whole code, then two digits, then joint sectors."""
    code = F.coalesce(trim_all(as_col(value).cast("string")), F.lit(""))
    head = F.substring(code, 1, 2)
    single = [root for root in SECTOR_ROOTS if "-" not in root]
    return (
        F.when(code.isin(*SECTOR_ROOTS), code)
        .when(head.isin(*single), head)
        .when(head.isin("31", "32", "33"), "31-33")
        .when(head.isin("44", "45"), "44-45")
        .when(head.isin("48", "49"), "48-49")
    )


def numeric_with_commas(value: str | Column) -> Column:
    return trim_all(F.replace(as_col(value).cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def map_codes(value: str | Column, codes: Mapping[str, int], trim: bool = False) -> Column:
    """Exact label -> number; labels that are not listed become null."""
    label = trim_all(value) if trim else as_col(value)
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), label)


def starts_with_any(value: str | Column, prefixes: Sequence[str]) -> Column:
    """1 if the text starts with any prefix, else 0; null counts as no."""
    value = as_col(value)
    hit = reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes])
    return F.coalesce(hit, F.lit(False)).cast("int")


def prefix_flags(df: DataFrame, column: str, prefixes: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.withColumns({name: starts_with_any(column, heads) for name, heads in prefixes.items()})


def technology_flags(df: DataFrame, subclass: str, group: str) -> DataFrame:
    """The six flags. Only the statistics flag also looks at the full group code."""
    statistics = F.greatest(
        starts_with_any(group, STATISTICS_GROUP_PREFIXES),
        starts_with_any(subclass, STATISTICS_SUBCLASS_PREFIXES),
    )
    return prefix_flags(df, subclass, CLASS_PREFIXES).withColumn("has_statistics_cpc", statistics)


def iso_country_table(spark: SparkSession, extras: Mapping[str, str] = EXTRA_ISO_CODES) -> DataFrame:
    """(iso2, iso3) from the JVM's ISO 3166 list plus the extra codes; about 250 rows."""
    locale = spark._jvm.java.util.Locale
    codes = {c: locale("", c).getISO3Country() for c in locale.getISOCountries()}
    codes.update({k: v for k, v in extras.items() if k not in codes})
    # From an Arrow table the rows become a local relation of known size, which joins can broadcast by themselves.
    iso2, iso3 = zip(*sorted(codes.items()))
    return spark.createDataFrame(pa.table({"iso2": list(iso2), "iso3": list(iso3)}))
