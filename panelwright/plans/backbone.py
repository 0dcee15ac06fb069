"""One row per item with dates, text, countries and class profile."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import technology_flags
from ..functions.numbers import coerce_int
from ..functions.text import strip_quotes_upper
from ..operators.aggregates import SECTIONS, class_profile, coverage_report, patent_universe
from ..operators.joins import lookup_country, semi_join_universe, star_left_join
from ..operators.ranking import first_by_sequence, mode_by_key
from ..session import partitions_for, pinned
from ..sources.tables import clean_cells

KEY = "patent_id"
FLAGS = (
    "has_measurement_cpc", "has_testing_cpc", "has_ml_cpc", "has_data_processing_cpc", "has_bio_assay_cpc", "has_statistics_cpc",
)


@dataclass(frozen=True)
class BackboneInputs:
    """Text-typed source frames keyed by ``patent_id``."""

    static: DataFrame  # appYear, grantYear
    core: DataFrame  # patent_type, patent_date, patent_title, num_claims
    abstracts: DataFrame  # patent_abstract
    assignees: DataFrame  # assignee_sequence, location_id
    inventors: DataFrame  # inventor_sequence, location_id
    locations: DataFrame  # location_id, disambig_country
    classes: DataFrame  # cpc_section, cpc_subclass, cpc_group


def universe_of(static: DataFrame) -> DataFrame:
    rows = static.select(
        strip_quotes_upper(F.col(KEY).cast("string")).alias(KEY),
        coerce_int("appYear").alias("a"),
        coerce_int("grantYear").alias("g"),
    )
    return patent_universe(rows, KEY, "a", "g")


def party_countries(parties: DataFrame, universe: DataFrame, locations: DataFrame, sequence: str, prefix: str) -> list[DataFrame]:
    """Most frequent country and the country of the first-listed party, each one row per item."""
    places = locations.withColumnRenamed("disambig_country", "country")
    known = semi_join_universe(parties, universe, KEY)
    rows = lookup_country(known, places, "location_id", sequence).select(KEY, sequence, F.nullif("country", F.lit("")).alias("country"))
    return [
        mode_by_key(rows, KEY, "country", f"{prefix}_country_mode"),
        first_by_sequence(rows, KEY, sequence, "country", f"{prefix}_country_primary"),
    ]


def cleaned(x: BackboneInputs) -> BackboneInputs:
    """Quotes and blanks off every cell, item ids in upper and locations in lower case, in all sources alike."""

    def tidy(df: DataFrame) -> DataFrame:
        df = clean_cells(df, KEY)
        return df.withColumn("location_id", F.lower("location_id")) if "location_id" in df.columns else df

    return BackboneInputs(*[tidy(getattr(x, f.name)) for f in fields(x)])


def build_backbone(x: BackboneInputs) -> DataFrame:
    x = cleaned(x)
    # Six semi-joins and the panel itself read the universe: it is written once.
    universe = pinned(universe_of(x.static))
    date = F.to_date(F.try_to_timestamp("patent_date"))
    core = semi_join_universe(x.core, universe, KEY).select(
        KEY,
        date.alias("patent_date"),
        F.year(date).alias("patent_date_year"),
        "patent_type",
        coerce_int("num_claims").alias("num_claims"),
        "patent_title",
    )
    abstracts = semi_join_universe(x.abstracts, universe, KEY).select(KEY, "patent_abstract")
    classes = semi_join_universe(x.classes, universe, KEY)
    upper = classes.withColumns({c: F.upper(c) for c in ("cpc_section", "cpc_subclass", "cpc_group")})
    profile = class_profile(
        technology_flags(upper, "cpc_subclass", "cpc_group"), KEY, "cpc_subclass", "cpc_section", FLAGS, SECTIONS
    )
    parts = [
        core,
        abstracts,
        *party_countries(x.assignees, universe, x.locations, "assignee_sequence", "assignee"),
        *party_countries(x.inventors, universe, x.locations, "inventor_sequence", "inventor"),
        profile,
    ]
    # A part by itself needs few sort buffers; its partitions follow the tables it is made from.
    parts = [pinned(p) for p in parts]
    return star_left_join(universe.repartition(partitions_for(universe, *parts), KEY), parts, KEY)


def backbone_coverage(backbone: DataFrame) -> DataFrame:
    columns = ["patent_title", "patent_abstract", "assignee_country_mode", "inventor_country_mode", "cpc_total_count"]
    return coverage_report(backbone, columns)
