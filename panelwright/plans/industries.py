"""Industry-year panels by fractional allocation of items through an industry crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_digits
from ..operators.aggregates import (
    SCORE_COLUMNS,
    coverage_report,
    fractional_weights,
    industry_year_weighted,
)
from ..operators.joins import policy_attach, year_or_mode_join
from ..operators.ranking import best_owner, mode_by_key
from .backbone import FLAGS

POLICY_MEANS = {
    "policy_privacy_level_mean": "datagouv_privacy_level_ordinal",
    "policy_ecipe_cum_mean": "ecipe_dte_n_measures_cum",
}
POLICY_LAW = ("policy_unctad_privacy_law_share", "unctad_privacy_and_data_protection_code")


def items_with_industry(
    items: DataFrame, owners: DataFrame, firm_year: DataFrame, iso_map: DataFrame, policy: DataFrame
) -> DataFrame:
    """Items with owner, industry key and the policy values of their country and year."""
    owned = items.join(
        best_owner(owners, "patent_id", "gvkey", "app_year", newest_first=False).select("patent_id", "gvkey"),
        "patent_id",
        "left",
    )
    known = firm_year.where("sic is not null")
    modes = mode_by_key(known, "gvkey", "sic", "sic_mode")
    firm_sic = firm_year.withColumnRenamed("year", "app_year")
    coded = year_or_mode_join(owned, firm_sic, modes, "gvkey", "app_year", "sic", "sic_mode", "sic_raw")
    keyed = coded.withColumn("sic_key", normalize_digits("sic_raw"))
    return policy_attach(keyed, iso_map, policy, "assignee_country_mode", "app_year")


def industry_levels(items: DataFrame, crosswalk: DataFrame, levels: tuple[int, ...] = (2, 3, 4)) -> dict[int, DataFrame]:
    scores = ("benchmark_score", *SCORE_COLUMNS)
    out = {}
    for level in levels:
        weights = fractional_weights(crosswalk, "sic_key", f"naics{level}")
        panel = industry_year_weighted(
            items, weights, "sic_key", "app_year", "benchmark_flag", scores, FLAGS, POLICY_MEANS, POLICY_LAW
        )
        # The flag shares keep the flag name, with "_share" at the end.
        out[level] = panel.withColumn("naics_level", F.lit(level))
    return out


def mapping_coverage(items: DataFrame) -> DataFrame:
    return coverage_report(items, ["gvkey", "sic_key", "iso3c"])
