"""Country-year panel over national accounts, indicators, R&D statistics and digital-policy sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import log_plus1, log_positive, to_year
from ..operators.aggregates import count_by, filtered_series_mean, oecd_clean, run_summary, top_measures_pivot
from ..operators.joins import coalesce_cols, country_match, outer_join_chain, union_keys_panel
from ..operators.ranking import cumulative_policy

# Country names the registry writes differently, and names that are no country.
MANUAL_CODES = {
    "BRUNEI": "BRN",
    "CZECH REPUBLIC": "CZE",
    "HONG KONG": "HKG",
    "KOREA": "KOR",
    "RUSSIA": "RUS",
    "SLOVAKIA": "SVK",
    "TAIWAN": "TWN",
    "TURKEY": "TUR",
    "VIETNAM": "VNM",
}
NOT_COUNTRIES = ("EUROPEAN UNION",)
EXTRA_ECONOMIES = ("TWN",)

_GERD = {"MEASURE": "G", "TYPE_COST": "_T", "UNIT_MEASURE": "USD_PPP", "PRICE_BASE": "Q"}
_STAFF = {
    "MEASURE": "T_RD", "FORD": "_T", "ACTIVITY": "_T", "FUNCTION": "_T", "EDUCATION_LEV": "_T", "SEX": "_T",
    "EMP_STATUS": "INT", "UNIT_MEASURE": "PS_FTE",
}
_SUPPORT = {"SIZE": "_Z", "PROFIT_SCENARIO": "_Z", "UNIT_MEASURE": "PT_B1GQ", "PRICE_BASE": "_Z"}
_SECTORS = {"total": "_T", "business": "BES", "government": "GOV", "highered": "HES"}

# The filters behind each R&D series, by source.
RD_SERIES: dict[str, dict[str, dict[str, str]]] = {
    "gerd": {f"oecd_gerd_{n}_usd_ppp_const2015": {**_GERD, "SECT_PERF": s} for n, s in _SECTORS.items()},
    "personnel": {f"oecd_rd_personnel_fte_{n}": {**_STAFF, "SECT_PERF": s} for n, s in _SECTORS.items()},
    "support": {
        "oecd_rdtax_pct_gdp": {**_SUPPORT, "MEASURE": "RDTAX"},
        "oecd_direct_funding_pct_gdp": {**_SUPPORT, "MEASURE": "DF"},
        "oecd_total_support_pct_gdp": {**_SUPPORT, "MEASURE": "RDTAXSUB"},
        "oecd_gbard_pct_gdp": {**_SUPPORT, "MEASURE": "GBARD"},
    },
    "subsidy": {
        f"oecd_b_index_{size.lower()}_{profit.lower()}": {
            "MEASURE": "RDSUB", "UNIT_MEASURE": "IX", "SIZE": size, "PROFIT_SCENARIO": profit,
        }
        for size in ("SME", "LARGE")
        for profit in ("PROFITABLE", "LOSS_MAKING")
    },
    "ip_tax": {"oecd_iptax_pct_gdp": {**_SUPPORT, "MEASURE": "IPTAX"}},
}


def rd_series(sources: Mapping[str, DataFrame], indicators: DataFrame | None = None, k: int = 8) -> DataFrame:
    """All R&D series by country and year; each source is read once whatever number of series it feeds."""
    frames = []
    for name, specs in RD_SERIES.items():
        if name in sources:
            clean = oecd_clean(sources[name], "REF_AREA", "TIME_PERIOD", "OBS_VALUE")
            frames.append(filtered_series_mean(clean, ["iso3c", "year"], "obs_value", specs))
    if indicators is not None:
        clean = oecd_clean(indicators, "REF_AREA", "TIME_PERIOD", "OBS_VALUE").where(
            (F.col("UNIT_MEASURE") == "PT_B1GQ") & (F.col("PRICE_BASE") == "_Z") & (F.col("TRANSFORMATION") == "_Z")
        )
        frames.append(
            top_measures_pivot(clean, ["iso3c", "year"], "MEASURE", "obs_value", k, "oecd_msti_", "_pct_gdp")
        )
    return outer_join_chain(frames, ["iso3c", "year"])


def policy_panel(measures: DataFrame, countries: DataFrame, year: str = "year_from_timeframe") -> tuple[DataFrame, DataFrame]:
    """Cumulative policy counts per country and year, and the name match behind them."""
    match = country_match(
        measures, "Country", countries, "wb_country_name", "iso3c", MANUAL_CODES, NOT_COUNTRIES
    )
    counts = count_by(measures.where(F.col(year).isNotNull()), ["Country", year])
    coded = counts.join(match, "Country").withColumn("year", to_year(year))
    return cumulative_policy(coded, "iso3c", "year", "n_measures"), match


def build_country_panel(
    timed: Sequence[DataFrame], static: Sequence[DataFrame], countries: DataFrame, names: Sequence[str] = ("country_name",)
) -> DataFrame:
    """Union of all country-years with every source, logs of the headline variables, and codes checked."""
    spark = countries.sparkSession
    extra = spark.createDataFrame([(c,) for c in EXTRA_ECONOMIES], "iso3c string")
    valid = countries.select("iso3c").unionByName(extra)
    profile = countries.drop("wb_name_norm")
    front = ["country_name", "wb_region", "wb_income_level", "wb_lending_type"]
    panel = union_keys_panel(timed, [*static, profile], "iso3c", "year", valid, front)
    panel = coalesce_cols(panel, [*names, "pwt_country_name", "wb_country_name"], "country_name")
    logs = {
        "log_gdp_per_capita_const_2015": ("NY.GDP.PCAP.KD", log_positive),
        "log_patent_resident_plus1": ("IP.PAT.RESD", log_plus1),
    }
    present = {n: f(F.col(f"`{c}`")) for n, (c, f) in logs.items() if c in panel.columns}
    if {"IP.PAT.RESD", "IP.PAT.NRES"} <= set(panel.columns):
        present["log_patent_total_plus1"] = log_plus1(F.col("`IP.PAT.RESD`") + F.col("`IP.PAT.NRES`"))
    return panel.withColumns(present) if present else panel


def panel_diagnostics(panel: DataFrame) -> DataFrame:
    return run_summary(panel, "iso3c", "year")
