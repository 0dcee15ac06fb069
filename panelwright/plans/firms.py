"""Firm-year panel with registry links, facts and context, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import bucket_sic_to_naics
from ..operators.aggregates import firm_year_panel
from ..operators.describe import top_firms
from ..operators.joins import attach_context, attach_links_to_panel
from ..operators.linking import LinkConfig, link_firms, manual_links, manual_override
from ..operators.ranking import primary_name


def clean_year_range(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.where(F.col("year").between(low, high)) if "year" in df.columns else df


@dataclass(frozen=True)
class FirmPanelConfig:
    start_year: int = 1980
    end_year: int = 2024
    max_firms: int | None = None
    link: LinkConfig = field(default_factory=LinkConfig)


def enriched_firm_years(
    static: DataFrame,
    registry: DataFrame,
    facts: DataFrame | None,
    config: FirmPanelConfig = FirmPanelConfig(),
    hints: DataFrame | None = None,
    manual: DataFrame | None = None,
    contexts: Sequence[tuple[DataFrame, Sequence[str]]] = (),
) -> dict[str, DataFrame]:
    """Panel, links, candidates, conflicts and the enriched panel from owner rows and a registry.

    ``facts`` holds one row per (cik, year), with ``sic`` if sector context is to be attached.
    """
    panel = firm_year_panel(
        static, "gvkeyUO", "appYear", "patent_id", "grantYear", "privateSubsidiary", "clean_name"
    )
    names = primary_name(static, "gvkeyUO", "clean_name", "patent_id", "firm_name", "patent_count")
    names = names.withColumnRenamed("gvkeyUO", "gvkey")
    if config.max_firms is not None:
        panel = top_firms(panel, names, "gvkey", "patent_count", config.max_firms)
        names = top_firms(names, names, "gvkey", "patent_count", config.max_firms)
    links, candidates, conflicts = link_firms(names, registry, hints, config.link)
    if manual is not None:
        links = manual_override(links, manual_links(manual), registry)
    panel = clean_year_range(panel, config.start_year, config.end_year)
    if facts is not None:
        facts = clean_year_range(facts, config.start_year, config.end_year)
        if "sic" in facts.columns:
            facts = facts.withColumn("naics2_proxy", bucket_sic_to_naics("sic"))
        facts = attach_context(facts, contexts)
    columns = ["gvkey", "cik", "link_method", "link_score", "link_conflict"]
    columns += ["candidate_count", "ticker_hint"] if facts is not None else []
    enriched = attach_links_to_panel(panel, links.select(*columns), facts, "gvkey", "cik", "year")
    if facts is None:
        enriched = attach_context(enriched, [c for c in contexts if list(c[1]) == ["year"]])
    return {
        "patent_firm_year_panel": panel,
        "links": links,
        "link_candidates": candidates,
        "link_conflicts": conflicts,
        "firm_year_enriched": enriched,
    }
