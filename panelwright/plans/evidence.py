"""Evidence scoring from the backbone to country-year panels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.evidence import TEXT_PATTERNS, evidence_features, model_text
from ..operators.aggregates import country_year_scores
from ..operators.aggregates import country_year_variants as scores_by_variant
from ..operators.describe import prefix_measures
from ..operators.joins import iso2_to_iso3
from ..operators.learning import EvidenceModel, balanced_sample, fit_evidence_model, hash_split, score_texts
from ..operators.ranking import with_quantile


def with_features(backbone: DataFrame, patterns: Mapping[str, str] = TEXT_PATTERNS) -> DataFrame:
    text = backbone.withColumn("text_for_model", model_text("patent_title", "patent_abstract"))
    return evidence_features(text, "text_for_model", patterns)


def train(features: DataFrame, per_class_train: int = 120_000, per_class_holdout: int = 30_000) -> tuple[EvidenceModel, DataFrame]:
    """Model and method comparison from weak labels, split by identifier hash."""
    caps = {False: per_class_train, True: per_class_holdout}
    split = hash_split(features, "patent_id")
    sample = balanced_sample(split, "patent_id", "seed_label", "is_holdout", caps)
    return fit_evidence_model(sample, "text_for_model", "seed_label", "is_holdout")


def score(model: EvidenceModel, backbone: DataFrame) -> DataFrame:
    return score_texts(model, with_features(backbone), "text_for_model").drop("text_for_model")


def country_year_variants(scored: DataFrame, iso_map: DataFrame) -> dict[str, DataFrame]:
    """The four country-year panels stacked, and the preferred one with prefixed measures."""
    coded = iso2_to_iso3(scored, iso_map, "assignee_country_mode", "assignee_iso3")
    coded = iso2_to_iso3(coded, iso_map, "inventor_country_mode", "inventor_iso3")
    marked = with_quantile(coded, "benchmark_score", 0.9, "threshold")
    variants = {(b, k): (f"{b}_iso3", f"{k}_year") for b in ("assignee", "inventor") for k in ("app", "grant")}
    preferred = country_year_scores(marked, *variants["assignee", "app"])
    return {
        "all_variants": scores_by_variant(marked, variants),
        "benchmark": prefix_measures(preferred, ["iso3c", "year"]),
    }


def merge_into_panel(panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The panel with the benchmark measures where they exist."""
    return panel.join(benchmark, ["iso3c", "year"], "left")
