"""Transparent text and class-code scores for evidence intensity, and the weak labels built on them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import sigmoid

# The pattern of each dimension; the last one marks generic digital wording.
TEXT_PATTERNS = {
    "data_collection": r"\b(data collection|collect(?:ing|ed)? data|data acquisition|dataset(?:s)?|observ(?:ed|ational) data|sample(?:d)? data|measurement data|telemetry data|sensor data|field data)\b",
    "empirical_analysis": r"\b(empirical|statistical (?:analysis|inference)|regression|hypothesis test|confidence interval|causal inference|estimate(?:d|s|ion)?|predictive model|infer(?:ence|red)|likelihood|bayesian|time[- ]series analysis)\b",
    "experimental_validation": r"\b(experiment(?:al)?|randomized|controlled trial|a/b test|testbed|validation (?:study|result|experiment)?|benchmark(?:ing|ed)?|ground truth|holdout set|cross[- ]validation|ablation)\b",
    "measurement_instrumentation": r"\b(sensor(?:s)?|instrumentation|detector|probe|meter|spectrometer|chromatograph|assay|biosensor|measurement system|measurement device|diagnostic device|imaging system)\b",
    "data_quality_calibration": r"\b(data quality|data cleaning|denois(?:e|ing)|outlier(?: detection)?|missing data|imput(?:e|ation)|calibrat(?:e|ion|ed)|verification|quality control|error correction|signal[- ]to[- ]noise|normalization)\b",
    "ml_training_data": r"\b(training data|training set|labeled data|supervised learning|unsupervised learning|machine learning|deep learning|neural network|model training|feature extraction|inference engine|classification model)\b",
    "boilerplate_digital": r"\b(receiv(?:e|ing) data|transmi(?:t|ssion) data|store(?:d|ing)? data|user interface|computer[- ]readable medium|processor configured to|network node|database server|memory device|execute instructions)\b",
}

# Weight of each dimension in the dictionary score.
DICTIONARY_WEIGHTS = {
    "data_collection": 1.15,
    "empirical_analysis": 1.25,
    "experimental_validation": 1.35,
    "measurement_instrumentation": 1.05,
    "data_quality_calibration": 1.25,
    "ml_training_data": 1.20,
}
BOILERPLATE = "boilerplate_digital"
SATURATION, DICTIONARY_OFFSET, BOILERPLATE_PENALTY = 2.0, 2.5, 1.4

# Weight of each class flag in the metadata score; the flags that count as signals.
METADATA_WEIGHTS = {
    "has_measurement_cpc": 1.2,
    "has_testing_cpc": 1.0,
    "has_ml_cpc": 1.15,
    "has_data_processing_cpc": 0.9,
    "has_bio_assay_cpc": 1.1,
    "has_statistics_cpc": 1.0,
}
METADATA_SIGNALS = (
    "has_measurement_cpc",
    "has_testing_cpc",
    "has_ml_cpc",
    "has_bio_assay_cpc",
    "has_statistics_cpc",
)
CLASS_COUNT_WEIGHT, METADATA_CENTER = 0.12, 1.2


def model_text(title: str, abstract: str) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))


def token_count(text: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(r"(?U)\w+"))


def regex_hits(df: DataFrame, text: str, patterns: Mapping[str, str] = TEXT_PATTERNS) -> DataFrame:
    """One ``<dimension>_hits`` column per pattern over a lower-case text."""
    return df.withColumns(
        {f"{d}_hits": F.regexp_count(F.col(text), F.lit(p)).cast("double") for d, p in patterns.items()}
    )


def saturating_scores(
    df: DataFrame, weights: Mapping[str, float] = DICTIONARY_WEIGHTS, boilerplate: str = BOILERPLATE
) -> DataFrame:
    """Component scores ``1 - exp(-hits/2)`` and the dictionary score built from them."""

    def score(dimension: str) -> Column:
        return F.lit(1.0) - F.exp(-F.col(f"{dimension}_hits") / SATURATION)

    with_parts = df.withColumns(
        {**{f"{d}_score": score(d) for d in weights}, "boilerplate_score": score(boilerplate)}
    )
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{d}_score") for d, w in weights.items()])
    return with_parts.withColumn(
        "dictionary_score", total / (total + DICTIONARY_OFFSET + F.lit(BOILERPLATE_PENALTY) * F.col("boilerplate_score"))
    )


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def metadata_score(df: DataFrame, class_count: str = "cpc_total_count") -> DataFrame:
    """Weighted class flags through a sigmoid, and how many signal flags are set; absent columns count 0."""
    raw = reduce(lambda a, b: a + b, [F.lit(w) * _flag(df, c) for c, w in METADATA_WEIGHTS.items()])
    raw = raw + F.lit(CLASS_COUNT_WEIGHT) * F.log1p(_flag(df, class_count))
    signals = reduce(lambda a, b: a + b, [_flag(df, c) for c in METADATA_SIGNALS])
    return df.withColumns(
        {"metadata_score": sigmoid(raw - METADATA_CENTER), "metadata_signal_count": signals}
    )


# Thresholds of the weak labels.
SEED_STRONG, SEED_SIGNALLED, SEED_MOST_BOILERPLATE = 0.30, 0.28, 0.65
SEED_WEAK, SEED_NONE, SEED_SOME_BOILERPLATE, SEED_MUCH_BOILERPLATE = 0.06, 0.03, 0.20, 0.45


def seed_labels(df: DataFrame) -> DataFrame:
    """Weak label: 1 for clear evidence wording, 0 for clear boilerplate without any, else null."""

    def hits(*dimensions: str) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"{d}_hits") for d in dimensions])

    evidence = hits(*DICTIONARY_WEIGHTS)
    strong = hits(
        "experimental_validation", "ml_training_data", "data_quality_calibration", "measurement_instrumentation"
    )
    dictionary, boilerplate = F.col("dictionary_score"), F.col("boilerplate_score")
    signals = F.col("metadata_signal_count")
    positive = (
        ((strong >= 2) & (dictionary >= SEED_STRONG) & (boilerplate <= SEED_MOST_BOILERPLATE))
        | ((evidence >= 2) & (dictionary >= SEED_SIGNALLED) & (signals >= 1))
        | ((hits("ml_training_data") >= 1) & (hits("experimental_validation") >= 1))
        | ((hits("data_quality_calibration") >= 1) & (hits("empirical_analysis") >= 1))
    )
    silent = (evidence == 0) & (signals == 0)
    generic = (boilerplate >= SEED_SOME_BOILERPLATE) | (_flag(df, "has_data_processing_cpc") >= 1)
    little, none = silent & (dictionary <= SEED_WEAK), silent & (dictionary <= SEED_NONE)
    negative = (little & generic) | (none & (boilerplate >= SEED_MUCH_BOILERPLATE))
    return df.withColumn("seed_label", F.when(positive, 1).when(negative, 0))


def evidence_features(
    df: DataFrame, text: str, patterns: Mapping[str, str] = TEXT_PATTERNS
) -> DataFrame:
    """All transparent features and the weak label of a lower-case text column."""
    counted = regex_hits(df.withColumn("n_tokens", token_count(text)), text, patterns)
    return seed_labels(metadata_score(saturating_scores(counted)))


def flag_and_confidence(score: str, threshold: float) -> dict[str, Column]:
    p = F.col(score)
    return {
        "benchmark_flag": F.when(p >= threshold, 1).otherwise(0),
        "benchmark_confidence": F.abs(p - 0.5) * 2,
    }
