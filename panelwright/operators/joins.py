"""Joins that assemble panels. Strategy is left to Catalyst and AQE: nothing here forces a broadcast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ISO3, map_codes
from ..functions.numbers import to_year
from ..functions.text import normalize_country_name
from .ranking import keep_best


def semi_join_universe(df: DataFrame, universe: DataFrame, key: str, universe_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in the universe; never multiplies rows."""
    keys = universe.select(F.col(universe_key or key).alias(key))
    return df.join(keys, key, "left_semi")


def lookup_country(
    df: DataFrame, locations: DataFrame, location: str, sequence: str, country: str = "country", missing: int = 999
) -> DataFrame:
    """Country of a location id compared in lower case, and a sequence number that is never null."""
    places = keep_best(
        locations.where(F.col(location).isNotNull()).select(
            F.lower(F.col(location).cast("string")).alias("__loc"), F.upper(country).alias(country)
        ),
        ["__loc"],
        [F.col(country).asc_nulls_last()],
    )
    return (
        df.withColumn("__loc", F.lower(F.col(location).cast("string")))
        .join(places, "__loc", "left")
        .withColumn(sequence, F.coalesce(F.col(sequence).try_cast("double").try_cast("int"), F.lit(missing)))
        .drop("__loc")
    )


def star_left_join(
    base: DataFrame, parts: Sequence[DataFrame], key: str, zero_fill: Sequence[str] = ()
) -> DataFrame:
    """Base left-joined to parts that hold one row per key; every join uses the same key, so one exchange of
    the base serves the whole chain."""
    joined = reduce(lambda left, right: left.join(right, key, "left"), parts, base)
    return joined.fillna(0, list(zero_fill)) if zero_fill else joined


def outer_join_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda left, right: left.join(right, list(keys), "outer"), frames)


def front_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    present = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in present]
    # Indicator codes hold dots, so names are quoted.
    return df.select(*[F.col(f"`{c}`") for c in [*present, *rest]])


def union_keys_panel(
    timed: Sequence[DataFrame],
    static: Sequence[DataFrame],
    entity: str,
    year: str,
    valid: DataFrame | None = None,
    front: Sequence[str] = (),
) -> DataFrame:
    """Panel over the union of all (entity, year) keys with time-varying and then static columns."""
    keys = reduce(lambda a, b: a.unionByName(b), [f.select(entity, year) for f in timed]).dropna().distinct()
    if valid is not None:
        keys = keys.join(valid.select(entity).distinct(), entity, "left_semi")
    panel = star_left_join(keys, [], entity)
    for frame in timed:
        panel = panel.join(frame, [entity, year], "left")
    panel = star_left_join(panel, static, entity)
    return front_columns(panel, [entity, year, *front])


def load_panel(df: DataFrame, rename: Mapping[str, str], code: str, year: str, order: Sequence[Column]) -> DataFrame:
    """Selected and renamed columns, upper-case three-letter codes, whole years, first row per key.

    ``order`` makes "first" a property of the data instead of the file layout.
    """
    picked = df.select(*[F.col(old).alias(new) for old, new in rename.items()])
    clean = picked.withColumns({code: F.upper(F.col(code).cast("string")), year: to_year(year)})
    return keep_best(clean.where(F.col(code).rlike(ISO3)), [code, year], order)


def static_country_table(
    df: DataFrame, mapping: DataFrame, iso2: str, columns: Sequence[str], prefix: str, order: Sequence[Column]
) -> DataFrame:
    """One row per mapped country with chosen columns under a prefix; unmapped rows are dropped."""
    joined = df.join(mapping.select(F.col("iso2").alias(iso2), "iso3"), iso2)
    best = keep_best(joined, ["iso3"], order)
    return best.select(F.col("iso3").alias("iso3c"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def iso2_to_iso3(df: DataFrame, mapping: DataFrame, raw: str, out: str) -> DataFrame:
    """Three-letter codes pass through, two-letter codes are mapped, everything else is null."""
    code = F.upper(F.trim(F.col(raw)))
    pairs = mapping.select(F.col("iso2").alias("__iso2"), F.col("iso3").alias("__iso3"))
    return (
        df.join(pairs, code == F.col("__iso2"), "left")
        .withColumn(out, F.when(code.rlike(ISO3), code).otherwise(F.col("__iso3")))
        .drop("__iso2", "__iso3")
    )


def country_match(
    names: DataFrame,
    name: str,
    registry: DataFrame,
    registry_name: str,
    registry_code: str,
    manual: Mapping[str, str],
    excluded: Sequence[str],
) -> DataFrame:
    """Code and provenance per distinct name: excluded, manual, normalised match, or unmatched."""
    known = (
        registry.groupBy(normalize_country_name(registry_name).alias("__norm"))
        .agg(F.max(registry_code).alias("__code"))
    )
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    label = F.col(name)
    by_hand = map_codes(label, dict(manual))
    is_out = label.isin(*excluded) if excluded else F.lit(False)
    return (
        distinct.withColumn("__norm", normalize_country_name(label))
        .join(known, "__norm", "left")
        .select(
            name,
            F.when(is_out, None).otherwise(F.coalesce(by_hand, F.col("__code"))).alias("iso3c"),
            F.when(is_out, "excluded_non_country")
            .when(by_hand.isNotNull(), "manual")
            .when(F.col("__code").isNotNull(), "exact_normalized")
            .otherwise("unmatched")
            .alias("matched_by"),
        )
    )


def coalesce_cols(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    present = [F.col(c) for c in columns if c in df.columns]
    return df.withColumn(out, F.coalesce(*present) if present else F.lit(None))


def year_or_mode_join(
    df: DataFrame, firm_year: DataFrame, firm_mode: DataFrame, firm: str, year: str, value: str, mode: str, out: str
) -> DataFrame:
    """The value observed in the firm-year, or the firm's most frequent value when there is none."""
    exact = firm_year.select(firm, year, F.col(value).alias("__exact"))
    usual = firm_mode.select(firm, F.col(mode).alias("__mode"))
    joined = df.join(exact, [firm, year], "left").join(usual, firm, "left")
    return joined.withColumn(out, F.coalesce("__exact", "__mode")).drop("__exact", "__mode")


def policy_attach(df: DataFrame, mapping: DataFrame, policy: DataFrame, iso2: str, year: str) -> DataFrame:
    """Country code harmonised, then policy values of that country and year."""
    pairs = mapping.select(F.col("iso2").alias("__iso2"), F.col("iso3").alias("iso3c"))
    coded = df.join(pairs, F.upper(F.col(iso2)) == F.col("__iso2"), "left").drop("__iso2")
    return coded.join(policy.withColumnRenamed("year", year), ["iso3c", year], "left")


def attach_context(panel: DataFrame, contexts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left joins to small context tables, each on its own keys (sector and year, or year alone)."""
    return reduce(lambda left, item: left.join(item[0], list(item[1]), "left"), contexts, panel)


def attach_links_to_panel(
    panel: DataFrame, links: DataFrame, facts: DataFrame | None, firm: str, registry_id: str, year: str
) -> DataFrame:
    """Panel with its links; with facts the link columns appear only on firm-years that have facts."""
    linked = links.where(F.col(registry_id).isNotNull()).distinct()
    if facts is None:
        return panel.join(linked, firm, "left")
    return panel.join(linked.join(facts, registry_id, "left"), [firm, year], "left")


def variant_inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, list(keys)).withColumn("difference", F.col("left_value") - F.col("right_value"))


def threshold_flag(df: DataFrame, value: str, threshold: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col(value) >= F.col(threshold), 1).otherwise(0))
