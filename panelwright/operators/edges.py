"""Citation-style edge metrics over year windows.

A few items collect a large part of all edges. Edges are therefore reduced to (cited, citing year, ...)
counts before they meet the cited side: that aggregate combines on the map side and leaves at most one row
per item and year, however many edges an item has.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_ratio
from ..session import pinned


def distinct_edges(edges: DataFrame, cited: str, citing: str) -> DataFrame:
    return edges.select(cited, citing).where(F.col(cited).isNotNull() & F.col(citing).isNotNull()).distinct()


def distinct_citing(edges: DataFrame, citing: str) -> DataFrame:
    return edges.select(citing).where(F.col(citing).isNotNull()).distinct()


def in_window(citing_year: str | Column, year: str | Column, span: int) -> Column:
    a = F.col(citing_year) if isinstance(citing_year, str) else citing_year
    b = F.col(year) if isinstance(year, str) else year
    return a.between(b, b + span)


def window_citation_join(
    edges: DataFrame, universe: DataFrame, years: DataFrame, cited: str, citing: str, year: str, span: int
) -> DataFrame:
    """Edges whose citing year falls in [year, year + span] of the cited item."""
    citing_years = years.select(F.col(citing), F.col(year).alias("citing_year"))
    cited_years = universe.select(F.col(cited), F.col(year).alias("cited_year"))
    joined = edges.join(citing_years, citing).join(cited_years, cited)
    return joined.where(in_window("citing_year", "cited_year", span))


def forward_citations(
    edges: DataFrame,
    universe: DataFrame,
    years: DataFrame,
    cited: str,
    citing: str,
    category: str,
    year: str,
    spans: Mapping[str, int],
    categories: Mapping[str, tuple[str, int]],
) -> DataFrame:
    """Citations per item: all, within each span, and within a span by category; zeros are kept."""
    citing_years = years.select(F.col(citing), F.col(year).alias("__cy"))
    reduced = (
        edges.where(F.col(cited).isNotNull() & F.col(citing).isNotNull())
        .join(citing_years, citing, "left")
        .groupBy(cited, "__cy", category)
        .agg(F.count("*").alias("__n"))
    )
    joined = universe.select(cited, year).join(reduced, cited, "left")
    n = F.coalesce("__n", F.lit(0))

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return joined.groupBy(cited).agg(
        F.sum(n).alias("forward_citation_count_all"),
        *[counted(in_window("__cy", year, s)).alias(name) for name, s in spans.items()],
        *[
            counted((F.col(category) == label) & in_window("__cy", year, s)).alias(name)
            for name, (label, s) in categories.items()
        ],
    )


def backward_citations(edges: DataFrame, universe: DataFrame, citing: str, cited: str) -> DataFrame:
    """Edge rows with both ends known per citing item of the universe, repeats included."""
    counts = edges.where(F.col(citing).isNotNull() & F.col(cited).isNotNull()).groupBy(citing).agg(
        F.count("*").alias("backward_patent_citation_count")
    )
    return counts.join(universe.select(citing), citing, "left_semi")


def citation_breadth(
    pairs: DataFrame,
    universe: DataFrame,
    years: DataFrame,
    classes: DataFrame,
    cited: str,
    citing: str,
    subclass: str,
    year: str,
    span: int = 10,
) -> DataFrame:
    """Distinct subclasses and four-character classes among items citing within the span.

    (cited, citing year, subclass) is made distinct before the cited side is joined.
    """
    citing_years = years.select(F.col(citing), F.col(year).alias("__cy"))
    class_rows = classes.where(F.length(subclass) >= 4).select(citing, subclass).distinct()
    reached = (
        pairs.join(citing_years, citing)
        .join(class_rows, citing)
        .select(cited, "__cy", subclass)
        .distinct()
    )
    joined = universe.select(cited, year).join(reached, cited, "left")
    seen = F.when(in_window("__cy", year, span), F.col(subclass))
    return joined.groupBy(cited).agg(
        F.countDistinct(F.substring(seen, 1, 4)).alias(f"citing_cpc4_count_{span}y"),
        F.countDistinct(seen).alias(f"citing_cpc_subclass_count_{span}y"),
    )


def small_firm_citations(
    pairs: DataFrame,
    universe: DataFrame,
    years: DataFrame,
    sizes: DataFrame,
    cited: str,
    citing: str,
    year: str,
    size: str,
    small: float = 500,
    span: int = 10,
) -> DataFrame:
    """Citing items within the span: all, with a known size, and small; with share and coverage.

    Pairs are distinct, so plain counts replace distinct counts and can be summed per year first.
    """
    citing_years = years.select(F.col(citing), F.col(year).alias("__cy"))
    reduced = (
        pairs.join(citing_years, citing)
        .join(sizes.select(citing, size), citing, "left")
        .groupBy(cited, "__cy")
        .agg(
            F.count("*").alias("__all"),
            F.count(size).alias("__sized"),
            F.count_if(F.col(size) < small).alias("__small"),
        )
    )
    joined = universe.select(cited, year).join(reduced, cited, "left")
    inside = in_window("__cy", year, span)
    names = {
        f"citing_patents_{span}y": "__all",
        f"citing_patents_with_size_{span}y": "__sized",
        f"citing_small_firm_patents_{span}y": "__small",
    }
    out = joined.groupBy(cited).agg(
        *[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(n) for n, c in names.items()]
    )
    every, sized, few = names
    return out.withColumns(
        {
            f"small_firm_citation_share_{span}y_linked": safe_ratio(few, sized),
            f"small_firm_citation_size_coverage_{span}y": safe_ratio(sized, every),
        }
    )


def citation_profile(
    edges: DataFrame,
    universe: DataFrame,
    years: DataFrame,
    classes: DataFrame,
    sizes: DataFrame,
    cited: str,
    citing: str,
    category: str,
    subclass: str,
    size: str,
    year: str,
    spans: Mapping[str, int],
    categories: Mapping[str, tuple[str, int]],
    small: float = 500,
    span: int = 10,
) -> DataFrame:
    """``forward_citations``, ``citation_breadth`` and ``small_firm_citations`` of each item, from one exchange of the edges.

    The edges meet what is known of the citing items once. That leaves them partitioned by citing item, where repeated
    edges collapse to pairs and the classes are looked up without moving them again. One aggregate by (cited, citing year,
    class) then holds all counts, under a null class, and the classes seen; it combines before its shuffle and leaves one
    row per item, year and class, however many edges an item has. ``years`` and ``sizes`` have one row per citing item.
    """
    about = years.select(F.col(citing), F.col(year).alias("__cy")).join(
        sizes.select(citing, F.col(size).alias("__size")), citing, "full"
    )
    labels = {name: f"__l{i}" for i, name in enumerate(dict.fromkeys(label for label, _ in categories.values()))}
    known = edges.where(F.col(cited).isNotNull() & F.col(citing).isNotNull())
    pairs = known.join(about, citing, "left").groupBy(citing, cited, "__cy", "__size").agg(
        F.count("*").alias("__rows"), *[F.count_if(F.col(category) == label).alias(n) for label, n in labels.items()]
    )
    held = classes.where(F.length(subclass) >= 4).groupBy(citing).agg(F.collect_set(subclass).alias("__classes"))
    none = F.array(F.lit(None).cast("string"))
    reduced = (
        pairs.join(held, citing, "left")
        .withColumn("__class", F.explode(F.concat(none, F.coalesce("__classes", F.slice(none, 1, 0)))))
        .groupBy(cited, "__cy", "__class")
        .agg(
            F.count("*").alias("__pairs"),
            F.count("__size").alias("__sized"),
            F.count_if(F.col("__size") < small).alias("__small"),
            *[F.sum(c).alias(c) for c in ("__rows", *labels.values())],
        )
    )
    joined = universe.select(cited, year).join(reduced, cited, "left")
    plain, inside = F.col("__class").isNull(), in_window("__cy", year, span)

    def counted(column: str, condition: Column) -> Column:
        return F.sum(F.when(plain & condition, F.coalesce(column, F.lit(0))).otherwise(0))

    seen = F.when(inside, F.col("__class"))
    every, sized, few = f"citing_patents_{span}y", f"citing_patents_with_size_{span}y", f"citing_small_firm_patents_{span}y"
    out = joined.groupBy(cited).agg(
        counted("__rows", F.lit(True)).alias("forward_citation_count_all"),
        *[counted("__rows", in_window("__cy", year, s)).alias(name) for name, s in spans.items()],
        *[counted(labels[label], in_window("__cy", year, s)).alias(name) for name, (label, s) in categories.items()],
        F.countDistinct(F.substring(seen, 1, 4)).alias(f"citing_cpc4_count_{span}y"),
        F.countDistinct(seen).alias(f"citing_cpc_subclass_count_{span}y"),
        counted("__pairs", inside).alias(every),
        counted("__sized", inside).alias(sized),
        counted("__small", inside).alias(few),
    )
    return out.withColumns(
        {
            f"small_firm_citation_share_{span}y_linked": safe_ratio(few, sized),
            f"small_firm_citation_size_coverage_{span}y": safe_ratio(sized, every),
        }
    )


def class_intro_year(classes: DataFrame, years: DataFrame, item: str, label: str, year: str, out: str) -> DataFrame:
    """First year in which each class is seen."""
    known = classes.where(F.col(label).isNotNull()).join(years.select(item, year), item)
    return known.groupBy(label).agg(F.min(year).alias(out))


def class_ahead(
    classes: DataFrame, universe: DataFrame, intro: DataFrame, item: str, label: str, year: str, intro_year: str
) -> DataFrame:
    """How many years an item precedes the introduction of any class it now holds."""
    held = classes.where(F.col(label).isNotNull()).join(intro, label).groupBy(item).agg(
        F.max(intro_year).alias("__latest")
    )
    joined = universe.select(item, year).join(held, item, "left")
    gap = F.col("__latest") - F.col(year)
    return joined.select(
        item,
        # greatest() skips nulls, so an item without classes or year gets 0, as in the SQL form.
        F.greatest(gap, F.lit(0)).alias("years_ahead_of_cpc_intro"),
        F.when(gap > 0, 1).otherwise(0).alias("opens_new_cpc_field_flag"),
    )


def first_generation_flag(classes: DataFrame, universe: DataFrame, item: str, label: str, year: str) -> DataFrame:
    """Earliest first year among an item's classes, and whether one of them began in the item's year."""
    intro = class_intro_year(classes, universe, item, label, year, "__intro")
    held = classes.where(F.col(label).isNotNull()).select(item, label).distinct().join(intro, label)
    joined = universe.select(item, year).join(held, item, "left")
    return joined.groupBy(item).agg(
        F.min("__intro").alias("patent_uspc_first_app_year_min"),
        F.max(F.when(F.col(year) == F.col("__intro"), 1).otherwise(0)).alias("is_first_gen_uspc_class"),
    )


def owner_productivity(prior: DataFrame, item: str, count: str, prefix: str) -> DataFrame:
    """Owners per item with mean and maximum of their earlier counts; written once, in partitions by the size of ``prior``."""
    return pinned(
        prior.groupBy(item).agg(
            F.count("*").alias(f"{prefix}_count"),
            F.avg(count).alias(f"{prefix}_productivity_mean_prior_count"),
            F.max(count).alias(f"{prefix}_productivity_max_prior_count"),
        )
    )
