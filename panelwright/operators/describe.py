"""Descriptive tables: moments, quantiles, decompositions, bins, rankings, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import row_sample_std, safe_ratio
from ..functions.text import as_col
from .ranking import quantile_points, quantiles, running_totals

SUMMARY_POINTS = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def summary_stats(
    df: DataFrame,
    columns: Sequence[str],
    labels: Mapping[str, str] = {},
    points: Mapping[str, float] = SUMMARY_POINTS,
) -> DataFrame:
    """N, mean, sample SD, quantiles, minimum and maximum, one row per column that has values.

    Moments come from one pass over all columns, quantiles from one selection for all columns and points together.
    """
    moments = df.agg(
        *[
            F.struct(
                F.lit(labels.get(c, c)).alias("variable"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("sd"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = moments.select(F.inline(F.array(*columns))).where("n > 0")
    cells = [
        F.struct(F.lit(labels.get(c, c)).alias("variable"), F.col(c).cast("double").alias("__value")) for c in columns
    ]
    long = df.select(F.inline(F.array(*cells)))
    joined = rows.join(quantiles(long, "__value", points, ["variable"]), "variable")
    return joined.select("variable", "n", "mean", "sd", "min", "max", *points)


def variance_split(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Total variance, unweighted variance of entity means, and mean squared deviation within entities."""
    known = df.where(F.col(entity).isNotNull() & F.col(value).isNotNull())
    groups = known.groupBy(entity).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    split = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.var_pop("m").alias("between_var"),
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within_var"),
    )
    overall = known.agg(F.var_pop(value).alias("o")).scalar()
    return split.withColumn("overall_var", overall).withColumn(
        "within_share", safe_ratio("within_var", "overall_var")
    )


def quantile_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Quantile-cut x into right-closed bins (repeated edges merged, lowest value included) and average both."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).alias("y")).dropna()
    # Never more bins than distinct values; counting stops at the number of bins.
    few = known.select("x").distinct().limit(bins).agg(F.greatest(F.count("*"), F.lit(1)).cast("int").alias("few"))
    shares = "transform(sequence(0, few), i -> i / double(few))"
    edges = quantile_points(known, "x", shares, given=few).select(F.array_distinct("points").alias("edges")).scalar()
    below = F.size(F.filter(F.col("edges"), lambda e: e < F.col("x")))
    return (
        known.withColumn("edges", edges)
        .withColumn("bin", F.greatest(below, F.lit(1)))
        .groupBy("bin")
        .agg(F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), F.count("*").alias("n"))
    )


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def intensity_ratios(
    df: DataFrame, count: str, population_millions: str, gdp: str, rd_share_pct: str, law_code: str
) -> DataFrame:
    """Counts per million people, per trillion of GDP and per billion of R&D, and a 0/1 law indicator."""
    rd = F.col(gdp) * F.col(rd_share_pct) / 100.0
    return df.withColumns(
        {
            "per_million": safe_ratio(count, population_millions),
            "per_trillion_gdp": safe_ratio(as_col(count), F.col(gdp) / 1e12),
            "per_billion_rd": safe_ratio(as_col(count), rd / 1e9),
            "privacy_law": F.when(F.col(law_code) == 1, 1.0).otherwise(0.0),
        }
    )


def yearly_share(df: DataFrame, keys: Sequence[str], total: str, part: str) -> DataFrame:
    """Sums per key and the share of the part in the total."""
    sums = df.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(part).alias("data"))
    return sums.withColumn("share", safe_ratio("data", "total"))


def income_group_trends(
    df: DataFrame, year: str, group: str, keep: Sequence[str], total: str, part: str, intensity: str
) -> DataFrame:
    """Share by year and listed group with the median intensity."""
    rows = df.withColumn(group, F.coalesce(group, F.lit("Unknown"))).where(F.col(group).isin(*keep))
    shares = yearly_share(rows, [year, group], total, part)
    return shares.join(quantiles(rows, intensity, {"median_intensity": 0.5}, [year, group]), [year, group], "left")


def overview(df: DataFrame, label: str, unit: str, entity: str, year: str) -> DataFrame:
    return df.agg(
        F.lit(label).alias("dataset"),
        F.lit(unit).alias("unit"),
        F.count("*").alias("observations"),
        F.count_distinct(entity).alias("entities"),
        F.min(year).cast("int").alias("year_start"),
        F.max(year).cast("int").alias("year_end"),
    )


def overview_table(samples: Sequence[tuple[DataFrame, str, str, str, str]], base: DataFrame) -> DataFrame:
    """One overview row per sample with its size relative to the base sample."""
    rows = union_all([overview(*s) for s in samples])
    return rows.withColumn("coverage", safe_ratio(F.col("observations"), base.agg(F.count("*").alias("n")).scalar()))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"missing_{c}") for c in columns])


def claims_by_flag(df: DataFrame, flag: str, value: str, prob: float, on: str, off: str) -> DataFrame:
    """Count, mean, median and share above a global quantile, by flag."""
    known = df.where(F.col(value).isNotNull()).select(
        F.when(F.col(flag) == 1, on).otherwise(off).alias("group_name"), F.col(value).alias("__v")
    )
    cut = quantiles(known, "__v", {"cut": prob}).scalar()
    base = (
        known.withColumn("__cut", cut)
        .groupBy("group_name")
        .agg(
            F.count("*").alias("n"),
            F.avg("__v").alias("mean_value"),
            F.avg(F.when(F.col("__v") >= F.col("__cut"), 1).otherwise(0)).alias("top_share"),
        )
    )
    return base.join(quantiles(known, "__v", {"median_value": 0.5}, ["group_name"]), "group_name")


def id_hash(column: str | Column) -> Column:
    """Repeatable 32-bit hash of an identifier: the first eight hex digits of its MD5."""
    digest = F.md5(as_col(column).cast("string"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """A repeatable uniform sample: the n rows with the smallest key hash.

    A histogram of 4096 hash ranges first finds where the cut lies, so the final sort sees about n rows.
    """
    hashed = df.withColumn("__h", id_hash(key)).withColumn("__b", F.shiftright("__h", 20).cast("int"))
    w = W.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    filled = hashed.groupBy("__b").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w))
    cut = filled.agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("__b"))), F.max("__b")).alias("cut"))
    near = hashed.withColumn("__cut", cut.scalar()).where("__b <= __cut")
    return near.orderBy("__h", key).limit(n).select(*df.columns)


def grid_mean(df: DataFrame, x: str, y: str, value: str, x_width: float, y_width: float, at_least: int) -> DataFrame:
    """Mean of a value over square cells that hold enough rows."""
    cell = {"x_cell": F.floor(F.col(x) / x_width), "y_cell": F.floor(F.col(y) / y_width)}
    return (
        df.dropna(subset=[x, y, value])
        .groupBy(*[c.alias(n) for n, c in cell.items()])
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
        .where(F.col("n") >= at_least)
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts over equal-width bins between minimum and maximum, the last bin closed."""
    known = df.select(F.col(value).cast("double").alias("v")).dropna()
    low = known.agg(F.min("v").alias("x")).scalar()
    high = known.agg(F.max("v").alias("x")).scalar()
    ranged = known.withColumns({"low": low, "high": high})
    share = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low"))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins) + 1, F.lit(bins)).cast("int")
    return ranged.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, value: str, out: str) -> DataFrame:
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(out, safe_ratio(F.col(value), total))


def within_group_density(df: DataFrame, group: Column, bin_value: Column, group_name: str = "grp") -> DataFrame:
    """Rows per group and bin, and their share of the group. The share is taken on the binned table."""
    counts = df.where(bin_value.isNotNull()).groupBy(group.alias(group_name), bin_value.alias("bin")).agg(
        F.count("*").alias("n")
    )
    totals = counts.groupBy(group_name).agg(F.sum("n").alias("__t"))
    return counts.join(totals, group_name).select(group_name, "bin", "n", safe_ratio("n", "__t").alias("density"))


def pivot_density(density: DataFrame, groups: Mapping[str, str], group_name: str = "grp") -> DataFrame:
    """One column per group, absent cells zero."""
    return density.groupBy("bin").agg(
        *[
            F.coalesce(F.max(F.when(F.col(group_name) == g, F.col("density"))), F.lit(0.0)).alias(name)
            for g, name in groups.items()
        ]
    )


def concentration_curve(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities by falling total with their cumulative share of entities and of the total."""
    totals = df.groupBy(entity).agg(F.sum(value).alias("total"))
    curve = running_totals(totals, [F.desc("total"), F.col(entity)], {"running": "total"}, "rank", "n")
    whole = totals.agg(F.sum("total").alias("t")).scalar()
    return curve.select(
        entity,
        "total",
        (F.col("rank") / F.col("n")).alias("entity_share"),
        safe_ratio(F.col("running"), whole).alias("cumulative_share"),
    )


def top_entities(df: DataFrame, entity: str, total: str, k: int) -> DataFrame:
    """The k entities with the largest sum."""
    sums = df.groupBy(entity).agg(F.sum(total).alias("__total"))
    return sums.orderBy(F.desc("__total"), entity).limit(k).select(entity)


def top_firms(panel: DataFrame, names: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """Panel rows of the n firms with the largest count."""
    top = names.orderBy(F.desc(count), key).limit(n).select(key)
    return panel.join(top, key, "left_semi")


def top_groups(
    df: DataFrame, entity: str, part: str, total: str, share: str, year: str, k: int, floor: float
) -> tuple[DataFrame, DataFrame]:
    """The k entities with the largest totals, and those with the highest mean share above a size floor."""
    groups = df.groupBy(entity).agg(
        F.sum(part).alias("total_part"),
        F.sum(total).alias("total_all"),
        F.avg(share).alias("avg_share"),
        F.count_distinct(year).alias("years_observed"),
    )
    groups = share_of_total(groups, "total_part", "global_share")
    largest = groups.orderBy(F.desc("total_part"), entity).limit(k)
    dense = groups.where(F.col("total_all") >= floor).orderBy(F.desc("avg_share"), entity).limit(k)
    return largest, dense


def top_k_series(df: DataFrame, entity: str, year: str, value: str, k: int) -> DataFrame:
    """Yearly sums of the k entities with the largest total."""
    yearly = df.groupBy(entity, year).agg(F.sum(value).alias("total"))
    return yearly.join(top_entities(yearly, entity, "total", k), entity, "left_semi")


def score_extremes(df: DataFrame, score: str, key: str, threshold: float, k: int) -> DataFrame:
    """The k highest, k lowest and k closest to the threshold, labelled by list."""
    distance = F.abs(F.col(score) - threshold)
    lists = {
        "top": [F.desc(score), F.col(key)],
        "bottom": [F.asc(score), F.col(key)],
        "ambiguous": [distance.asc(), F.col(key)],
    }
    known = df.where(F.col(score).isNotNull()).withColumn("dist_to_threshold", distance)
    return union_all(
        [known.orderBy(*o).limit(k).withColumn("bucket", F.lit(name)) for name, o in lists.items()]
    )


def validation_examples(df: DataFrame, score: str, key: str, threshold: float, n: int = 8) -> DataFrame:
    labels = {"top": "Top score", "bottom": "Bottom score", "ambiguous": "Most ambiguous"}
    picked = score_extremes(df, score, key, threshold, n)
    name = reduce(lambda acc, i: F.when(F.col("bucket") == i[0], i[1]).otherwise(acc), labels.items(), F.lit(None))
    return picked.withColumn("bucket", name)


def review_sample(
    df: DataFrame, key: str, score: str, methods: Sequence[str], threshold: float, per_list: int = 300, cap: int = 1200
) -> DataFrame:
    """Rows worth a manual look: extremes, near-threshold rows and rows on which methods disagree."""
    rated = df.withColumns(
        {"method_disagreement": row_sample_std(methods), "__mid": F.abs(F.col(score) - threshold)}
    )
    orders = [
        [F.desc(score), F.col(key)],
        [F.asc(score), F.col(key)],
        [F.asc("__mid"), F.col(key)],
        [F.desc("method_disagreement"), F.col(key)],
    ]
    lists = [rated.orderBy(*o).limit(per_list).withColumn("__list", F.lit(i)) for i, o in enumerate(orders)]
    kept = union_all(lists).groupBy(key).agg(
        F.min_by(F.struct(*[c for c in rated.columns if c != key]), "__list").alias("r"),
        F.min("__list").alias("first_list"),
    )
    columns = [c for c in rated.columns if c not in (key, "__mid")]
    return (
        kept.orderBy("first_list", key)
        .limit(cap)
        .select(key, *[F.col(f"r.{c}").alias(c) for c in columns], "first_list")
    )


def union_variants(frames: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """Variants of one panel stacked with their assignment and year labels."""
    return union_all(
        [f.withColumns({"assignment_basis": F.lit(a), "year_basis": F.lit(y)}) for (a, y), f in frames.items()]
    )


def prefix_measures(df: DataFrame, keys: Sequence[str], prefix: str = "pe_") -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def union_all_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, SD and three quantiles per variable, stacked."""
    points = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    return summary_stats(df, columns, points=points).select("variable", "mean", "sd", *points)


def stack_levels(frames: Mapping[str, DataFrame], label: str = "level") -> DataFrame:
    return union_all([f.withColumn(label, F.lit(name)) for name, f in frames.items()])


def level_summary(df: DataFrame, year: str, total: str, part: str, share: str) -> DataFrame:
    """Per year: mean share over industries and the share of sums."""
    sums = df.groupBy(year).agg(
        F.avg(share).alias("share"), F.sum(part).alias("__p"), F.sum(total).alias("total")
    )
    return sums.select(year, "share", safe_ratio("__p", "total").alias("weighted_share"), "total")
