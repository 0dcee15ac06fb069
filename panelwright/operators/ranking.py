"""Exact ranks, running totals, tiles and quantiles that never gather a group in one task.

A window without partitions, or one over a hot key, sorts all its rows in a single task. Here the rows
are range-partitioned on the full order instead, so a hot key or a run of ties on the leading column is
spread over as many tasks as it needs; only one small row per partition is combined afterwards.
Quantiles need no order of the rows at all: they are selected by counting leading bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_col
from ..session import partitions_for as _partitions
from ..session import pinned

_PART, _POS, _RUN = "__part", "__pos", "__run"
#: Leading bits of a double's ordered key that each pass of a selection counts; 64 in all.
RADIX_BITS = (22, 21, 21)


def _ordered_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows sorted across partitions, with partition number and position fixed by writing them.

    Range bounds come from a sample, so the layout must be pinned before two branches read it.
    """
    tagged = (
        df.repartitionByRange(_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    return pinned(tagged).select(
        *df.columns,
        F.shiftright("__mid", 33).cast("int").alias(_PART),
        F.col("__mid").bitwiseAND((1 << 33) - 1).alias(_POS),
    )


def _with_offsets(rows: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    """Attach what the earlier partitions hold: one row per partition, so the broadcast is bounded."""
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    per_part = rows.groupBy(_PART).agg(
        F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{name}") for name, c in sums.items()]
    )
    offsets = per_part.select(
        _PART,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(W.partitionBy()).alias("__total"),
        *[F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__b_{name}") for name in sums],
    )
    return rows.join(F.broadcast(offsets), _PART)


def global_rank(
    df: DataFrame, order: Sequence[str | Column], rank: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based position of every row in a total order, and the row count if ``total`` is named."""
    rows = _with_offsets(_ordered_rows(df, [as_col(c) for c in order]), {})
    extra = [F.col("__total").alias(total)] if total else []
    return rows.select(*df.columns, (F.col("__before") + F.col(_POS) + 1).alias(rank), *extra)


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal as grouping keys: null like null, NaN like NaN."""
    equal = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(a.type):
        equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b)))


def _run_lengths(by: Sequence[str]):
    """Number each row within its unbroken run of equal keys in the partition, and within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_rows, done = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
            same = np.ones(n, bool)
            for k in keys:
                same[1:] &= _same(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same[0] = last is not None and all(_same(k.slice(0, 1), x)[0].as_py() for k, x in zip(keys, last, strict=True))
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(same, -1, at))
            rank = np.where(start < 0, at + open_rows, at - start) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(done + at), pa.array(rank)], [*batch.schema.names, _POS, _RUN]
            )
            last, open_rows, done = [k.slice(n - 1, 1) for k in keys], int(rank[-1]), done + n

    return run


def grouped_rank(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], rank: str = "rank") -> DataFrame:
    """1-based position within each group; a group may span any number of tasks.

    A segmented prefix scan: rows are sorted across partitions once, and each partition numbers the rows of its runs. The
    group that is open at a border, and its rows so far, are carried over in a table of one row per partition. Null keys
    form one group.
    """
    keys = [F.col(c) for c in by]
    fields = [*df.schema.fields, T.StructField(_POS, T.LongType()), T.StructField(_RUN, T.LongType())]
    ordered = df.repartitionByRange(_partitions(df), *keys, *[as_col(c) for c in order])
    ordered = ordered.sortWithinPartitions(*keys, *[as_col(c) for c in order])
    numbered = ordered.mapInArrow(_run_lengths(by), T.StructType(fields)).withColumn(_PART, F.spark_partition_id())
    rows = pinned(numbered)
    group = F.struct(*keys)
    borders = rows.groupBy(_PART).agg(
        F.min_by(group, _POS).alias("__first"), F.max_by(group, _POS).alias("__last"), F.max_by(_RUN, _POS).alias("__open")
    )
    earlier = borders.select(F.col(_PART).alias("__p"), F.col("__last").alias("__l"), F.col("__open").alias("__o"))
    # A group that was open before this partition's first row has been open at the end of all partitions it is in.
    goes_on = F.col("__first").eqNullSafe(F.col("__l")) & (F.col("__p") < F.col(_PART))
    carried = borders.join(earlier, goes_on).groupBy(_PART).agg(F.sum("__o").alias("__carried"))
    joined = rows.join(F.broadcast(carried), _PART, "left")
    in_first_run = F.col(_RUN) == F.col(_POS) + 1
    add = F.when(in_first_run, F.coalesce("__carried", F.lit(0))).otherwise(0)
    return joined.select(*df.columns, (F.col(_RUN) + add).alias(rank))


def running_totals(
    df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str], rank: str = "rank", total: str = "total_rows"
) -> DataFrame:
    """Rank, row count, and the inclusive running sum of each named column in a total order."""
    rows = _with_offsets(_ordered_rows(df, [as_col(c) for c in order]), sums)
    within = W.partitionBy(_PART).orderBy(_POS).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        *df.columns,
        (F.col("__before") + F.col(_POS) + 1).alias(rank),
        F.col("__total").alias(total),
        *[(F.col(f"__b_{name}") + F.sum(c).over(within)).alias(name) for name, c in sums.items()],
    )


def ntile(df: DataFrame, tiles: int, order: Sequence[str | Column], name: str = "tile") -> DataFrame:
    """SQL NTILE over all rows: the first ``n mod tiles`` tiles hold one row more."""
    ranked = global_rank(df, order, "__rank", "__rows")
    size, longer = F.expr(f"__rows div {tiles}"), F.col("__rows") % tiles
    zero = F.col("__rank") - 1
    in_longer = F.floor(zero / (size + 1)) + 1
    in_shorter = longer + F.floor(F.try_divide(zero - longer * (size + 1), size)) + 1
    tile = F.when(zero < longer * (size + 1), in_longer).otherwise(in_shorter)
    return ranked.select(*df.columns, tile.cast("int").alias(name))


def _ordered_key(value: Column) -> Column:
    """A long for each double, in the same order; NaN last, both zeros alike."""
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _key_value(key: Column) -> Column:
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def quantile_points(df: DataFrame, value: str, shares: str, by: Sequence[str] = (), given: DataFrame | None = None) -> DataFrame:
    """The columns ``by`` and ``points``, an array of exact linear-interpolated quantiles; nulls skipped.

    ``shares`` is the SQL of an array of shares, over the columns of ``given`` if there is such a table of one row; a null
    share gives a null point. Selection by radix histograms: each pass counts the values by their next leading bits, for all
    groups and points together, and the following pass looks only into the bins that hold a wanted position. There are as
    many passes for any data; no row is sorted or written, and what is shuffled and kept are counts. Rows with a null in
    ``by`` are left out. Without ``by`` there is one row, of null where there are no values.
    """
    known = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    rows = known.select(*by, _ordered_key(F.col("__v")).alias("__k"))
    found, shift, prefix = None, 64, []
    for depth, bits in enumerate(RADIX_BITS):
        shift -= bits
        level = f"__r{depth}"
        rows = rows.withColumn(level, F.shiftright("__k", shift))
        inside = rows if found is None else rows.join(found.select(*by, *prefix), [*by, *prefix])
        bins = inside.groupBy(*by, *prefix, level).agg(F.count("*").alias("__c"))
        within = W.partitionBy(*by, *prefix)
        bins = bins.withColumn("__upto", F.sum("__c").over(within.orderBy(level).rowsBetween(W.unboundedPreceding, 0)))
        if found is None:
            # One-based positions of both neighbours of each point, and the weight of the upper one.
            at = f"transform({shares}, p -> p * (__n - 1) + 1)"
            bins = bins.withColumn("__n", F.sum("__c").over(within))
            if given is not None:
                bins = bins.withColumn("__one", F.lit(1)).join(F.broadcast(given.withColumn("__one", F.lit(1))), "__one")
            both = "array(struct(2 * i as i, floor(x) as at, x - floor(x) as w), struct(2 * i + 1 as i, ceil(x) as at, x - floor(x) as w))"
            bins = bins.withColumn("__wanted", F.expr(f"flatten(transform({at}, (x, i) -> {both}))"))
        else:
            # Positions count from the start of the bin that the pass before has found.
            bins = bins.join(found, [*by, *prefix])
        bins = bins.withColumn("__before", F.col("__upto") - F.col("__c"))
        here = "filter(__wanted, x -> x.at > __before AND x.at <= __upto)"
        prefix = [*prefix, level]
        shifted = F.expr(f"transform({here}, x -> struct(x.i as i, x.at - __before as at, x.w as w))").alias("__wanted")
        hit = bins.where(F.expr("exists(__wanted, x -> x.at > __before AND x.at <= __upto)"))
        found = hit.select(*by, *prefix, shifted)
        # A pass is a small table, written once: the next one reads it twice.
        found = pinned(found) if shift else found
    ends = found.select(*by, _key_value(F.col(prefix[-1])).alias("__v"), F.explode("__wanted").alias("x"))
    cells = ends.groupBy(*by).agg(F.collect_list(F.struct("x.i", F.struct(F.col("__v").alias("v"), "x.w"))).alias("__cells"))
    between = "(at[2 * i].v + (at[2 * i + 1].v - at[2 * i].v) * at[2 * i].w)"
    size = "array_max(transform(__cells, c -> c.i)) div 2"
    points = f"transform(sequence(0, {size}), i -> {between.replace('at[', 'map_from_entries(__cells)[')})"
    return cells.select(*by, F.when(F.size("__cells") > 0, F.expr(points)).alias("points"))


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``quantile_points`` with one column per entry of ``probs``."""
    shares = ", ".join(f"{float(p)!r}D" for p in probs.values())
    points = quantile_points(df, value, f"array({shares})", by)
    return points.select(*by, *[F.col("points")[i].alias(name) for i, name in enumerate(probs)])


def with_quantile(df: DataFrame, value: str, prob: float, name: str) -> DataFrame:
    """Attach one global quantile to every row as a scalar subquery (no join is planned)."""
    return df.withColumn(name, quantiles(df, value, {name: prob}).scalar())


def keep_best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in ``order``. The limit is applied before the shuffle too."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_by_sequence(df: DataFrame, key: str, sequence: str, value: str, name: str) -> DataFrame:
    """Value with the lowest sequence per key, missing sequences last; blank values are ignored."""
    filled = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    order = F.struct(F.col(sequence).isNull(), F.col(sequence), F.col(value))
    return filled.groupBy(key).agg(F.min_by(value, order).alias(name))


def mode_by_key(df: DataFrame, key: str | Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def primary_name(df: DataFrame, key: str, label: str, item: str, name: str, count: str) -> DataFrame:
    """Label attached to most distinct items per key, the smallest on ties."""
    counts = (
        df.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key, label)
        .agg(F.countDistinct(item).alias(count))
    )
    best = F.min_by(F.struct(label, count), F.struct(-F.col(count), F.col(label))).alias("__best")
    return counts.groupBy(key).agg(best).select(
        key, F.col(f"__best.{label}").alias(name), F.col(f"__best.{count}").alias(count)
    )


def best_owner(df: DataFrame, item: str, owner: str, year: str, newest_first: bool = True) -> DataFrame:
    """One owner per item: a known owner first, then by year, unknown years last, then owner."""
    y = F.col(year)
    order = F.struct(
        F.col(owner).isNull(), y.isNull(), -y if newest_first else y, F.col(owner)
    )
    best = F.min_by(F.struct(F.col(owner), y), order).alias("__best")
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(best).select(
        item, F.col(f"__best.{owner}"), F.col(f"__best.{year}")
    )


def prior_count(links: DataFrame, owner: str, item: str, year: str, name: str) -> DataFrame:
    """Number of earlier items of the same owner, ordered by year then item, over distinct links."""
    known = links.where(F.col(owner).isNotNull() & F.col(year).isNotNull())
    triples = known.select(owner, item, year).distinct()
    ranked = grouped_rank(triples, [owner], [year, item], "__rank")
    return ranked.select(owner, item, year, (F.col("__rank") - 1).alias(name))


def lead_change(df: DataFrame, key: str, order: str, columns: Sequence[str], steps: int = 5) -> DataFrame:
    """Value ``steps`` rows later minus the present one, per key.

    The panel has one row per key and period, so a window partition is as short as the calendar.
    """
    w = W.partitionBy(key).orderBy(order)
    return df.withColumns({f"d{steps}_{c}": F.lead(c, steps).over(w) - F.col(c) for c in columns})


def lead_change_exact(df: DataFrame, key: str, order: str, columns: Sequence[str], steps: int = 5) -> DataFrame:
    """Like ``lead_change`` but by calendar distance: null unless that very period exists."""
    later = df.select(key, (F.col(order) - steps).alias(order), *[F.col(c).alias(f"__later_{c}") for c in columns])
    joined = df.join(later, [key, order], "left")
    changed = joined.withColumns({f"d{steps}_{c}": F.col(f"__later_{c}") - F.col(c) for c in columns})
    return changed.drop(*[f"__later_{c}" for c in columns])


def cumulative_policy(df: DataFrame, key: str, year: str, count: str) -> DataFrame:
    """Per key and year: sum, running sum, any flag, first year, and on-or-after flag.

    After the sum there is one row per key and year, which bounds every window partition.
    """
    per_year = (
        df.where(F.col(key).isNotNull() & F.col(year).isNotNull() & F.col(count).isNotNull())
        .groupBy(key, year)
        .agg(F.sum(count).alias("n_measures"))
    )
    w = W.partitionBy(key)
    running = w.orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    out = per_year.withColumns(
        {
            "n_measures_cum": F.sum("n_measures").over(running),
            "any_measure": (F.col("n_measures") > 0).cast("int"),
            "first_year": F.min(year).over(w),
        }
    )
    return out.withColumn("post_any", (F.col(year) >= F.col("first_year")).cast("int"))


def top_k_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows per key with their rank; each map task forwards at most ``k`` per key."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
