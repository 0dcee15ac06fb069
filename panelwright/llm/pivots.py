"""Exact top-k search by inner product with a pivot-distance index.

One more component makes all indexed vectors equally long, so that the largest inner product is the smallest distance. The
key of an indexed vector is its nearest pivot and its distance from it; a cell's distance rings are the blocks of the
index. By the triangle inequality no vector of a ring is closer to a query than the ring's distances are to the query's own.
Each query first visits rings near to it, which gives a score that the rest must reach; it then visits every ring whose
bound reaches that score, and no other. Inside a ring its sorted annuli are visited outwards until no bound is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, packed, unpacked, whole_vectors
from .words import once, stored

RESULT = "query_id long, rank int, vec_id long, score long"
#: Products up to here are exact in doubles.
_DOUBLE = 1 << 53


@dataclass
class PivotIndex:
    """Pivots, ring borders and, once counted, the rings' extents. Its size depends on the number of pivots and rings only."""

    longest: int
    pivots: np.ndarray
    kind: str
    #: Inner borders of each cell's rings, by distance.
    borders: list[np.ndarray]
    #: By ring, rings numbered by cell and distance: cell, rows, extent and in how many slots its rows are dealt.
    cell: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - 1

    @property
    def first_ring(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(b) + 1 for b in self.borders])])

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """From every pivot. A query's further component is zero."""
        squares = (x * x).sum(axis=1)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest - squares))
        sizes = squares if query else np.full(len(x), float(self.longest))
        products = x @ self.pivots[:, :-1].T + np.outer(rest, self.pivots[:, -1])
        return np.sqrt(np.maximum(0.0, sizes[:, None] + (self.pivots**2).sum(axis=1) - 2 * products))

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ring and distance of indexed vectors."""
        far = self.distances(x, False)
        cell = far.argmin(axis=1)
        distance, ring, starts = far[np.arange(len(x)), cell], np.zeros(len(x), np.int64), self.first_ring
        for c in np.unique(cell):
            own = cell == c
            ring[own] = starts[c] + np.searchsorted(self.borders[c], distance[own], side="right")
        return ring, distance

    def best_scores(self, squares: np.ndarray, closest: np.ndarray) -> np.ndarray:
        """Scores that a vector no closer than ``closest`` cannot pass; the slack covers all rounding."""
        sizes = squares + self.longest
        return (sizes - closest**2) / 2 + 1e-6 * sizes + 1

    def ring_bounds(self, q: np.ndarray) -> np.ndarray:
        """Of each query and ring: from the ring's extent and, between cells, from the pivots' dividing planes."""
        far = self.distances(q, True)
        own = far[:, self.cell]
        outside = np.maximum(self.low - own, own - self.high)
        across = (own - far.min(axis=1, keepdims=True)) / 2
        return self.best_scores((q * q).sum(axis=1)[:, None], np.maximum(0.0, np.maximum(outside, across)))


def fit_pivots(sample: np.ndarray, longest: int, widest: int, cells: int, rings_per_row: float, rounds: int = 4) -> PivotIndex:
    """Pivots are centres of the sample, which only shapes the index: any pivots give exact results.

    ``rings_per_row`` rings are cut for each row of the sample in a cell, at even shares of its distances.
    """
    rest = np.sqrt(np.maximum(0.0, longest - (sample * sample).sum(axis=1)))
    points, random = np.column_stack([sample, rest]), np.random.default_rng(5)
    chosen = [int(random.integers(len(points)))]
    nearest = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < cells and nearest.sum() > 0:
        chosen.append(int(random.choice(len(points), p=nearest / nearest.sum())))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    pivots = points[chosen]
    for _ in range(rounds):
        cell = ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
        for c in np.unique(cell):
            pivots[c] = points[cell == c].mean(axis=0)
    kind = next((k for k in ("int16", "int32") if widest <= np.iinfo(k).max), "int64")
    index = PivotIndex(longest, pivots, kind, [np.zeros(0)] * len(pivots))
    far = index.distances(sample, False)
    cell, distance = far.argmin(axis=1), far.min(axis=1)
    for c in range(len(pivots)):
        own = distance[cell == c]
        if (rings := min(64, int(np.ceil(len(own) * rings_per_row)))) > 1:
            index.borders[c] = np.unique(np.quantile(own, np.arange(1, rings) / rings))
    return index


def search_ring(
    index: PivotIndex,
    ids: np.ndarray,
    vectors: np.ndarray,
    distance: np.ndarray,
    asked: np.ndarray,
    least: np.ndarray,
    own_distance: np.ndarray,
    most: int,
    annulus: int = 1024,
    together: int = 512,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query its place, the ids and the scores of its ``most`` best rows scoring ``least`` or more.

    Ties go to smaller ids. Queries at similar distances from the pivot go through the annuli together, nearest first.
    """
    exact = np.float64 if index.longest < _DOUBLE else np.int64
    order = np.argsort(distance, kind="stable")
    ids, vectors, distance = ids[order], vectors[order].astype(exact), distance[order]
    starts = np.arange(0, len(ids), annulus)
    inner, outer = distance[starts], distance[np.minimum(starts + annulus, len(ids)) - 1]
    for at in np.array_split(np.argsort(own_distance, kind="stable"), -(-len(asked) // together)):
        q, away = asked[at].astype(exact), own_distance[at]
        squares = (asked[at].astype(float) ** 2).sum(axis=1)
        closest = np.maximum(0.0, np.maximum(inner[None, :] - away[:, None], away[:, None] - outer[None, :]))
        bounds = index.best_scores(squares[:, None], closest)
        # Scores the k-th best must reach; they rise as annuli are visited.
        reach, seen = least[at].astype(float), np.full((len(at), 0), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in np.argsort(closest.mean(axis=0), kind="stable"):
            active = np.flatnonzero(bounds[:, a] >= reach)
            if not len(active):
                continue
            here = slice(starts[a], starts[a] + annulus)
            scores = q[active] @ vectors[here].T
            best = np.concatenate([seen[active], scores], axis=1)
            if best.shape[1] > most:
                best = np.partition(best, best.shape[1] - most, axis=1)[:, -most:]
                reach[active] = np.maximum(reach[active], best.min(axis=1))
            if seen.shape[1] < best.shape[1]:
                seen = np.pad(seen, ((0, 0), (0, best.shape[1] - seen.shape[1])), constant_values=-np.inf)
            seen[active] = best
            which, column = np.nonzero(scores >= reach[active, None])
            found.append((active[which], ids[here][column], scores[which, column].astype(np.int64)))
        if not found:
            continue
        which, near, score = (np.concatenate(x) for x in zip(*found, strict=True))
        good = score >= reach[which]
        which, near, score = which[good], near[good], score[good]
        order = np.lexsort((near, -score, which))
        which, near, score = which[order], near[order], score[order]
        first = np.searchsorted(which, np.arange(len(at) + 1))
        for i in range(len(at)):
            if first[i] < first[i + 1]:
                own = slice(first[i], min(first[i + 1], first[i] + most))
                yield int(at[i]), near[own], score[own]


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """One row for each different vector: the first of its ids as ``key``, and the first ``most``; no other can be needed."""
    by_vector = Window.partitionBy("x").orderBy("vec_id")
    return (
        rows.withColumn("nth", F.row_number().over(by_vector))
        .where(F.col("nth") <= most)
        .groupBy("x")
        .agg(F.min("vec_id").alias("key"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    neighbours: int = 20,
    sample_rows: int = 16_384,
    most_cells: int = 512,
    block_rows: int = 65_536,
    query_rows: int = 65_536,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the rows of largest inner product, all of them counted.

    Components count as floor(64 * c). ``is_query`` is a condition on vec_id. Every usable row (see ``whole_vectors``) with a
    vec_id is a candidate for all queries but itself; zero vectors too. Rows that repeat a vec_id are rows of their own: a
    repeated query has a list for each, and is a candidate of its twin. Ties go to the smaller vec_id. Fewer candidates give
    shorter lists, empty input none. Inner products beyond a long are an error. ``sample_rows`` bounds what the pivots are
    fitted on; it changes the work and not the result.
    """
    spark, most = vectors.sparkSession, neighbours + 1
    rows = stored(whole_vectors(vectors).where("vec_id IS NOT NULL"), "whole")
    classes = stored(_classes(rows, most), "classes")
    square = "aggregate(x, 0D, (a, c) -> a + double(c) * double(c))"
    widest = F.expr("aggregate(x, 0L, (a, c) -> greatest(a, abs(c)))")
    seen = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(square)).alias("longest"), F.max(widest).alias("widest")).first()
    if not seen["n"]:
        return spark.createDataFrame([], RESULT)
    if seen["longest"] >= 2.0**62:
        raise OverflowError("inner products of these vectors do not fit a long")
    asked = stored(
        rows.where(is_query).join(classes.select("x", "key"), "x").select("key", F.col("vec_id").alias("query_id")), "asked"
    )

    picked = classes.select("x", "key").orderBy(F.xxhash64("key"), "key").limit(sample_rows).toArrow()
    sample = np.array(picked.column("x").combine_chunks().flatten(), float).reshape(picked.num_rows, -1)
    cells = int(np.clip(round(np.sqrt(seen["n"]) / 8), 1, most_cells))
    share = seen["n"] / len(sample) / block_rows
    index = fit_pivots(sample, int(np.ceil(seen["longest"])), seen["widest"], cells, share)
    version, fitted = uuid.uuid4().hex, spark.sparkContext.broadcast(index)

    def key_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once("pivots", version, lambda: fitted.value)
        for batch in batches:
            x = matrix(batch.column(1), model.width)
            ring, distance = model.key(x.astype(float))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ring), pa.array(distance), packed(x.astype(model.kind))], ["key", "ring", "distance", "x"]
            )

    keyed = stored(
        classes.select("key", "x").mapInArrow(key_vectors, "key long, ring long, distance double, x binary"), "keyed"
    )
    extent = keyed.groupBy("ring").agg(F.count(F.lit(1)).alias("rows"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    rings = extent.toArrow().sort_by("ring")  # as many as there are pivots times rings
    numbers = rings.column("ring").to_numpy()
    index.cell = np.searchsorted(index.first_ring, numbers, side="right") - 1
    index.rows, index.low, index.high = (rings.column(c).to_numpy() for c in ("rows", "low", "high"))
    index.slots = -(-index.rows // block_rows)
    filled = spark.sparkContext.broadcast((index, numbers))
    version_filled = uuid.uuid4().hex

    def model_now() -> tuple[PivotIndex, np.ndarray]:
        return once("rings", version_filled, lambda: filled.value)

    queries = keyed.join(asked.select("key").distinct(), "key", "left_semi").select("key", "ring", "x")
    dealt = [(r["ring"], -(-r["count"] // query_rows)) for r in queries.groupBy("ring").count().collect()]
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts"))
    queries = queries.join(spark.createDataFrame(dealt, "ring long, parts long"), "ring").select(
        "key", (F.col("ring") * F.lit(1 << 32) + part).alias("group"), "x"
    )

    visit_schema = "ring int, slot int, group long, key long, least long, x binary"
    lowest = np.iinfo(np.int64).min

    def visits(first: bool):
        """Where each query goes: the nearest rings that hold enough rows, one slot of each; or all others in reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, numbers = model_now()
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    rows_here = batch.slice(start, 256)
                    keys = rows_here.column(0).to_numpy()
                    q = unpacked(rows_here.column(2), model.kind, model.width).astype(float)
                    bounds = model.ring_bounds(q)
                    which, ring, slot = [], [], []
                    for i, bound in enumerate(bounds):
                        order = np.argsort(-bound, kind="stable")
                        enough = np.searchsorted(np.cumsum(-(-model.rows[order] // model.slots[order])), most) + 1
                        near = order[:enough]
                        one = keys[i] % model.slots[near]
                        if first:
                            goes, slots = near, one
                        else:
                            least = rows_here.column(3)[i].as_py()
                            goes = np.flatnonzero(bound >= (-np.inf if least is None else least))
                            slots = np.concatenate([np.arange(n) for n in model.slots[goes]]) if len(goes) else goes
                            goes = np.repeat(goes, model.slots[goes])
                            new = ~np.isin(goes * (1 << 32) + slots, near * (1 << 32) + one)
                            goes, slots = goes[new], slots[new]
                        which.append(np.full(len(goes), i))
                        ring.append(goes)
                        slot.append(slots)
                    at, ring_at = pa.array(np.concatenate(which)), np.concatenate(ring)
                    limit = pa.nulls(len(keys), pa.int64()) if first else rows_here.column(3)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers[ring_at].astype(np.int32)),
                            pa.array(np.concatenate(slot).astype(np.int32)),
                            rows_here.column(1).take(at),
                            rows_here.column(0).take(at),
                            limit.fill_null(lowest).take(at),
                            rows_here.column(2).take(at),
                        ],
                        ["ring", "slot", "group", "key", "least", "x"],
                    )

        return run

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        asking, near, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if here.num_rows and there.num_rows:
            model, numbers = model_now()
            x, q = (unpacked(t.column("x"), model.kind, model.width) for t in (here, there))
            cell = model.cell[np.searchsorted(numbers, here.column("ring")[0].as_py())]
            away = model.distances(q.astype(float), True)[:, cell]
            keys = there.column("key").to_numpy()
            limits = there.column("least").to_numpy()
            parts = search_ring(model, here.column("key").to_numpy(), x, here.column("distance").to_numpy(), q, limits, away, most)
            for i, ids, score in parts:
                asking.append(np.full(len(ids), keys[i]))
                near.append(ids)
                scores.append(score)
        names = ("query", "key", "score")
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in zip(names, (asking, near, scores), strict=True)})

    slots = spark.createDataFrame([(int(n), int(s)) for n, s in zip(numbers, index.slots, strict=True)], "ring long, slots int")
    placed = keyed.join(slots, "ring").select(
        "key", F.col("ring").cast("int").alias("ring"), F.pmod(F.xxhash64("key"), "slots").cast("int").alias("slot"), "distance", "x"
    )

    def answers(visited: DataFrame) -> DataFrame:
        """Each block is sent once to every group of queries that has one to visit it."""
        keys = ("ring", "slot", "group")
        wanted = visited.select(*[F.col(k).alias(f"to_{k}") for k in keys]).distinct()
        there = (F.col("ring") == F.col("to_ring")) & (F.col("slot") == F.col("to_slot"))
        sent = placed.join(wanted, there).select("ring", "slot", F.col("to_group").alias("group"), "key", "distance", "x")
        return sent.groupBy(*keys).cogroup(visited.groupBy(*keys)).applyInArrow(meet, "query long, key long, score long")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)

    early = stored(best(answers(stored(queries.mapInArrow(visits(True), visit_schema), "first"))), "early")
    least = early.where(F.col("nth") == most).select(F.col("query").alias("key"), F.col("score").alias("least"))
    limited = queries.join(least, "key", "left").select("key", "group", "x", "least")
    late = answers(stored(limited.mapInArrow(visits(False), visit_schema), "later"))
    listed = (
        best(early.drop("nth").unionByName(late))
        .join(classes.select("key", "ids"), "key")
        .groupBy("query")
        .agg(
            F.sort_array(
                F.flatten(
                    F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id"))))
                )
            ).alias("found")
        )
    )
    # A row is not its own neighbour: one place of its id among its own vector's goes.
    own = F.array_position("found", F.struct((-F.col("self")).alias("minus"), F.col("query_id").alias("vec_id")))
    squares = classes.select("key", F.expr("aggregate(x, 0L, (a, c) -> a + c * c)").alias("self"))
    mine = asked.join(listed.join(squares, F.col("query") == squares["key"]).drop("key"), asked["key"] == F.col("query"))
    without = mine.withColumn("own", own).select(
        "query_id",
        F.expr(f"slice(filter(found, (f, i) -> i + 1 <> own), 1, {neighbours})").alias("found"),
    )
    return without.select("query_id", F.posexplode("found").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score")
    )
