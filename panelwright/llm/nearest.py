"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into binary codes. A code's substrings are indexed one by one: a
code within Hamming radius r of a query agrees with it in at least one substring up to r // substrings bits, so probing
those buckets finds every code within the radius. What was found is ranked by inner products of the original vectors.
Queries meet the index in blocks; equal vectors are one entry of the index, with the few ids that can be among the best.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import once, stored

SUBSTRING_BITS = 8
_ONES = np.array([bin(v).count("1") for v in range(256)], np.uint8)


@dataclass
class Codes:
    """Centre, rotations and radius; vectors get one more component so that nearness is a matter of angle alone."""

    longest: float
    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of bytes."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(axis=1)))
        turned = (np.column_stack([vectors, rest]) - self.centre) @ self.rotation
        return np.packbits(turned > 0, axis=1)


def fit_codes(
    sample: np.ndarray, longest: float, neighbours: int, rotations: int = 2, rounds: int = 30, share: float = 0.985
) -> Codes:
    """Iterative quantisation: principal axes, then rotations that bring the points close to the corners of a cube.

    The radius holds ``share`` of the sample's own nearest neighbours, which are farther than those among all rows.
    """
    rest = np.sqrt(np.maximum(0, longest**2 - (sample**2).sum(axis=1)))
    points = np.column_stack([sample, rest])
    centre = points.mean(axis=0)
    scatter = (points - centre).T @ (points - centre)
    axes = np.linalg.eigh(scatter)[1][:, ::-1]
    bits = max(1, sample.shape[1] // SUBSTRING_BITS) * SUBSTRING_BITS
    axes = axes[:, :bits]
    if axes.shape[1] < bits:
        axes = np.pad(axes, ((0, 0), (0, bits - axes.shape[1])))
    projected = (points - centre) @ axes
    random, turned = np.random.default_rng(7), []
    for _ in range(rotations):
        rotation = np.linalg.qr(random.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
            rotation = (left @ right).T
        turned.append(axes @ rotation)
    codes = Codes(longest, centre, np.column_stack(turned), 0)
    probes = sample[: min(500, len(sample))]
    asked, known = codes.encode(probes, True), codes.encode(sample, False)
    far = []
    for i, q in enumerate(probes):
        order = np.argsort(-(sample @ q))
        best = order[order != i][:neighbours]
        far.append(_ONES[known[best] ^ asked[i]].sum(axis=1))
    codes.radius = int(np.ceil(np.quantile(np.concatenate(far), share))) if len(sample) > 1 else rotations * bits
    return codes


class MultiIndex:
    """Codes of one block by the value of each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.starts = np.array([np.searchsorted(np.sort(c), np.arange(257)) for c in codes.T])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius."""
        seen = np.zeros(len(self.codes), bool)
        for j, value in enumerate(code):
            near = np.flatnonzero(_ONES[np.arange(256) ^ value] <= radius // len(code))
            start, stop = self.starts[j, near], self.starts[j, near + 1]
            n = stop - start
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            seen[self.order[at, j]] = True
        found = np.flatnonzero(seen)
        return found[_ONES[self.codes[found] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part: of the commonest length, finite, not zero, one for each id."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(
        "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('Infinity'))"
        " AND exists(v, x -> x <> 0)"
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    common = lengths.first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def search(
    vectors: DataFrame,
    is_query: Column,
    neighbours: int = 20,
    sample_rows: int = 20_000,
    block_rows: int = 8192,
    query_rows: int = 8192,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the rows of largest inner product found for each query.

    All other rows are candidates; fewer than ``neighbours`` of them give shorter lists. Of equal scores the smaller
    vec_id comes first. Null, zero and non-finite vectors, and those of another than the commonest length, take no part;
    of rows that repeat a vec_id the least vector stands. Empty input gives no rows. Where the radius yields too few
    candidates in all blocks together, the whole blocks are ranked for that query.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    # Of equal vectors only the first ids can be among the best; each task drops the others before the shuffle.
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    first = (
        rows.withColumn("nth", F.row_number().over(by_vector))
        .where(F.col("nth") <= neighbours + 1)
        .groupBy("v")
        .agg(F.min("vec_id").alias("key"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    index = stored(first, "index")
    asked = stored(
        rows.where(is_query).join(index.select("v", "key"), "v").select("key", F.col("vec_id").alias("query_id")), "asked"
    )
    size = "sqrt(aggregate(v, double(0), (a, x) -> a + x * x))"
    summary = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(size)).alias("longest")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not summary["n"]:
        return spark.createDataFrame([], empty)
    queries = stored(index.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v"), "queries")
    picked = index.select("v", "key").orderBy(F.xxhash64("key"), "key").limit(sample_rows).toArrow()
    sample = np.array(picked.column("v").combine_chunks().flatten()).reshape(picked.num_rows, -1)
    codes = spark.sparkContext.broadcast(fit_codes(sample, summary["longest"], neighbours))

    blocks = -(-summary["n"] // block_rows)
    query_blocks = -(-queries.count() // query_rows) or 1
    here = (
        index.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )
    there = (
        queries.withColumn("query_block", F.pmod(F.xxhash64("key"), F.lit(query_blocks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    version = uuid.uuid4().hex
    most = neighbours + 1

    def meet(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        keys, near, scores = [], [], []
        if candidates.num_rows and questions.num_rows:
            model = once("codes", version, lambda: codes.value)
            ids = candidates.column("key").to_numpy()
            matrix, ask = (
                t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (candidates, questions)
            )
            index, code = MultiIndex(model.encode(matrix, False)), model.encode(ask, True)
            for key, q, c in zip(questions.column("key").to_pylist(), ask, code, strict=True):
                found = index.within(c, model.radius)
                if len(found) < min(most, len(ids)):
                    found = np.arange(len(ids))
                score = matrix[found] @ q
                best = np.lexsort((ids[found], -score))[:most]
                keys += [key] * len(best)
                near += ids[found[best]].tolist()
                scores += score[best].tolist()
        return pa.table(
            {"query": pa.array(keys, pa.int64()), "key": pa.array(near, pa.int64()), "score": pa.array(scores, pa.float64())}
        )

    met = (
        here.groupBy("block", "query_block")
        .cogroup(there.groupBy("block", "query_block"))
        .applyInArrow(meet, "query long, key long, score double")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    best = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    listed = (
        best.join(index.select("key", "ids"), "key")
        .groupBy("query")
        .agg(
            F.sort_array(
                F.flatten(
                    F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id"))))
                )
            ).alias("found")
        )
    )
    own = asked.join(listed, asked["key"] == listed["query"]).select(
        "query_id", F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {neighbours})").alias("found")
    )
    return own.select("query_id", F.posexplode("found").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score")
    )
