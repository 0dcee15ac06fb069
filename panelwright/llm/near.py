"""Near-duplicate groups of texts by circulant MinHash, banding and exact Jaccard verification.

A shingle's hash is permuted once (sigma); all signature coordinates then come from one second permutation (pi) applied
to circularly shifted values. Texts with equal shingle sets form a class first; classes are linked through buckets of
equal bands. In a bucket every class meets its most central one, never all others. Links are confirmed on full shingle
sets and joined to components. Where a bucket still holds several components beside its centre, their classes are compared
through their rarest shingles (prefix filtering with exact bounds), so no link between candidates is lost and no bucket is
expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Memo, once, per_text, pieces_of, stored, texts_of

COORDINATES = 128
#: Coordinates in a band: coarse bands miss a pair at 0.8 with probability 5e-8, fine ones bring the most similar together.
BANDS = (4, 8)
_WORD, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint32(0xFFFF)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes() -> Memo:
    return once("word hashes", 0, lambda: Memo(xxhash.xxh3_64_intdigest))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(len(h) if len(h) < size else size))
    for k in range(min(size, len(h))):
        out = _mix64(out * _WORD + h[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a set: for each shift the least pi(sigma(x) + shift), of which the low 16 bits are kept."""
    sigma = (_mix64(shingles ^ _WORD) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, COORDINATES + 1, dtype=np.uint32)[:, None]
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(sigma), 2048):
        x = sigma[None, k : k + 2048] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(best, x.min(axis=1), out=best)
    return (best & _LOW).astype(np.int32)


def class_of(shingles: np.ndarray) -> int:
    """A set's class: a 64-bit hash of all its shingles."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_shingles``, ``class`` and ``sig`` of each text; null class and signature for an empty set."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            sizes, classes, sigs, seen = [], [], [], {}
            for text in texts_of(batch):
                s = shingle_set(text, size)
                sizes.append(len(s))
                c = class_of(s) if len(s) else None
                if c is not None and c not in seen:
                    seen[c] = signature(s).tolist()
                classes.append(c)
                sigs.append(seen.get(c))
            return {
                "row": batch.column(0),
                "doc_id": batch.column(2),
                "n_shingles": pa.array(sizes, pa.int64()),
                "class": pa.array(classes, pa.int64()),
                "sig": pa.array(sigs, pa.list_(pa.int32())),
            }

        return one

    schema = "row long, doc_id long, n_shingles long, class long, sig array<int>"
    return per_text(docs, ("row", "text", "doc_id"), schema, make)


def band_keys(classes: DataFrame) -> DataFrame:
    """One row (class, n, rows, band, key) for each band of each class."""
    bands = [
        F.struct(
            F.lit(rows).alias("rows"),
            F.lit(b).alias("band"),
            F.xxhash64(F.lit(rows), F.lit(b), F.slice("sig", b * rows + 1, rows)).alias("key"),
        )
        for rows in BANDS
        for b in range(COORDINATES // rows)
    ]
    return classes.select("class", "n", F.explode(F.array(*bands)).alias("b")).select("class", "n", "b.*")


def may_link(a: str, b: str, percent: int):
    """Whether sizes alone allow the similarity."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose full shingle sets are similar enough."""
    left = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}

        def known(cls: int, text: bytes) -> np.ndarray:
            if cls not in recent:
                if len(recent) >= 256:
                    recent.clear()
                recent[cls] = shingle_set(text, size)
            return recent[cls]

        for batch in batches:
            for part in pieces_of(batch, name="text_a"):
                ids = [part.column(i).to_pylist() for i in (0, 1)]
                out = []
                for a, b, s, t in zip(*ids, texts_of(part, "text_a"), texts_of(part, "text_b"), strict=True):
                    x, y = known(a, s), known(b, t)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"]
                )

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``class`` and ``label`` (the smallest class reachable) for each class that has a link."""
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class"), F.least("a", "m").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("class", "b"), "b")
            .groupBy(F.col("a").alias("class"))
            .agg(F.min("label").alias("near"))
        )
        step = stored(
            labels.join(near, "class").select("class", F.least("label", "near").alias("label"), F.col("label").alias("was")),
            "labels",
        )
        if step.where("label <> was").isEmpty():
            return labels
        ahead = step.select(F.col("class").alias("label"), F.col("label").alias("further"))
        labels = stored(step.join(ahead, "label").select("class", F.col("further").alias("label")), "labels")


def labelled(df: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """The frame with the component of a class column; a class without links is its own."""
    found = labels.select(F.col("class").alias(column), F.col("label").alias(out))
    return df.join(found, column, "left").withColumn(out, F.coalesce(out, column))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row.

    Texts are lower-cased in A-Z and split at ASCII white space. Null and blank texts have no shingles, link with nothing
    and are their own component. Rows that repeat a key each keep theirs, and all count under that key; a row without key is
    not kept, but others link through it. An empty table gives no rows; other columns are not read.
    """
    docs = docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    placed = _placed(numbered(docs, "row"), size, percent)
    # Written first, so that the join below sees two plain shuffles and can split a large component.
    least = stored(placed.where("class IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    return placed.join(least, "label", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )


def distinct_rows(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the least key, a null key last.

    Rows are told apart by a numbering of their own, so keys may repeat or be null; rows with equal keys go by it. Texts
    without shingles are in no group and all stay.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    docs = numbered(docs, row)
    keyed = docs.selectExpr(f"`{row}` AS row", f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    placed = _placed(keyed, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    best = placed.where("class IS NOT NULL").groupBy("label").agg(first).select(F.col("first.row").alias(row))
    kept = stored(best.union(placed.where("class IS NULL").select("row")), "kept")
    return docs.join(kept, row, "left_semi").drop(row)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, written once so that all readers see the same."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def _placed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_shingles``, ``class`` and ``label`` (its component) of each of the numbered rows."""
    rows = stored(signatures(docs, size), "signatures")
    classes = stored(
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.min_by("sig", "row").alias("sig")),
        "classes",
    )
    keys = band_keys(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # Only buckets with several classes matter from here on.
    buckets = stored(keys.join(stored(shared, "shared"), "key"), "buckets")
    weights = buckets.groupBy("class").agg(F.sum("members").alias("weight"))
    centres = (
        buckets.join(weights, "class")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "class")).alias("centre"))
        .select("key", F.col("centre.class").alias("centre"))
    )
    buckets = stored(buckets.drop("members").join(stored(centres, "centres"), "key"), "buckets")
    sizes = classes.select(F.col("class").alias("b"), F.col("n").alias("n_b"))
    stars = stored(
        buckets.where("class <> centre")
        .groupBy(F.col("class").alias("a"), F.col("centre").alias("b"))
        .agg(F.first("n").alias("n_a"), F.count(F.lit(1)).alias("shared"))
        .join(sizes, "b")
        .where(may_link("n_a", "n_b", percent))
        .select("a", "b", "shared"),
        "stars",
    )
    wanted = buckets.select("class").distinct().join(classes.select("class", "row"), "class")
    texts = stored(docs.join(wanted, "row").select("class", "text"), "texts")

    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    links = stored(confirmed(best, texts, size, percent), "links")
    labels = components(links)
    pairs = _other_stars(stars, labels)
    links = stored(links.union(confirmed(pairs, texts, size, percent)), "links")
    labels = components(links)
    pairs = _other_pairs(buckets, texts, labels, size, percent)
    links = stored(links.union(confirmed(pairs, texts, size, percent)), "links")
    labels = components(links)

    return labelled(rows.drop("sig"), labels, "class", "label")


def _other_stars(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """The remaining pairs of a class and a bucket's centre, where both are in different components."""
    both = labelled(labelled(stars.select("a", "b"), labels, "a", "of_a"), labels, "b", "of_b")
    return both.where("of_a <> of_b").select("a", "b")


def _other_pairs(buckets: DataFrame, texts: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of different components that may be similar, among the classes of buckets that hold several.

    Centres have met all others of their bucket. Of the rest, the largest component of a bucket is not compared with
    itself: the other classes ask. Two sets of n and m shingles need an overlap of o = percent (n + m) / (100 + percent),
    so with shingles ordered by rarity, their first common one has at least o shingles from it on in either set.
    """
    placed = labelled(buckets.where((F.col("rows") == BANDS[0]) & (F.col("class") != F.col("centre"))), labels, "class", "label")
    parts = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"))
    leading = (
        parts.groupBy("key")
        .agg(F.max(F.struct("members", "label")).alias("leading"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("key", F.col("leading.label").alias("leading"))
    )
    open_ = stored(
        placed.join(leading, "key")
        .groupBy("class", "n", "label")
        .agg(F.max(F.col("label") != F.col("leading")).alias("asks")),
        "open",
    )
    tokens = stored(_tokens(texts.join(open_.select("class"), "class", "left_semi"), size), "tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("classes"))
    by_rarity = Window.partitionBy("class").orderBy("classes", "token")
    ranked = tokens.join(counts, "token").withColumn("before", F.row_number().over(by_rarity) - 1)
    prefix = stored(
        ranked.where("classes > 1").join(open_, "class").where((F.col("n") - F.col("before")) * 100 >= F.col("n") * percent),
        "prefixes",
    )
    a = prefix.where("asks").select("token", *[F.col(c).alias(f"{c}_a") for c in ("class", "n", "label", "before")])
    b = prefix.select("token", *[F.col(c).alias(f"{c}_b") for c in ("class", "n", "label", "before", "asks")])
    needed = percent * (F.col("n_a") + F.col("n_b"))
    found = a.join(
        b,
        (a["token"] == b["token"])
        & (F.col("label_a") != F.col("label_b"))
        & (~F.col("asks_b") | (F.col("class_a") < F.col("class_b")))
        & ((100 + percent) * (F.col("n_a") - F.col("before_a")) >= needed)
        & ((100 + percent) * (F.col("n_b") - F.col("before_b")) >= needed),
    )
    return found.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """One row for each shingle of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                s = shingle_set(text, size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), cls)), pa.array(s)], ["class", "token"])

    return texts.select("class", "text").mapInArrow(run, "class long, token long")
