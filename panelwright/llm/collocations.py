"""Phrases whose words occur together, by a weighted de Bruijn graph of each language.

A gram of the greatest length is an edge between the two overlapping grams one word shorter; its weight is how often it
occurs. Where a piece ends before that length, the shorter gram found there is kept as a correction of its node. Every
occurrence of a phrase begins one edge or one such gram, so the counts of all shorter phrases follow from the flow out of
their nodes and the corrections; only longest grams are ever counted in the text.

Two or three words rarer than the threshold lie in no phrase that can be listed, so edges are cut there as at the end of a
piece. Which may be frequent is kept in bitmaps of fixed size, found in two passes: a rare one that passes costs time and
changes no count. Chains of edges without a branch and with one weight become one path with a row of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import once, per_text, stored, texts_of

LONGEST = 4
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = b"\xff"  # no byte of UTF-8
#: A-Z in lower case, tabs as blanks, ends of pieces as breaks.
_BYTES = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + _BREAK * len(_ENDS)
)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all pieces as numbers, 0 where a piece ends, and the words by number."""
    plain = _BREAK.join(texts).translate(_BYTES).replace(_BREAK, b" \xff ")
    found = plain.split()
    numbers = _Numbers({_BREAK: 0})
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
    return ids, list(numbers)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * _FIRST) ^ (second + _SECOND)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SECOND
    return mixed ^ (mixed >> np.uint64(32))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(1).to_pylist(), texts_of(batch), strict=True):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes.view(np.int64) & np.int64(len(bitmap) * 8 - 1)
    return bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 > 0


def _pairs_linked(ids: np.ndarray, known: np.ndarray, often: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Of each position whether it and the next are words of one piece and may be a frequent pair."""
    linked = np.zeros(len(ids), bool)
    linked[:-1] = often[ids[:-1]] & often[ids[1:]]
    at = np.flatnonzero(linked)
    linked[at] = _marked(bitmap, pair_hashes(known[ids[at]], known[ids[at + 1]]))
    return linked


def _triple_hashes(ids: np.ndarray, known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return pair_hashes(pair_hashes(known[ids[at]], known[ids[at + 1]]), known[ids[at + 2]])


def _counts(hashes: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    hashes, counts = [np.zeros(0, np.uint64), *hashes], [np.zeros(0, np.int64), *counts]
    return {"hash": pa.array(np.concatenate(hashes).view(np.int64)), "n": pa.array(np.concatenate(counts).astype(np.int64))}


def _pair_counts(batch: pa.RecordBatch) -> dict:
    """Counts of the words and of the pairs of neighbouring words, by hash."""
    hashes, counts = [], []
    for lang, texts in _by_lang(batch):
        ids, words = numbered(texts)
        if not len(ids):
            continue
        known = word_hashes(words, lang)
        pairs = (ids[:-1] << 32 | ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)]
        pairs, n = np.unique(pairs, return_counts=True)
        hashes += [known[1:], pair_hashes(known[pairs >> 32], known[pairs & 0xFFFFFFFF])]
        counts += [np.bincount(ids, minlength=len(words))[1:], n]
    return _counts(hashes, counts)


def _triple_counts(pairs: np.ndarray):
    """Counts, by hash, of three words in a row of which both pairs may be frequent."""

    def run(batch: pa.RecordBatch) -> dict:
        hashes, counts = [], []
        for lang, texts in _by_lang(batch):
            ids, words = numbered(texts)
            known = word_hashes(words, lang)
            often = _marked(pairs, known)
            often[0] = False
            linked = _pairs_linked(ids, known, often, pairs)
            at = np.flatnonzero(linked[:-1] & linked[1:])
            found, n = np.unique(_triple_hashes(ids, known, at), return_counts=True)
            hashes.append(found)
            counts.append(n)
        return _counts(hashes, counts)

    return run


def frequent_bitmap(docs: DataFrame, make, least: int, slots: int) -> np.ndarray:
    """One bit for each hash that ``make`` counts ``least`` times in all; others may share it. Fixed size."""
    counted = per_text(docs, ["text", "lang"], "hash long, n long", make)
    often = counted.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.pmod("hash", F.lit(slots))
    bit = F.expr(f"shiftleft(1, cast(pmod(hash, {slots}) % 8 as int))")
    marked = often.groupBy((slot / 8).cast("int").alias("byte")).agg(F.bit_or(bit).cast("short").alias("bits")).toArrow()
    bitmap = np.zeros(slots // 8, np.uint8)
    bitmap[marked.column("byte").to_numpy()] = marked.column("bits").to_numpy()
    return bitmap


def _longest_grams(pairs: np.ndarray, triples: np.ndarray):
    """Of each position the longest gram up to the end of its piece or a rare pair or triple; counted, as text."""

    def run(batch: pa.RecordBatch) -> dict:
        langs, grams, counts = [], [], []

        def add(lang: str, text: pa.Array, n: np.ndarray) -> None:
            langs.append(pa.array([lang] * len(text), pa.string()))
            grams.append(text)
            counts.append(n)

        for lang, texts in _by_lang(batch):
            ids, words = numbered(texts)
            add(lang, pa.array([""]), np.array([np.count_nonzero(ids)]))
            if not len(ids):
                continue
            known, spelled = word_hashes(words, lang), pa.array(words, pa.binary())
            often = _marked(pairs, known)
            often[0] = False
            ids = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
            linked = _pairs_linked(ids, known, often, pairs)
            tripled = np.zeros(len(ids), bool)
            at = np.flatnonzero(linked[:-1] & linked[1:])
            tripled[at] = _marked(triples, _triple_hashes(ids, known, at))
            # A lone word is a gram as well: the correction of its node where nothing follows it.
            alone = np.bincount(ids[~linked], minlength=len(words))
            alone[~often] = 0
            single = np.flatnonzero(alone)
            add(lang, spelled.take(pa.array(single)).cast(pa.string()), alone[single])
            starts = np.flatnonzero(linked)
            third = tripled[starts]
            columns = [ids[starts], ids[starts + 1], np.where(third, ids[starts + 2], 0)]
            columns.append(np.where(third & tripled[starts + 1], ids[starts + 3], 0))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(order)))
            columns = [c[first] for c in columns]
            size = 2 + (columns[2] > 0) + (columns[3] > 0)
            for length in (2, 3, 4):
                own = size == length
                parts = [spelled.take(pa.array(c[own])) for c in columns[:length]]
                add(lang, pc.binary_join_element_wise(*parts, b" ").cast(pa.string()), n[own])
        empty = pa.array([], pa.string())
        return {
            "lang": pa.concat_arrays([empty, *langs]),
            "gram": pa.concat_arrays([empty, *grams]),
            "n": pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)),
        }

    return run


def longest_grams(docs: DataFrame, least: int, slots: int) -> DataFrame:
    """``lang``, ``gram``, ``n``, ``words``: edges of four words, shorter grams where a piece or a frequent stretch ends, and all words
    of a language under the empty gram."""
    spark = docs.sparkSession
    first, second = uuid.uuid4().hex, uuid.uuid4().hex
    pairs = spark.sparkContext.broadcast(frequent_bitmap(docs, lambda: _pair_counts, least, slots))
    make = lambda: _triple_counts(once("pairs", first, lambda: pairs.value))
    triples = spark.sparkContext.broadcast(frequent_bitmap(docs, make, least, slots))
    counted = per_text(
        docs,
        ["text", "lang"],
        "lang string, gram string, n long",
        lambda: _longest_grams(*once("grams", second, lambda: (pairs.value, triples.value))),
    )
    words = F.when(F.col("gram") == "", 0).otherwise(F.size(F.split("gram", " ")))
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("words", words)


def unary_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang``, ``edge``, ``next``: edges that meet in a node whose whole flow comes by the one and leaves by the other."""
    flow = nodes.select("lang", F.col("phrase").alias("node"), F.col("f").alias("flow"))

    def carrying_all(node: int, name: str) -> DataFrame:
        ends = edges.select("lang", F.substring_index("gram", " ", node).alias("node"), F.col("gram").alias(name), "n")
        return ends.join(flow, ["lang", "node"]).where("n = flow").select("lang", "node", name)

    met = carrying_all(1 - LONGEST, "edge").join(carrying_all(LONGEST - 1, "next"), ["lang", "node"])
    return met.where("edge <> next").select("lang", "edge", "next")


def compacted(edges: DataFrame, nodes: DataFrame, segment: int = 1024) -> DataFrame:
    """``lang``, ``words``, ``n``: the edges, those of a chain as one path of at most ``segment`` edges.

    Each edge of a chain looks for the chain's head by steps that double. Edges of a ring have no head and stay alone.
    """
    links = stored(unary_links(edges, nodes), "links")
    heads = links.select("lang", "edge").join(links.select("lang", F.col("next").alias("edge")), ["lang", "edge"], "left_anti")
    steps = stored(
        links.select("lang", F.col("next").alias("edge"), F.col("edge").alias("back"), F.lit(1).cast("long").alias("far"))
        .unionByName(heads.select("lang", "edge", F.col("edge").alias("back"), F.lit(0).cast("long").alias("far"))),
        "steps",
    )
    most, reached = steps.count(), 1
    while True:
        there = steps.select(
            F.col("lang").alias("lang_"), F.col("edge").alias("edge_"), F.col("back").alias("back_"), F.col("far").alias("far_")
        )
        met = steps.join(there, (F.col("lang") == F.col("lang_")) & (F.col("back") == F.col("edge_")))
        steps = stored(
            met.select("lang", "edge", F.col("back_").alias("back"), (F.col("far") + F.col("far_")).alias("far"),
                       (F.col("far_") == 0).alias("done")),
            "steps",
        )
        reached *= 2
        if reached > most or steps.where(~F.col("done")).isEmpty():
            break
        steps = steps.drop("done")
    chained = steps.where("done").select("lang", F.col("edge").alias("gram"), "back", "far")
    placed = edges.join(chained, ["lang", "gram"], "left")
    alone = placed.where("back IS NULL").select("lang", F.split("gram", " ").alias("words"), "n")
    chain = (
        placed.where("back IS NOT NULL")
        .groupBy("lang", "back", F.floor(F.col("far") / segment).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("far", "gram"))).alias("row"), F.min("n").alias("n"))
    )
    last = F.transform(F.expr("slice(row, 2, size(row))"), lambda e: F.substring_index(e["gram"], " ", -1))
    return alone.unionByName(chain.select("lang", F.concat(F.split(F.col("row")[0]["gram"], " "), last).alias("words"), "n"))


def node_flow(grams: DataFrame, words: int, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``f`` of the phrases of so many words that occur ``least`` times: what leaves their node by longer
    grams, and the corrections that end there."""
    prefix = F.substring_index("gram", " ", words).alias("phrase")
    flow = grams.where(F.col("words") >= words).groupBy("lang", prefix).agg(F.sum("n").alias("f"))
    return flow.where(F.col("f") >= least)


def phrase_counts(grams: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``f``, ``words`` of all phrases of up to four words that occur ``least`` times."""
    nodes = stored(node_flow(grams, LONGEST - 1, least), "nodes")
    edges = stored(grams.where((F.col("words") == LONGEST) & (F.col("n") >= least)).select("lang", "gram", "n"), "edges")
    paths = compacted(edges, nodes)
    along = f"transform(sequence(1, size(words) - {LONGEST - 1}), i -> concat_ws(' ', slice(words, i, {LONGEST})))"
    found = {LONGEST: paths.select("lang", F.explode(F.expr(along)).alias("phrase"), F.col("n").alias("f")), LONGEST - 1: nodes}
    found |= {k: node_flow(grams, k, least) for k in range(1, LONGEST - 1)}
    return reduce(DataFrame.unionByName, [df.withColumn("words", F.lit(k)) for k, df in found.items()])


def _exact(column: str):
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, slots: int = 1 << 25) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases of 2 to 4 words.

    A null lang counts as ``und`` (with a lang of that name), a null text as empty. Phrases occur within pieces, which end at
    ``.,;:!?`` and line ends; a phrase inside a longer one that has ``covered`` per cent of its count goes. Repeated rows
    count as often as they occur; ties rank by count, then by the phrase's bytes. Empty input gives no rows. ``slots``, a
    power of two, is the size of each bitmap of frequent pairs and triples in bits; it changes the work and not the result.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    grams = stored(longest_grams(rows, least, slots), "grams")
    counts = stored(phrase_counts(grams, least), "phrases")
    totals = grams.where("gram = ''").select("lang", "n")
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")

    inner = """flatten(transform(sequence(2, words - 1), j -> transform(sequence(1, words - j + 1),
        i -> concat_ws(' ', slice(split(phrase, ' '), i, j)))))"""
    covers = (
        candidates.where("words > 2")
        .select("lang", F.explode(F.expr(inner)).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = candidates.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * covered)
    )
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    million = F.lit(2_000_000).cast("decimal(38,0)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns(
        {"top": (million * _exact("a")).cast("decimal(38,0)"), "under": (_exact("l") + _exact("r")).cast("decimal(38,0)")}
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
