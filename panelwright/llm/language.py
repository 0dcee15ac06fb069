"""Language identification by known words first, then by ever shorter character n-grams.

A word of the training sample adds its per-language log frequencies; an unseen word adds the mean of its known 4-grams,
else of its 3-grams, 2-grams or characters. Counts are made by Spark over a bounded sample of labelled texts.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import CACHE_ENTRIES, beside, once, per_text, pieces_of, remainder, texts_of

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (4, 3, 2, 1)
UNDETERMINED = "und"


def grams(word: str, n: int) -> list[str]:
    """Character n-grams with marked word ends; single characters have no marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def bounded_sample(docs: DataFrame, keep: Column, most: int, key: str = "doc_id") -> DataFrame:
    """Rows that ``keep`` accepts, of at most ``most`` keys of each language, by the order of a hash of the key.

    Only keys whose hash lies in the share that a language needs (and a quarter more) are ordered; texts are fetched
    afterwards.
    """
    rows = docs.where(keep).select(key, "lang")
    spread = 1 << 40
    place = F.pmod(F.xxhash64(key), F.lit(spread))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("keys"))
    limits = counts.select("lang", (F.lit(1.25 * most * spread) / F.col("keys")).alias("limit"))
    near = rows.join(F.broadcast(limits), "lang").where(place < F.col("limit")).select("lang", key).distinct()
    order = Window.partitionBy("lang").orderBy(place, key)
    picked = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("lang", key)
    return docs.where(keep).join(F.broadcast(picked), ["lang", key], "left_semi")


def count_sample(sample: DataFrame) -> DataFrame:
    """(lang, size, item, n): words (size 0) and n-grams of the sample with their counts for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                words: dict[str, Counter] = defaultdict(Counter)
                for text, lang in zip(texts_of(part), part.column(1).to_pylist(), strict=True):
                    words[lang].update(LETTERS.findall(text.decode().lower()))
                out = Counter()
                for lang, seen in words.items():
                    for word, n in seen.items():
                        out[lang, 0, word] += n
                        for size in ORDERS:
                            for g in grams(word, size):
                                out[lang, size, g] += n
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([k[0] for k in out], pa.string()),
                        "size": pa.array([k[1] for k in out], pa.int32()),
                        "item": pa.array([k[2] for k in out], pa.string()),
                        "n": pa.array(out.values(), pa.int64()),
                    }
                )

    rows = sample.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(
        F.sum("n").alias("n")
    )


@dataclass
class LanguageModel:
    """Log odds of each language for words (size 0) and n-grams, each against the mean of all languages."""

    languages: list[str]
    odds: dict[int, dict[str, tuple[float, ...]]]

    def word(self, word: str) -> tuple[float, ...]:
        found = self.known(word)
        return (0.0,) * len(self.languages) if found is None else found

    def known(self, word: str) -> tuple[float, ...] | None:
        """The odds of a word, or None where the sample has no part of it."""
        known = self.odds[0].get(word)
        if known is not None:
            return known
        for size in ORDERS:
            get = self.odds[size].get
            found = [v for g in grams(word, size) if (v := get(g)) is not None]
            if found:
                n = len(found)
                return tuple([sum(c) / n for c in zip(*found, strict=True)])
        return None


class WordScores(dict):
    """Rows of white-space separated words: ``odds`` has a row's summed log odds, ``words`` its words, ``known`` those known."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.odds, self.words, self.known = model, array("d"), array("i"), array("i")

    def __missing__(self, word: bytes) -> int:
        parts = LETTERS.findall(word.decode().lower())
        found = [x for p in parts if (x := self.model.known(p)) is not None]
        if len(found) == 1:
            self.odds.extend(found[0])
        else:
            none = (0.0,) * len(self.model.languages)
            self.odds.extend([sum(c) for c in zip(none, *found, strict=True)])
        self.words.append(len(parts))
        self.known.append(len(found))
        row = self[word] = len(self.words) - 1
        return row

    def trim(self) -> None:
        """Start anew when full; rows handed out before are no longer valid."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
            del self.odds[:], self.words[:], self.known[:]


def fit_languages(
    docs: DataFrame, train: Column, most_docs: int = 1000, min_count: int = 2, key: str = "doc_id"
) -> LanguageModel:
    """Fit on at most ``most_docs`` labelled texts of each language; items seen fewer than ``min_count`` times are left out."""
    sample = bounded_sample(docs.select(key, "text", "lang"), train & F.col("lang").isNotNull(), most_docs, key)
    counts = count_sample(sample).groupBy("size", "item").agg(
        F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("total")
    )
    rows = counts.where(F.col("total") >= min_count).orderBy("size", "item").toArrow()
    sizes, items, by = (rows.column(c).to_pylist() for c in ("size", "item", "by"))
    languages = sorted({x["lang"] for b in by for x in b})
    place = {v: i for i, v in enumerate(languages)}
    odds: dict[int, dict[str, np.ndarray]] = {}
    for size in (0, *ORDERS):
        at = [i for i, s in enumerate(sizes) if s == size]
        n = np.full((len(at), len(languages)), 0.5)
        for k, i in enumerate(at):
            for x in by[i]:
                n[k, place[x["lang"]]] += x["n"]
        logs = np.log(n / n.sum(axis=0)) if at else n
        logs -= logs.mean(axis=1, keepdims=True) if at else 0
        odds[size] = dict(zip([items[i] for i in at], map(tuple, logs.tolist()), strict=True))
    return LanguageModel(languages, odds)


def _predicting(docs: DataFrame, model: LanguageModel, weight: int):
    """What a task needs to predict batches of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    version = uuid.uuid4().hex

    def make() -> Callable[[pa.RecordBatch], dict]:
        scores = once("languages", version, lambda: WordScores(shared.value))
        model, width = scores.model, len(scores.model.languages)

        def one(batch: pa.RecordBatch) -> dict:
            scores.trim()
            split = [t.split() for t in texts_of(batch)]
            at = np.fromiter((i for ws in split for i in map(scores.__getitem__, ws)), np.int64)
            pred, score = [UNDETERMINED] * len(split), np.zeros(len(split))
            words, known = np.zeros(len(split), np.int64), np.zeros(len(split), np.int64)
            sizes = np.array([len(ws) for ws in split])
            rows = np.flatnonzero(sizes)
            if len(rows):
                starts = (np.cumsum(sizes) - sizes)[rows]
                words[rows] = n = np.add.reduceat(np.array(scores.words, np.int64)[at], starts)
                known[rows] = np.add.reduceat(np.array(scores.known, np.int64)[at], starts)
            if width and len(rows):
                total = np.add.reduceat(np.array(scores.odds).reshape(-1, width)[at], starts)
                mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, weight)[:, None]
                best = mean.argmax(axis=1)
                share = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
                for r, b, s, k in zip(rows.tolist(), best.tolist(), share.tolist(), n.tolist(), strict=True):
                    if k:
                        pred[r], score[r] = model.languages[b], s
            return {
                "doc_id": batch.column(0),
                "lang_pred": pa.array(pred, pa.string()),
                "score": pa.array(score),
                "words": pa.array(words),
                "known": pa.array(known),
            }

        return one

    return make


SCHEMA = "doc_id long, lang_pred string, score double, words long, known long"


def predict_languages(docs: DataFrame, model: LanguageModel, weight: int = 20, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each whole text.

    ``und`` with score 0 for a null text, a text without letters, or a model without languages. The score is the share
    of the best language after ``weight`` words of the text's mean log odds. Ties go to the first language by name.
    Repeated keys keep their rows; an empty table gives none; other columns are not read.
    """
    rows = docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    found = per_text(rows, ("doc_id", "text"), SCHEMA, _predicting(docs, model, weight))
    return found.select("doc_id", "lang_pred", "score")


def recognised(
    docs: DataFrame, model: LanguageModel, least_score: float = 0.4, weight: int = 20, key: str = "doc_id"
) -> DataFrame:
    """The rows of ``docs`` that the model has nothing against, with all their columns.

    Texts without letters go, and texts of which the model knows most words but no language reaches ``least_score``. A text
    of mostly unknown words (a script that was not in the sample, a model without languages) says nothing and stays.
    """
    inputs = [f"cast(`{key}` AS BIGINT)", "cast(text AS STRING)"]
    found = beside(docs, inputs, SCHEMA, _predicting(docs, model, weight), "_language")
    unknown = 2 * F.col("_language.known") <= F.col("_language.words")
    good = (F.col("_language.words") > 0) & (unknown | (F.col("_language.score") >= least_score))
    return found.where(good).select(*docs.columns)


def held_out(key: str = "doc_id", parts: int = 4, out: int = 2) -> Column:
    """Documents kept from training; a null key is held out."""
    return F.coalesce(remainder(key, parts) == out, F.lit(True))
