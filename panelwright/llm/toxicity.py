"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

The lexicon is learned: words and beginnings of words that labelled toxic documents have far more often than others,
weighted by their log odds. Features are its densities, also after undoing look-alike spellings, its nearness to words
in the second person, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Trees, fit_trees, isotonic, labelled_sample
from .words import CACHE_ENTRIES, Memo, once, per_text, pieces_of, texts_of

LETTERS = regex.compile(r"\p{L}+")
#: Second-person words of the supported languages (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself ya u du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros su os".split()
)
#: Characters that stand for letters in disguised spellings (fixed values).
LOOK_ALIKES = str.maketrans("013457@$!8+", "oieastasibt")
REACH = 5
#: Lengths of the beginnings that the lexicon may hold; a whole word is marked by an end sign.
STEMS, END = (4, 5, 6), "$"
LEXICON, DISGUISED, SECOND, SHOUTED, ODD, WEIGHT = 1, 2, 4, 8, 16, 8
FEATURES = (
    "log_words", "lexicon", "log_lexicon", "disguised", "weight", "mean_weight", "largest_weight", "distinct_lexicon",
    "near_second", "near_share", "second", "shouted", "capitals", "exclamations", "questions", "punctuation", "odd_words",
    "digits",
)


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    trees: Trees
    points: np.ndarray
    rates: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        return np.interp(margin, self.points, self.rates) if len(self.points) else self.trees.probability(x)


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word in lower case."""
    return [*(word[:n] for n in STEMS if len(word) >= n), word + END]


def undisguised(word: str) -> str:
    return "".join(LETTERS.findall(word.translate(LOOK_ALIKES)))


class WordMarks:
    """A word's bits (in the lexicon, there only when undisguised, second person, shouted, oddly written) and its weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, Memo(self.mark, CACHE_ENTRIES)

    def weight(self, parts: list[str]) -> float:
        return max((self.lexicon.get(e, 0.0) for p in parts for e in entries(p)), default=0.0)

    def mark(self, word: bytes) -> int:
        text = word.decode()
        low = text.lower()
        parts = LETTERS.findall(low)
        core = low.strip(".,;:!?\"'()")
        odd = len(parts) > 0 and any(not c.isalpha() and c not in "'-’" for c in core)
        weight, hidden = self.weight(parts), 0.0
        if odd and not weight:
            weight = hidden = self.weight([undisguised(core)])
        shouted = len(text) > 1 and text.isupper()
        second = any(p in SECOND_PERSON for p in parts)
        bits = DISGUISED * (hidden > 0) | LEXICON * (weight > hidden) | SECOND * second | SHOUTED * shouted | ODD * odd
        return bits | round(weight * 256) << WEIGHT

    def features(self, text: bytes) -> list[float]:
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        marks = np.fromiter(map(self.known.__getitem__, words), np.int64, n)
        places = np.flatnonzero(marks & (LEXICON | DISGUISED))
        weights = (marks >> WEIGHT) / 256
        near = 0
        if len(places):
            second = np.concatenate([[0], np.cumsum((marks & SECOND) > 0)])
            around = second[np.minimum(places + REACH + 1, n)] - second[np.maximum(places - REACH, 0)]
            near = int((around > 0).sum())
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        size = len(text)
        rate = lambda bit: float(((marks & bit) > 0).mean())
        return [
            math.log1p(n),
            rate(LEXICON),
            math.log1p(len(places)),
            rate(DISGUISED),
            float(weights.sum()),
            float(weights.mean()),
            float(weights.max()),
            float(len({words[i].lower() for i in places.tolist()})),
            near / n,
            near / len(places) if len(places) else 0.0,
            rate(SECOND),
            rate(SHOUTED),
            float(counts[65:91].sum() / size),
            float(counts[33] / size),
            float(counts[63] / size),
            float((counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / size),
            rate(ODD),
            float(counts[48:58].sum() / size),
        ]


def learn_lexicon(sample: DataFrame, least_docs: int = 5, least_odds: float = 4.0) -> dict[str, float]:
    """Entries whose document rate among toxic texts is at least ``least_odds`` times that among the others, with log odds.

    An entry counts only if at least ``least_docs`` toxic texts and half a per cent of them have it, and the difference
    exceeds four standard errors. The sample is bounded, and so is what comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                seen = (Counter(), Counter())
                for text, y in zip(texts_of(part), part.column(1).to_pylist(), strict=True):
                    words = set(LETTERS.findall(text.decode().lower()))
                    seen[y].update({e for w in words for e in entries(w)})
                yield pa.RecordBatch.from_pydict(
                    {
                        "word": pa.array([*seen[0], *seen[1]], pa.string()),
                        "y": pa.array([0] * len(seen[0]) + [1] * len(seen[1]), pa.int32()),
                        "n": pa.array([*seen[0].values(), *seen[1].values()], pa.int64()),
                    }
                )

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    words = sample.select("text", "y").mapInArrow(run, "word string, y int, n long").groupBy("word")
    counted = words.agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"),
    )
    p, q = F.col("a") / toxic, (F.col("b") + 0.5) / other
    error = F.sqrt(p * (1 - p) / toxic + q / other)
    chosen = counted.where(
        (F.col("a") >= max(least_docs, toxic / 200)) & (p >= least_odds * q) & (p - q >= 4 * error)
    )
    return {r["word"]: r["odds"] for r in chosen.select("word", F.log(p / q).alias("odds")).collect()}


def _features(docs: DataFrame, lexicon: dict[str, float], columns: tuple[str, ...]) -> DataFrame:
    version = uuid.uuid4().hex

    def make():
        marks = once("word marks", version, lambda: WordMarks(lexicon))

        def one(batch: pa.RecordBatch) -> dict:
            x = pa.array([marks.features(t) for t in texts_of(batch)], pa.list_(pa.float64()))
            return {c: batch.column(i) for i, c in enumerate(columns)} | {"x": x}

        return one

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "x array<double>"])
    return per_text(docs, (*columns, "text"), schema, make)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 20_000) -> Toxicity:
    """Fit on at most ``most_rows`` labelled documents; a fourth of them, by key, only calibrates."""
    sample = labelled_sample(docs, labels, label, most_rows)
    lexicon = learn_lexicon(sample)
    rows = _features(sample, lexicon, ("doc_id", "y")).orderBy("doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("y").to_pylist(), float)
    calibrate = np.arange(len(y)) % 4 == 3
    trees = fit_trees(x[~calibrate], y[~calibrate])
    points, rates = isotonic(trees.margin(x[calibrate]), y[calibrate])
    return Toxicity(lexicon, trees, points, rates)


def score_toxicity(docs: DataFrame, model: Toxicity, key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``score`` of each whole text. Null counts as empty; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # small trees and a lexicon from a bounded sample
    version = uuid.uuid4().hex

    def make():
        model = shared.value
        marks = once("word marks", version, lambda: WordMarks(model.lexicon))

        def one(batch: pa.RecordBatch) -> dict:
            x = np.array([marks.features(t) for t in texts_of(batch)])
            return {"doc_id": batch.column(0), "score": pa.array(model.score(x))}

        return one

    rows = docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    return per_text(rows, ("doc_id", "text"), "doc_id long, score double", make)
