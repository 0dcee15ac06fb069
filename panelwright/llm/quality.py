"""A quality classifier: histogram gradient-boosted trees over statistics of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .trees import Trees, fit_trees, labelled_sample
from .words import Memo, once, per_text, texts_of

FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "upper", "lower", "digits", "spaces", "other_letters", "stops",
    "commas", "marks", "bars", "symbols", "other_punctuation", "byte_entropy", "distinct_words", "commonest_word",
    "same_as_before", "short_words", "long_words", "shouted_words", "marked_words", "lines_per_word", "equal_lines",
    "ending_lines",
)
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "spaces": (9, 10, 11, 12, 13, 32),
    "other_letters": range(128, 256), "stops": b".", "commas": b",;:", "marks": b"!?", "bars": b"|",
    "symbols": b"#*$%&<>@~^=+_\\", "other_punctuation": b"\"'()[]{}-/`",
}
_TABLE = np.zeros((256, len(_KINDS)))
for _k, _codes in enumerate(_KINDS.values()):
    _TABLE[list(_codes), _k] = 1


def _word_traits(word: bytes) -> int:
    """Length up to 255 and bits for words in capitals and words that hold a mark other than a last stop or comma."""
    bare = word.rstrip(b".,;:!?")
    letters = sum(65 <= b <= 90 for b in bare)
    shouted = len(bare) > 1 and letters == len(bare)
    marked = any(b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 for b in bare) or word.endswith((b"!", b"?"))
    return min(len(bare), 255) | shouted << 8 | marked << 9


def statistics(text: bytes) -> list[float]:
    """The features of one text; an empty one has zeros."""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text))), *[0.0] * (len(FEATURES) - 1)]
    n, m = len(text), len(words)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = histogram[histogram > 0] / n
    traits = once("word traits", 0, lambda: Memo(_word_traits))
    coded = np.fromiter(map(traits.__getitem__, words), np.int64, m)
    lengths = coded & 255
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(lengths.mean()),
        float(lengths.std()),
        *(histogram @ _TABLE / n).tolist(),
        float(-(share * np.log2(share)).sum()),
        len(counts) / m,
        max(counts.values()) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        float((coded >> 8 & 1).mean()),
        float((coded >> 9).mean()),
        len(lines) / m,
        1 - len(set(lines)) / len(lines),
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    ]


def features(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of each text as ``x``, with further columns."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            x = pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))
            return {c: batch.column(i) for i, c in enumerate(columns)} | {"x": x}

        return one

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "x array<double>"])
    return per_text(docs, (*columns, "text"), schema, make)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 20_000) -> Trees:
    """Fit on at most ``most_rows`` labelled documents (a bounded sample; their features come to the driver)."""
    sample = features(labelled_sample(docs, labels, label, most_rows), ("doc_id", "y")).orderBy("doc_id").toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array(sample.column("y").to_pylist(), float))


def score_quality(docs: DataFrame, model: Trees, key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``score`` of each whole text. Null counts as empty; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of small trees

    def make():
        model = shared.value

        def one(batch: pa.RecordBatch) -> dict:
            x = np.array([statistics(t) for t in texts_of(batch)])
            return {"doc_id": batch.column(0), "score": pa.array(model.probability(x))}

        return one

    rows = docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    return per_text(rows, ("doc_id", "text"), "doc_id long, score double", make)
