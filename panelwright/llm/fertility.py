"""Quality rules from tokeniser fertility: how a public vocabulary takes a text apart.

For each whole text: characters per token, the share of tokens that are single-byte fallbacks, and the entropy of its
tokens, under a SentencePiece vocabulary with byte fallback. Texts outside the band of their language (else of their
script) are rejected, as are texts that fail the base rules on length and repeated three-word windows. Where labelled rows
allow it, a joint floor for characters per token and entropy is fitted on clean texts of the language or script as well.
"""

from __future__ import annotations

from array import array
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import labelled_sample
from .words import beside, once, per_text, texts_of

SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
CACHED_WORDS = 300_000
#: Scripts by the lead bytes of their UTF-8 letters (first and last byte); an approximation that is cheap on bytes.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)),
    "greek": ((0xCE, 0xCF),),
    "cyrillic": ((0xD0, 0xD3),),
    "hebrew": ((0xD6, 0xD7),),
    "arabic": ((0xD8, 0xDB),),
    "indic": ((0xE0, 0xE0),),
    "cjk": ((0xE3, 0xE9),),
    "hangul": ((0xEA, 0xED),),
}


@dataclass(frozen=True)
class Band:
    """Accepted ranges: characters per token, at most a share of byte tokens, and least entropy in bits."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Bands by language or script; "" holds for whatever has none of its own.
BANDS: dict[str, Band] = {
    "en": Band(1.75, 7.0, 0.05, 4.5),
    "de": Band(1.85, 7.0, 0.05, 4.5),
    "fr": Band(1.50, 7.0, 0.05, 4.5),
    "es": Band(1.65, 7.0, 0.05, 4.5),
    "latin": Band(1.4, 7.0, 0.10, 4.5),
    "greek": Band(0.6, 4.0, 0.30, 3.0),
    "cyrillic": Band(1.0, 6.0, 0.20, 3.5),
    "cjk": Band(0.3, 2.5, 0.95, 3.0),
    "": Band(0.2, 8.0, 1.0, 3.0),
}


@dataclass(frozen=True)
class Floor:
    """Least weighted sum of two deviations from clean texts, in standard deviations: characters per token and entropy.

    Entropy grows with the number of tokens, so it is compared with a parabola over the logarithm of that number, which is
    held within the range that was fitted.
    """

    chars: tuple[float, float]  # mean and deviation
    curve: tuple[float, float, float]
    range: tuple[float, float]
    entropy: float  # deviation from the curve
    weights: tuple[float, float]
    least: float


#: The share of clean texts that a fitted floor may cut, and the height in deviations above which no floor rises.
CLEAN_CUT, HIGHEST_FLOOR = 0.002, -3.5


class Fertility:
    """Tokens of words under one vocabulary, cached by word; the cache starts anew between batches when full."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.tokens, self.bytes = array("i"), array("i")

    def learn(self, words: set[bytes]) -> None:
        if len(self.index) > CACHED_WORDS:
            self.reset()
        new = [w for w in words if w not in self.index]
        for k in range(0, len(new), 10_000):
            some = new[k : k + 10_000]
            coded = self.model.encode([w.decode() for w in some], num_threads=1)
            sizes = np.array([len(ids) for ids in coded])
            flat = np.fromiter((i for ids in coded for i in ids), np.uint32, sizes.sum())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            fallbacks = np.concatenate([[0], np.cumsum(self.is_byte[flat])])[ends]
            self.tokens.extend(sizes.tolist())
            self.bytes.extend(np.diff(fallbacks).tolist())
            stops, raw = (4 * ends).tolist(), flat.tobytes()
            for w, start, stop in zip(some, stops, stops[1:], strict=False):
                self.index[w] = len(self.ids)
                self.ids.append(raw[start:stop])


def repeated_words(at: np.ndarray) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(at) < 4:
        return 0
    _, pair = np.unique(at[:-1] * (1 << 31) + at[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * (1 << 31) + at[2:], return_inverse=True, return_counts=True)
    twice = n[window] > 1
    covered = np.zeros(len(at), bool)
    for k in range(3):
        covered[k : len(at) - 2 + k] |= twice
    return int(covered.sum())


def script_of(text: bytes) -> str:
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    found = {s: sum(int(n[a : b + 1].sum()) for a, b in ranges) for s, ranges in SCRIPTS.items()}
    best = max(found, key=found.get)
    return best if found[best] else ""


def _measuring(vocabulary: str):
    """What a task needs to measure batches of (doc_id, text, lang)."""

    def make():
        state = once("fertility", vocabulary, lambda: Fertility(vocabulary))

        def one(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            split = [t.split() for t in texts]
            state.learn(set().union(*split))
            tokens, byte = np.array(state.tokens, np.int64), np.array(state.bytes, np.int64)
            get, out = state.index.__getitem__, []
            for text, words in zip(texts, split, strict=True):
                at = np.fromiter(map(get, words), np.int64, len(words))
                lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
                n_tokens, entropy = int(tokens[at].sum()), 0.0
                if n_tokens:
                    ids = np.frombuffer(b"".join([state.ids[i] for i in at.tolist()]), np.uint32)
                    share = np.unique(ids, return_counts=True)[1] / n_tokens
                    entropy = float(-(share * np.log2(share)).sum())
                out.append(
                    (
                        len(words),
                        len(text.decode()) - (len(text) - len(text.translate(None, SPACES))),
                        len(text) - len(text.translate(None, SYMBOLS)),
                        len(lines) - len(set(lines)),
                        repeated_words(at),
                        n_tokens,
                        int(byte[at].sum()),
                        entropy,
                        script_of(text),
                    )
                )
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return {"doc_id": batch.column(0), "lang": batch.column(2)} | dict(zip(NAMES, columns, strict=True))

        return one

    return make


NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_tokens", "n_byte_tokens", "entropy", "script",
)


SCHEMA = "doc_id long, lang string, " + ", ".join(f"{n} long" for n in NAMES[:7]) + ", entropy double, script string"


def _inputs(docs: DataFrame, key: str) -> list[str]:
    lang = "cast(lang AS STRING)" if "lang" in docs.columns else "cast(NULL AS STRING)"
    return [f"cast(`{key}` AS BIGINT)", "cast(text AS STRING)", lang]


def measures(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """The base counts, ``n_tokens``, ``n_byte_tokens``, ``entropy`` and ``script`` of each whole text, and its ``lang``.

    Words are runs without ASCII white space. Null and empty texts count as having no words. Rows that share a key keep
    their own; an empty table gives no rows; other columns are not read.
    """
    names = ("doc_id", "text", "lang")
    rows = docs.selectExpr(*[f"{e} AS {n}" for e, n in zip(_inputs(docs, key), names, strict=True)])
    return per_text(rows, names, SCHEMA, _measuring(vocabulary))


def base_failed(at: str = "") -> Column:
    words = F.col(f"{at}n_words")
    return (words < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * words)


def in_band(bands: Mapping[str, Band], at: str = "") -> Column:
    """Whether the measured columns lie in the band of ``lang``, else of ``script``, else of ""."""
    tokens = F.col(f"{at}n_tokens")
    verdict = F.lit(False)
    for by in ("", "script", "lang"):
        for name, b in bands.items():
            if bool(name) == bool(by):
                inside = (
                    (F.col(f"{at}word_chars") / tokens).between(b.least_chars, b.most_chars)
                    & (F.col(f"{at}n_byte_tokens") <= b.most_bytes * tokens)
                    & (F.col(f"{at}entropy") >= b.least_entropy)
                )
                verdict = F.when(F.col(f"{at}{by}") == name, inside).otherwise(verdict) if by else inside
    # Texts without tokens have failed the base rules before.
    return F.coalesce(F.when(tokens > 0, verdict), F.lit(False))


def _floor(chars: np.ndarray, tokens: np.ndarray, entropy: np.ndarray, clean: np.ndarray) -> Floor:
    """The floor from the clean rows; the other rows only set the weights of the two deviations."""
    size = np.log2(tokens)
    low, high = float(size[clean].min()), float(size[clean].max())
    powers = np.vander(size.clip(low, high), 3, increasing=True)
    curve = np.linalg.lstsq(powers[clean], entropy[clean], rcond=None)[0]
    x = np.column_stack([chars, entropy - powers @ curve])
    mean, sd = x[clean].mean(axis=0), x[clean].std(axis=0) + 1e-3
    z = (x - mean) / sd
    spread = np.cov(z[clean].T) + 1e-3 * np.eye(2)
    weights = np.ones(2)
    if (~clean).sum() >= 5:
        found = np.linalg.solve(spread, -z[~clean].mean(axis=0)).clip(0)
        weights = found if found.any() else weights
    weights = weights / np.sqrt(weights @ spread @ weights)
    least = min(float(np.quantile(z[clean] @ weights, CLEAN_CUT)), HIGHEST_FLOOR)
    return Floor(
        (float(mean[0]), float(sd[0])), tuple(curve.tolist()), (low, high), float(sd[1]), tuple(weights.tolist()), least
    )


def fit_floors(
    docs: DataFrame, labels: DataFrame, vocabulary: str, most_rows: int = 20_000, least_clean: int = 30, key: str = "doc_id"
) -> dict[tuple[str, str], Floor]:
    """Floors by ("lang", language) and ("script", script), from at most ``most_rows`` labelled documents.

    Their measures come to the driver. Rows that fail the base rules do not count. A language or script with fewer than
    ``least_clean`` clean rows gets no floor; its texts go by the script, else by the bands alone.
    """
    lang = ("lang",) if "lang" in docs.columns else ()
    sample = labelled_sample(docs, labels, "quality", most_rows, key, lang)
    found = beside(sample, _inputs(sample, key), SCHEMA, _measuring(vocabulary), "_fertility").select("y", "_fertility.*")
    rows = found.where(~base_failed() & (F.col("n_tokens") > 0)).orderBy("doc_id").toArrow()
    column = {n: rows.column(n).to_numpy() for n in ("y", "word_chars", "n_tokens", "entropy")}
    chars, clean = column["word_chars"] / column["n_tokens"], column["y"] == 1
    floors = {}
    for by in ("lang", "script"):
        names = rows.column(by).to_pylist()
        for name in sorted({n for n in names if n}):
            at = np.array([n == name for n in names])
            if clean[at].sum() >= least_clean:
                floors[by, name] = _floor(chars[at], column["n_tokens"][at], column["entropy"][at], clean[at])
    return floors


def above_floor(floors: Mapping[tuple[str, str], Floor], at: str = "") -> Column:
    """Whether the measured columns reach the floor of ``lang``, else of ``script``; true where neither has one."""
    tokens = F.col(f"{at}n_tokens")
    verdict = F.lit(True)
    for by in ("script", "lang"):
        for (of, name), f in floors.items():
            if of == by:
                size = F.least(F.greatest(F.log2(tokens), F.lit(f.range[0])), F.lit(f.range[1]))
                usual = f.curve[0] + size * f.curve[1] + size * size * f.curve[2]
                score = (F.col(f"{at}word_chars") / tokens - f.chars[0]) * (f.weights[0] / f.chars[1])
                score += (F.col(f"{at}entropy") - usual) * (f.weights[1] / f.entropy)
                verdict = F.when(F.col(f"{at}{by}") == name, score >= f.least).otherwise(verdict)
    return F.coalesce(F.when(tokens > 0, verdict), F.lit(False))


def judge(
    docs: DataFrame,
    vocabulary: str,
    bands: Mapping[str, Band] = BANDS,
    key: str = "doc_id",
    floors: Mapping[tuple[str, str], Floor] | None = None,
) -> DataFrame:
    """Measures with ``base_failed`` and ``kept``."""
    rows = measures(docs, vocabulary, key).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & in_band(bands) & above_floor(floors or {}))


def accepted(
    docs: DataFrame,
    vocabulary: str,
    bands: Mapping[str, Band] = BANDS,
    key: str = "doc_id",
    floors: Mapping[tuple[str, str], Floor] | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    found = beside(docs, _inputs(docs, key), SCHEMA, _measuring(vocabulary), "_fertility")
    good = ~base_failed("_fertility.") & in_band(bands, "_fertility.") & above_floor(floors or {}, "_fertility.")
    return found.where(good).select(*docs.columns)
