"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside the tasks.

Each task loads the merge table into an in-process DuckDB. Distinct words become token-position rows; every step of the
recursion joins neighbouring tokens to the merge table and contracts one pair of each word, the leftmost of least rank,
until no word has a pair left. Decoding joins the tokens to the vocabulary and aggregates their bytes in order. Texts are
then put together from their words, so no text row leaves its task and nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import WordCache, once, per_text, texts_of

#: A word always ends before a space that a visible character follows, whatever the pattern makes of the rest.
CUT = re.compile(r" (?=\S)")
#: Words of one recursion, and the bytes beyond which all equal pairs of a word are contracted in one step.
WORDS_PER_QUERY = 40_000
#: Words and pieces kept from slice to slice, and bytes of text in a slice: they share a worker's memory.
CACHED_WORDS, CACHED_PIECES, SLICE_BYTES = 700_000, 400_000, 6 << 20
LONG_WORD = 64

ONE_PAIR = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 1 AS len, 0 AS k FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT a.*, b.len AS more, m.merged
     FROM step a LEFT JOIN step b ON b.pos = a.pos + a.len AND b.w = a.w
     LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 32) | b.tok),
   best AS (
     SELECT w, min((merged::BIGINT << 32) | pos) AS pick, arg_min(len, (merged::BIGINT << 32) | pos) AS len
     FROM pairs WHERE merged IS NOT NULL GROUP BY w)
   SELECT p.w, p.pos, CASE WHEN p.pos = (b.pick & 4294967295) THEN p.merged ELSE p.tok END,
          CASE WHEN p.pos = (b.pick & 4294967295) THEN p.len + p.more ELSE p.len END, p.k + 1
   FROM pairs p JOIN best b ON p.w = b.w
   WHERE p.pos <> (b.pick & 4294967295) + b.len))
"""
#: The same with all places of the pair of least rank at once, each other one in a run that overlaps itself.
EQUAL_PAIRS = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 0 AS k FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT w, pos, tok, k, lead(tok) OVER s AS follower, row_number() OVER s AS nth
     FROM step WINDOW s AS (PARTITION BY w ORDER BY pos)),
   ranked AS (
     SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY w) AS least
     FROM pairs p LEFT JOIN merges m ON m.pair = (p.tok::BIGINT << 32) | p.follower),
   hits AS (
     SELECT *, coalesce(merged = least, false) AS hit FROM ranked WHERE least IS NOT NULL),
   runs AS (
     SELECT *, nth - row_number() OVER (PARTITION BY w, hit ORDER BY nth) AS run FROM hits),
   picks AS (
     SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY nth) % 2 = 1 AS pick FROM runs),
   kept AS (
     SELECT *, lag(pick) OVER (PARTITION BY w ORDER BY nth) AS swallowed FROM picks)
   SELECT w, pos, CASE WHEN pick THEN merged ELSE tok END, k + 1 FROM kept WHERE NOT coalesce(swallowed, false)))
"""
LAST_STEP = """
SELECT s.w, s.pos, s.tok FROM step s JOIN (SELECT w, max(k) AS k FROM step GROUP BY w) l ON l.w = s.w AND l.k = s.k
ORDER BY s.pos
"""
DECODE = """
SELECT string_agg(v.shown, '' ORDER BY c.pos) FROM coded c JOIN vocabulary v ON v.tok = c.tok GROUP BY c.w ORDER BY c.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class ByteMerges:
    """A rank file as DuckDB tables, with cached results for words and for the pieces between spaces."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(path)
        joins = [
            ((ranks[t[:i]] << 32) | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        pair, merged = zip(*joins, strict=True) if joins else ((), ())
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self._load("merges", pair=pa.array(pair, pa.int64()), merged=pa.array(merged, pa.int32()))
        self._load("vocabulary", tok=pa.array(ranks.values(), pa.int32()), shown=pa.array([t.hex() for t in ranks]))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.tokens = WordCache(self._encode, CACHED_WORDS)
        self.spaced = WordCache(lambda pieces: self._pieces([" " + p for p in pieces]), CACHED_PIECES)

    def _load(self, name: str, **columns: pa.Array) -> None:
        self.con.register("arriving", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arriving")
        self.con.unregister("arriving")

    def _encode(self, words: list[str]) -> Iterable[tuple[bytes, bytes]]:
        coded = [w.encode() for w in words]
        out: list = [None] * len(coded)
        for long in (False, True):
            at = [i for i, b in enumerate(coded) if (len(b) > LONG_WORD) == long]
            for k in range(0, len(at), WORDS_PER_QUERY):
                some = at[k : k + WORDS_PER_QUERY]
                for i, value in zip(some, self._query([coded[i] for i in some], long), strict=True):
                    out[i] = value
        return out

    def _query(self, words: list[bytes], long: bool) -> Iterable[tuple[bytes, bytes]]:
        sizes = np.array([len(b) for b in words], np.int32)
        self._load(
            "start",
            w=pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
            pos=pa.array(np.arange(sizes.sum(), dtype=np.int32)),
            tok=pa.array(self.single[np.frombuffer(b"".join(words), np.uint8)]),
        )
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE coded AS {EQUAL_PAIRS if long else ONE_PAIR}{LAST_STEP}")
        coded = self.con.execute("SELECT w, tok FROM coded").fetchnumpy()
        flat = coded["tok"].astype("<i4").tobytes()
        ends = (4 * np.searchsorted(coded["w"], np.arange(len(words) + 1))).tolist()
        decoded = self.con.execute(DECODE).fetchall()
        return ((flat[a:b], bytes.fromhex(d)) for a, b, (d,) in zip(ends, ends[1:], decoded, strict=False))

    def _pieces(self, pieces: list[str]) -> Iterable[tuple[bytes, bytes]]:
        split = [self.split(p) for p in pieces]
        self.tokens.learn(set().union(*split))
        for tokens in split:
            if len(tokens) == 1:
                yield self.tokens[tokens[0]]
            else:
                found = [self.tokens[t] for t in tokens]
                yield b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def encode(self, texts: list[str]) -> Iterable[tuple[bytes, bytes]]:
        """Token ids (little-endian 32-bit) and their decoded bytes, for each text."""
        cut = [CUT.split(t) for t in texts]
        first = list(self._pieces([c.pop(0) for c in cut]))
        self.spaced.learn(set().union(*cut))
        get = self.spaced.__getitem__
        for head, rest in zip(first, cut, strict=True):
            found = [head, *map(get, rest)]
            yield b"".join([f[0] for f in found]), b"".join([f[1] for f in found])


def lists_of(coded: list[bytes]) -> pa.ListArray:
    """Concatenated little-endian 32-bit integers as lists."""
    ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes of each text, without special tokens.

    Null and empty texts have no ids. Repeated keys keep their rows; an empty table gives none; other columns are not read.
    """

    def make():
        merges = once("byte merges", (ranks, pattern), lambda: ByteMerges(ranks, pattern))

        def one(batch: pa.RecordBatch) -> dict:
            found = list(merges.encode([t.decode() for t in texts_of(batch)]))
            return {
                "doc_id": batch.column(0),
                "ids": lists_of([f[0] for f in found]),
                "decoded": pa.array([f[1] for f in found], pa.binary()),
            }

        return one

    rows = docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    return per_text(rows, ("doc_id", "text"), "doc_id long, ids array<int>, decoded binary", make, SLICE_BYTES)
