"""Suffix-array style removal of long byte strings that an earlier document already has.

Fingerprints of growing length at sampled positions, in place of prefix doubling. Every 50-byte window owns one anchor, the least of its
24-byte hashes, so equal windows have equal anchors. Ranks are 64-bit names of prefixes, and a round keeps only positions
whose name occurs in more than one document:

1. names of 24 bytes at anchors, over the whole corpus;
2. names of the whole stretch of windows that an anchor owns: a stretch that an earlier document has whole is decided, and
   an anchor whose stretches are all equal needs no more;
3. names of 37 bytes to the right and to the left of the anchors left: every window needs one of the two;
4. names of the full 50-byte windows still left.

Names go to buckets of the name space, already reduced in their block of documents, so a passage that a third of all
documents share is one entry for each block. Each bucket sorts its names, finds the least document of each, and answers
the blocks with a bit for each name they sent. Blocks are bucketed once, so their texts are not shuffled again. Names are
hashes: two different strings of the last rounds meet with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .words import once, stored, texts_of

#: Bytes of an anchor; a longest possible one-sided extension halves the rest of the window.
ANCHOR = 24
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


class Powers:
    """Powers of the hash base modulo 2^64 and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            steps = np.full(2 * n, _BASE, U)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(steps)


class Bytes:
    """Names of substrings of one block, from prefix sums of a polynomial hash."""

    def __init__(self, data: bytes):
        self.n = len(data)
        self.powers = once("powers", 0, Powers)
        self.powers.upto(self.n + 1)
        terms = (np.frombuffer(data, np.uint8).astype(U) + U(1)) * self.powers.up[: self.n]
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(terms)])

    def names(self, start, length, salt: int) -> np.ndarray:
        """Names of the strings of the given lengths at the given starts; the salt keeps kinds of names apart."""
        return _mix((self.sums[start + length] - self.sums[start]) * self.powers.down[start] + U(salt))

    def all_names(self, length: int, salt: int) -> np.ndarray:
        m = max(0, self.n - length + 1)
        return _mix((self.sums[length : length + m] - self.sums[:m]) * self.powers.down[:m] + U(salt))


@dataclass
class Runs:
    """Stretches of windows that own the same anchor: their text, first and last start, and anchor."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray


def runs_of(data: Bytes, sizes: np.ndarray, usable: np.ndarray, window: int) -> Runs:
    """The stretches of all windows that lie within one usable text."""
    if data.n < window:
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, empty, empty)
    width = window - ANCHOR + 1
    # The hash decides, then the place, which is the same in equal windows.
    least = data.all_names(ANCHOR, 1) & U(0xFFFFFFFF00000000) | np.arange(data.n - ANCHOR + 1, dtype=U)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)
    at = np.arange(data.n - window + 1)
    owner = text[: len(at)]
    starts = np.flatnonzero((at + window <= end[owner]) & usable[owner])
    anchor = (least[starts] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return Runs(text[starts[first]], starts[first], starts[last], anchor[first])


def stretch(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the closed ranges in order, and the range of each."""
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[of], of


def joined(low: np.ndarray, high: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-open ranges of one text united where they touch; they must come in order of text and start."""
    if not len(low):
        return low, high, text
    reach = np.maximum.accumulate(high)
    new = np.flatnonzero(np.concatenate([[True], (low[1:] > reach[:-1]) | (text[1:] != text[:-1])]))
    return low[new], np.append(reach[new[1:] - 1], reach[-1]), text[new]


# Blocks travel as one row each: compressed bytes and the arrays that describe them.

BLOCK = "block long, ids binary, sizes binary, body binary"


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _batch(schema: T.StructType, rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


def each_block(frame: DataFrame, schema: str, step: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows that ``step`` makes of each block row."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            made = list(step(row))
            if made:
                yield _batch(kind, made)

    return frame.mapInArrow(run, schema)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The rows in blocks of about ``block_bytes`` of text; further columns travel along in ``rest``."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = BLOCK + ", rest binary"
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(batch.schema.get_field_index("doc_id"))
            start = total = 0
            for i, text in enumerate([*texts, b""]):
                if i > start and (i == len(texts) or total + len(text) > block_bytes):
                    sink = pa.BufferOutputStream()
                    if rest:
                        others = batch.slice(start, i - start).select(rest)
                        with pa.ipc.new_stream(sink, others.schema) as out:
                            out.write_batch(others)
                    own = ids.slice(start, i - start).to_pylist()
                    yield _batch(
                        kind,
                        [
                            {
                                "block": count,
                                "ids": np.array([NO_ID if d is None else d for d in own], np.int64).tobytes(),
                                "sizes": np.array([len(t) for t in texts[start:i]], np.int64).tobytes(),
                                "body": _packed(b"".join(texts[start:i])),
                                "rest": sink.getvalue().to_pybytes(),
                            }
                        ],
                    )
                    count, start, total = count + 1, i, 0
                total += len(text)

    return docs.mapInArrow(run, schema)


# One round: names of all blocks meet in buckets of the name space, and each block hears which of its names are shared.

NAMES = "bucket int, block long, names binary, kinds binary, docs binary, several binary"
ANSWER = "block long, bucket int, shared binary, least binary"
SHORT = U(0xFFFFFFFFFFFF0000)


@dataclass(frozen=True)
class Round:
    """Bytes sent of a name, of the kind that tells strings of one name apart, and of the document."""

    name: int
    kind: int = 0
    doc: int = 0


def _planes(x: np.ndarray, width: int) -> bytes:
    """64-bit numbers byte by byte, the bytes of equal weight together and only the upper ``width``: easy to compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[8 - width :]).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, 8 - width :] = planes.T
    return full.view(U).ravel()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    n = len(columns[0])
    out = np.ones(n, bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if n > 1 else False
    return out


class Sent:
    """A block's distinct pairs of name and kind in order, each with its least document, cut into buckets of names."""

    def __init__(self, names: np.ndarray, docs: np.ndarray, buckets: int, form: Round, kinds: np.ndarray | None = None):
        self.form = form
        kinds = np.zeros(len(names), U) if kinds is None else kinds
        # What is not sent must not tell pairs apart.
        names, kinds = (x & U((1 << 64) - (1 << (64 - 8 * w))) for x, w in ((names, form.name), (kinds, form.kind)))
        order = np.lexsort((docs, kinds, names))
        first = _new(names[order], kinds[order])
        new = np.flatnonzero(first)
        last = np.append(new[1:], len(names)) - 1 if len(new) else new
        self.names, self.kinds, self.least = names[order][new], kinds[order][new], docs[order][new]
        self.several = self.least != docs[order][last]
        self.place = np.empty(len(names), np.int64)
        self.place[order] = np.cumsum(first) - 1
        bucket = ((self.names >> U(32)) * U(buckets)) >> U(32)
        self.cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U)).tolist()

    def rows(self, block: int) -> Iterator[dict]:
        for b, (i, j) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if i < j:
                yield {
                    "bucket": b,
                    "block": block,
                    "names": _planes(self.names[i:j], self.form.name),
                    "kinds": _planes(self.kinds[i:j], self.form.kind),
                    "docs": _planes(self.least[i:j], self.form.doc),
                    "several": np.packbits(self.several[i:j]).tobytes(),
                }

    def heard(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence whether its name is shared, and the least document of its name and kind."""
        shared, least = np.zeros(len(self.names), bool), self.least.copy()
        for part in row.get("answer") or []:
            i, j = self.cuts[part["bucket"]], self.cuts[part["bucket"] + 1]
            shared[i:j] = np.unpackbits(np.frombuffer(part["shared"], np.uint8), count=j - i)
            if part["least"]:
                least[i:j] = _from_planes(part["least"], 8).view(np.int64)
        return shared[self.place], least[self.place]


def answers(names: DataFrame, form: Round) -> DataFrame:
    """For each block which of its names are shared, and the least document of each pair of name and kind.

    With kinds, a name is shared if it has several of them; without, if several documents have it.
    """
    schema = T._parse_datatype_string(ANSWER)

    def resolve(table: pa.Table) -> pa.Table:
        def column(name: str, width: int) -> np.ndarray:
            return np.concatenate([_from_planes(x, width) for x in table.column(name).to_pylist()])

        names = column("names", form.name)
        sizes = [len(x) // form.name for x in table.column("names").to_pylist()]
        ends = np.cumsum([0, *sizes]).tolist()
        kinds = column("kinds", form.kind) if form.kind else np.zeros(len(names), U)
        order = np.lexsort((kinds, names)) if form.kind else np.argsort(names, kind="stable")
        first, first_pair = _new(names[order]), _new(names[order], kinds[order])
        new, group = np.flatnonzero(first), np.cumsum(first) - 1
        least = None
        if form.kind:
            found = np.add.reduceat(first_pair, new, dtype=np.int64) > 1
        else:
            flags = zip(table.column("several").to_pylist(), sizes, strict=True)
            several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in flags])
            # Each block sends a name once.
            found = (np.maximum.reduceat(several[order], new) > 0) | (np.diff(np.append(new, len(names))) > 1)
        shared = np.empty(len(names), bool)
        shared[order] = found[group]
        if form.doc:
            docs = column("docs", form.doc).view(np.int64)
            low = np.minimum.reduceat(docs[order], np.flatnonzero(first_pair))
            least = np.empty(len(names), np.int64)
            least[order] = low[np.cumsum(first_pair) - 1]
        out, bucket = [], table.column("bucket")[0].as_py()
        for block, i, j in zip(table.column("block").to_pylist(), ends, ends[1:], strict=False):
            if shared[i:j].any() or form.doc:
                out.append(
                    {
                        "block": block,
                        "bucket": bucket,
                        "shared": np.packbits(shared[i:j]).tobytes(),
                        "least": _planes(least[i:j], 8) if form.doc else b"",
                    }
                )
        return pa.Table.from_batches([_batch(schema, out)])

    found = names.groupBy("bucket").applyInArrow(resolve, ANSWER)
    return found.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "least")).alias("answer"))


def remove_repeats(
    docs: DataFrame, window: int = 50, block_bytes: int = 1 << 19, bucket_bytes: int = 32 << 20, as_text: bool = False
) -> DataFrame:
    """The rows with ``kept`` (the bytes left) and ``spans`` (start and end of the runs removed) instead of ``text``.

    With ``as_text``, the rows with their ``text`` cut down instead; what is left of a character cut in two goes as well.

    A byte goes if a ``window``-byte string that covers it also starts in a document with a smaller ``doc_id``; strings
    are judged on the input. Matches never cross rows; rows that share a doc_id are not compared with each other. A null
    text is empty, a row without doc_id keeps its text. An empty table gives no rows. Further columns stay, except those
    named like a result.
    """
    if not as_text:
        docs = docs.drop("n_bytes", "kept", "spans")
    blocks = bucketed(blocks_of(docs, block_bytes))
    total = blocks.select(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(8, -(-3 * total // bucket_bytes))
    half = (window - ANCHOR) // 2
    long = ANCHOR + half

    def load(row: dict) -> tuple[Bytes, np.ndarray, Runs]:
        data, ids, sizes = Bytes(_unpacked(row["body"])), _ints(row["ids"]), _ints(row["sizes"])
        return data, ids, runs_of(data, sizes, ids != NO_ID, window)

    def cut(row: dict, runs: Runs, left: np.ndarray, **decided: bytes) -> Iterator[dict]:
        """The stretches left, as texts of their own; windows of neighbouring anchors follow each other without a gap."""
        ids, sizes, body = _ints(row["ids"]), _ints(row["sizes"]), _unpacked(row["body"])
        low, high, text = joined(runs.low[left], runs.high[left] + 1, runs.text[left])
        if not len(low) and not any(decided.values()):
            return
        places = (np.arange(len(ids)), np.zeros(len(ids), np.int64))
        texts, starts = (_ints(row["texts"]), _ints(row["starts"])) if "texts" in row else places
        spans = zip(low.tolist(), high.tolist(), strict=True)
        yield {
            "block": row["block"],
            "ids": ids[text].tobytes(),
            "sizes": (high - low + window - 1).tobytes(),
            "body": _packed(b"".join([body[a : b + window - 1] for a, b in spans])),
            "texts": texts[text].tobytes(),
            "starts": (starts[text] + low - (np.cumsum(sizes) - sizes)[text]).tobytes(),
            **decided,
        }

    def origin(row: dict, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of the block and the place there of places in a stretch."""
        sizes = _ints(row["sizes"])
        return _ints(row["texts"])[text], at + (_ints(row["starts"]) - (np.cumsum(sizes) - sizes))[text]

    def anchors(data: Bytes, ids: np.ndarray, runs: Runs) -> Sent:
        return Sent(data.names(runs.anchor, ANCHOR, 2), ids[runs.text], buckets, Round(6))

    def send_anchors(row: dict) -> Iterator[dict]:
        yield from anchors(*load(row)).rows(row["block"])

    def hear_anchors(row: dict) -> Iterator[dict]:
        data, ids, runs = load(row)
        yield from cut(row, runs, np.flatnonzero(anchors(data, ids, runs).heard(row)[0]))

    def stretches(data: Bytes, ids: np.ndarray, runs: Runs) -> Sent:
        """Names of anchors, their kinds being the whole stretches."""
        size = runs.high - runs.low + window
        whole = _mix(data.names(runs.low, size, 5) + (size * 256 + runs.anchor - runs.low).astype(U))
        return Sent(data.names(runs.anchor, ANCHOR, 6), ids[runs.text], buckets, Round(6, 6, 8), whole)

    def send_stretches(row: dict) -> Iterator[dict]:
        yield from stretches(*load(row)).rows(row["block"])

    def hear_stretches(row: dict) -> Iterator[dict]:
        data, ids, runs = load(row)
        shared, least = stretches(data, ids, runs).heard(row)
        gone = least < ids[runs.text]
        low, high, seg = joined(runs.low[gone], runs.high[gone] + window, runs.text[gone])
        text, start = origin(row, seg, low)
        decided = {"done": _packed(np.concatenate([text, start, high - low]).tobytes()) if len(low) else b""}
        yield from cut(row, runs, np.flatnonzero(~gone & shared), **decided)

    def sides(data: Bytes, ids: np.ndarray, runs: Runs) -> Sent:
        """Names to the right and to the left of the anchors; where a stretch is too short for one, no window needs it."""
        right = np.where(runs.high + window >= runs.anchor + long, runs.anchor, runs.low)
        left = np.where(runs.low <= runs.anchor - half, runs.anchor - half, runs.low)
        names = np.concatenate([data.names(right, long, 3), data.names(left, long, 4)])
        return Sent(names, np.tile(ids[runs.text], 2), buckets, Round(6))

    def send_sides(row: dict) -> Iterator[dict]:
        yield from sides(*load(row)).rows(row["block"])

    def hear_sides(row: dict) -> Iterator[dict]:
        data, ids, runs = load(row)
        right, left = np.split(sides(data, ids, runs).heard(row)[0], 2)
        at, of = stretch(runs.low, runs.high)
        before = runs.anchor[of] - at
        possible = np.flatnonzero((right[of] | (before > half)) & (left[of] | (before < half)))
        single = Runs(runs.text[of], at, at, at)
        yield from cut(row, single, possible, done=row["done"])

    def windows(row: dict) -> tuple[Sent, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of the stretches left: what is sent, and their documents, stretches and places."""
        data, ids, sizes = Bytes(_unpacked(row["body"])), _ints(row["ids"]), _ints(row["sizes"])
        start = np.cumsum(sizes) - sizes
        at, seg = stretch(start, start + sizes - window)
        return Sent(data.names(at, window, 7), ids[seg], buckets, Round(8, 0, 8)), ids[seg], seg, at

    def send_windows(row: dict) -> Iterator[dict]:
        yield from windows(row)[0].rows(row["block"])

    def hear_windows(row: dict) -> Iterator[dict]:
        sent, own, seg, at = windows(row)
        gone = sent.heard(row)[1] < own
        low, high, seg = joined(at[gone], at[gone] + window, seg[gone])
        text, start = origin(row, seg, low)
        size = high - low
        if row["done"]:
            done = _ints(_unpacked(row["done"])).reshape(3, -1)
            text, start, size = (np.concatenate(x) for x in zip(done, (text, start, size), strict=True))
        if not len(text):
            return
        # Texts are laid end to end for one pass over all ranges.
        apart = int((start + size).max()) + 1
        order = np.lexsort((start, text))
        text, start, size = text[order], start[order] + apart * text[order], size[order]
        low, high, text = joined(start, start + size, text)
        made = {"text": text, "start": low - apart * text, "end": high - apart * text}
        yield {"block": row["block"]} | {k: _packed(v.tobytes()) for k, v in made.items()}

    def heard(state: DataFrame, send, form: Round, how: str) -> DataFrame:
        """The state's blocks with the answers to what they send."""
        return state.join(answers(each_block(state, NAMES, send), form), "block", how)

    segments = BLOCK + ", texts binary, starts binary"
    texts = blocks.drop("rest")
    left = stored(each_block(heard(texts, send_anchors, Round(6), "inner"), segments, hear_anchors), "anchors")
    segments += ", done binary"
    left = stored(each_block(heard(left, send_stretches, Round(6, 6, 8), "left"), segments, hear_stretches), "stretches")
    left = stored(each_block(heard(left, send_sides, Round(6), "left"), segments, hear_sides), "windows")
    spans = "block long, text binary, start binary, end binary"
    removed = each_block(heard(left, send_windows, Round(8, 0, 8), "left"), spans, hear_windows)
    return _without(blocks.join(removed, "block", "left"), docs, as_text)


def bucketed(blocks: DataFrame) -> DataFrame:
    """Blocks as a table bucketed by their number, which later joins read without a shuffle."""
    spark = blocks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "blocks")
    name = "blocks_" + path.rpartition("-")[2]
    rows = blocks.repartition(n, "block").sortWithinPartitions("block")
    rows.write.bucketBy(n, "block").sortBy("block").option("path", path).saveAsTable(name)
    return spark.table(name)


def _without(blocks: DataFrame, docs: DataFrame, as_text: bool) -> DataFrame:
    """The rows of all blocks without their removed spans."""
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    found = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("spans", span),
    ]
    own = [T.StructField("text", T.StringType())] if as_text else found
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *rest, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for row in _rows(batches):
            body, ids, sizes = _unpacked(row["body"]), _ints(row["ids"]).tolist(), _ints(row["sizes"]).tolist()
            cuts: list[list] = [[] for _ in ids]
            if row["text"]:
                found = [_ints(_unpacked(row[c])).tolist() for c in ("text", "start", "end")]
                for t, a, b in zip(*found, strict=True):
                    cuts[t].append({"start": a, "end": b})
            kept, at = [], 0
            for n, gone in zip(sizes, cuts, strict=True):
                text, at = body[at : at + n], at + n
                edges = [0, *(x for c in gone for x in (c["start"], c["end"])), n]
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            columns = [pa.array([None if d == NO_ID else d for d in ids], pa.int64())]
            if rest:
                with pa.ipc.open_stream(row["rest"]) as stream:
                    columns += [c.combine_chunks() for c in stream.read_all().columns]
            if as_text:
                columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
            else:
                columns += [pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())]
                columns.append(pa.array(cuts, kind.field("spans").type))
            columns = [c.cast(f.type) for c, f in zip(columns, kind, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return blocks.mapInArrow(run, schema)
