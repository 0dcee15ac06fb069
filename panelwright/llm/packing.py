"""Best-fit packing of tokenised documents into sequences of a fixed length.

A bounded-space online best-fit: each task keeps at most ``open_bins`` open sequences in a bitset keyed by free space.
A piece goes to the open sequence with the least free space that holds it; when none does and all places are taken,
the fullest open sequence closes. No shuffle is needed, so a skewed column cannot matter, and a task that is run again
gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .words import CACHE_ENTRIES, Memo, once, pieces_of, texts_of

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Words of these characters split alike in lower case here and in the tokenizer; any other word is left to it whole.
PLAIN = re.compile(r"[\x21-\x7eÀ-įı-ſ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class BestFit:
    """Open bins by free space; the k-th bit of ``free`` says that some open bin has k places left."""

    def __init__(self, capacity: int, open_bins: int, first: int):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.free, self.bins, self.open = 0, {}, 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        bin_id = stack.pop()
        if not stack:
            self.free ^= 1 << space
        self.open -= 1
        return bin_id

    def _put(self, space: int, bin_id: int) -> None:
        if space:
            self.bins.setdefault(space, []).append(bin_id)
            self.free |= 1 << space
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, bin_id = self.capacity, self.next
            self.next += 1
        self._put(space - length, bin_id)
        return bin_id, self.capacity - space


class WordIds:
    """Token ids of white-space separated words, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.parts = Memo(self._part, 2 * CACHE_ENTRIES)
        self.words = Memo(self._word)
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        if PLAIN.fullmatch(part):
            model = self.tokenizer.model
            ids = [t.id for t in model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not PLAIN.fullmatch(text):
            return self.parts[text]
        return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 512, end_id: int = 0, key: str = "doc_id"
) -> DataFrame:
    """One row per piece: its document, its place in the document, its sequence and its offset there.

    A null or empty text is one piece that holds only the end id. Rows that share a key are packed as documents of
    their own. An empty table gives no rows; other columns are not read.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = once("word ids", tokenizer, lambda: WordIds(tokenizer))
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in pieces_of(batch):
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    coded = ids.encode(text) + end
                    for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                        cut = coded[at : at + 4 * capacity]
                        seq, offset = bins.place(len(cut) // 4)
                        out.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), seq, offset))
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text").mapInArrow(run, SCHEMA)
