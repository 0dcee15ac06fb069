"""Token counts of texts under a unigram model, by one dynamic program over a trie of words.

The best segmentation of a prefix does not depend on what follows, so words that share a prefix share its forward scores:
each word is inserted in a trie, a forward score is computed once for every new node, and the node where a word ends
holds its token count. Pieces and their order come from a public vocabulary; a piece's log probability follows from its
place there (Zipf's law), so nothing is trained.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Memo, once, per_text, texts_of

WORD_START = "▁"
#: Nodes after which a worker starts a new trie; bounds memory, changes no result.
TRIE_NODES = 600_000


def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """Log probabilities of the ordinary pieces of a SentencePiece file, and that of a character it lacks, for each byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    total = sum(1 / (r + 1) for r in range(model.get_piece_size()))
    scores, byte = {}, 0.0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        score = -math.log((i + 1) * total)
        if model.is_byte(i):
            byte = min(byte, score)
        else:
            scores[model.id_to_piece(i)] = score
    # Bytes are a last resort: each costs as much as the rarest piece and more.
    return scores, min(byte, min(scores.values())) - 10.0


class ForwardTrie:
    """Nodes are prefixes; each keeps its score and token count. ``children`` has the way from a node by a character."""

    def __init__(self, path: str):
        self.pieces, self.byte = piece_scores(path)
        self.longest = max(map(len, self.pieces))
        self.counts = Memo(self.count)
        self._start()

    def _start(self) -> None:
        self.children, self.score, self.tokens = {}, [0.0], [0]

    def count(self, word: bytes) -> int:
        """Tokens on the best path of a word; of equal scores the one with fewer tokens."""
        if len(self.score) > TRIE_NODES:
            self._start()
        text = WORD_START + word.decode()
        path = [0]
        for end, ch in enumerate(text, 1):
            child = self.children.get((path[-1] << 21) | ord(ch))
            if child is None:
                child = self._grow(text, end, ch, path)
            path.append(child)
        return self.tokens[path[-1]]

    def _grow(self, text: str, end: int, ch: str, path: list[int]) -> int:
        n = len(ch.encode())
        best = (self.score[path[-1]] + n * self.byte, -(self.tokens[path[-1]] + n))
        for start in range(max(0, end - self.longest), end):
            piece = self.pieces.get(text[start:end])
            if piece is not None:
                node = path[start]
                best = max(best, (self.score[node] + piece, -(self.tokens[node] + 1)))
        child = len(self.score)
        self.children[(path[-1] << 21) | ord(ch)] = child
        self.score.append(best[0])
        self.tokens.append(-best[1])
        return child


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of each whole text, words being parted by white space.

    Null, empty and blank texts have no words and no tokens. Repeated keys keep their rows; an empty table gives none.
    """

    def make():
        trie = once("forward trie", vocabulary, lambda: ForwardTrie(vocabulary))

        def one(batch: pa.RecordBatch) -> dict:
            get = trie.counts.__getitem__
            words = [t.split() for t in texts_of(batch)]
            return {
                "doc_id": batch.column(0),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_tokens": pa.array([sum(map(get, w)) for w in words], pa.int64()),
            }

        return one

    rows = docs.selectExpr(f"cast(`{key}` AS BIGINT) AS doc_id", "cast(text AS STRING) AS text")
    return per_text(rows, ("doc_id", "text"), "doc_id long, n_words long, n_tokens long", make)
