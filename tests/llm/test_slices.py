"""Batches of text are cut and gathered so that memory and the number of queries stay bounded."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import functions as F

from panelwright.llm.bpe import ByteMerges
from panelwright.llm.words import beside


def test_words_of_a_slice_go_into_one_recursion(tmp_path):
    path = tmp_path / "ranks"
    tokens = [*(bytes([b]) for b in range(256)), b"ab", b"abc"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    merges, sizes = ByteMerges(str(path), r"\S+|\s+"), []
    query = merges._query
    merges._query = lambda words, long: sizes.append(len(words)) or query(words, long)
    text = " ".join(f"abc{i}" for i in range(30_000))
    (ids, decoded), = merges.encode([text])
    assert decoded.decode() == text and ids[:4] == (257).to_bytes(4, "little")
    assert max(sizes) > 20_000


def test_texts_kept_beside_their_measures_come_in_slices_of_two_megabytes(spark):
    docs = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            return {"rows": pa.array([batch.num_rows] * batch.num_rows, pa.int64())}

        return one

    found = beside(docs, ["id", "text"], "rows long", make, "_n")
    assert found.count() == 60
    assert found.agg(F.max("_n.rows")).first()[0] <= 2 * 2**20 // 100_000 + 1
