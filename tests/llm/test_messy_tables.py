"""Nulls in every column, repeated rows, long and empty texts, and columns named like results."""

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")

from panelwright.llm import bpe, counts, fertility, language, near, nearest, packing, quality, repeats, toxicity  # noqa: E402

CLASHING = (
    "ids decoded n_tokens n_words entropy base_failed kept lang_pred score n_shingles component_id class sig label key block "
    "spans n_bytes piece start length x y"
).split()


@pytest.fixture(scope="module")
def messy(spark):
    long = " ".join(f"word{i % 977} and the {i}" for i in range(30_000))
    rows = [(1, "a plain text of some words", "en"), (None, "a text without a key", None), (2, None, "en"), (3, "", None)]
    rows += [(4, long, "en"), (5, long, "en"), (1, "a plain text of some words", "en"), (6, " \n ", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


def results(messy, labels):
    byte, word, piece = (public.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
    yield bpe.encode_and_decode(messy, byte, public.PATTERN).select("doc_id", F.size("ids"))
    yield fertility.judge(messy, piece).select("doc_id", "n_words", "kept")
    yield counts.token_counts(messy, piece)
    yield language.predict_languages(messy, language.fit_languages(messy, ~language.held_out()))
    yield near.near_duplicates(messy, 4, 80)
    yield repeats.remove_repeats(messy).select("doc_id", "n_bytes", F.length("kept"))
    yield quality.score_quality(messy, quality.fit_quality(messy, labels))
    yield toxicity.score_toxicity(messy, toxicity.fit_toxicity(messy, labels))
    yield packing.pack_documents(messy, word).where("piece = 0").select("doc_id", "start")


def test_every_row_gets_one_result_and_reruns_agree(messy, labels):
    ids = sorted(str(r[0]) for r in messy.select("doc_id").collect())
    for first, again in zip(results(messy, labels), results(messy, labels), strict=True):
        rows = sorted(map(str, first.collect()))
        assert len(rows) == 9 and rows == sorted(map(str, again.collect()))
        assert sorted(str(r["doc_id"]) for r in first.collect()) == ids


def test_copies_without_and_with_keys(messy):
    found = {(r["doc_id"], r["n_shingles"]): r for r in near.near_duplicates(messy, 4, 80).collect()}
    long = max(n for _, n in found)
    assert found[5, long]["component_id"] == 4 and found[4, long]["kept"] and not found[5, long]["kept"]
    assert found[None, 0]["component_id"] is None and not found[None, 0]["kept"]
    assert found[2, 0]["component_id"] == 2 and found[2, 0]["kept"]
    left = {(r["doc_id"], r["n_bytes"]): len(r["kept"]) for r in repeats.remove_repeats(messy).collect()}
    size = max(n for _, n in left)
    assert left[4, size] == size and left[5, size] == 0


def test_filters_keep_clashing_columns(messy):
    kept = fertility.accepted(messy, public.path("piece_bpe_32k.model"))
    assert kept.columns == messy.columns
    model = language.fit_languages(messy, ~language.held_out())
    assert language.recognised(messy, model).columns == messy.columns
    assert repeats.remove_repeats(messy, as_text=True).select(*messy.columns).count() == 9


def test_vectors_of_all_kinds(spark):
    rows = [(i, [1.0, float(i), 0.5]) for i in range(45)] + [(None, [1.0, 2.0, 3.0]), (60, None), (61, []), (62, [0.0, 0.0, 0.0])]
    rows += [(63, [1.0, None, 2.0]), (64, [float("inf"), 1.0, 1.0]), (0, [1.0, 0.0, 0.5]), (80, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "v", "block")})
    got = nearest.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == [44, 43, 42, 41, 40, 39, 38, 37, 36, 35, 34, 33, 32, 31, 30, 29, 28, 27, 26, 25]
