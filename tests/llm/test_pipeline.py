"""The pipeline stage by stage on a small table."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    en = ["river", "stone", "walks", "along", "green", "valley", "under", "bright", "morning", "light", "the", "and", "quietly"]
    de = ["Fluss", "Stein", "geht", "entlang", "grünes", "Tal", "unter", "hellem", "Morgen", "Licht", "der", "und", "leise"]

    def prose(words):
        return " ".join(r.choice(words) + r.choice(["", "", "er", "ly", "ung", "ab", "ko", "mi"]) for _ in range(150))

    rows = [(i, prose((en, de)[i % 2]), ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " mehr", "de")]  # an exact and a near copy
    rows += [(102, "too short", "en"), (103, "For " * 200, "en"), (104, None, None), (105, "12 34 " * 60, "en")]
    rows += [(106, prose(en) + "\n" + rows[2][1][:400], "en")]  # a passage of document 2
    df = spark.createDataFrame([(i, t, x, "src0", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = tmp_path_factory.mktemp("corpus")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_keep_clean_documents_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "language_id", "minhash_near_dedup", "suffix_dedup", "best_fit_packing",
    ]
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        left.append({x["doc_id"]: x for x in docs.collect()})
    assert set(left[0]) == {*range(60), 100, 101, 106}
    assert set(left[1]) == set(left[0])
    assert set(left[2]) == {*range(60), 106}
    assert set(left[3]) == set(left[2])
    before, after = left[2][106]["text"], left[3][106]["text"]
    assert len(after) < len(before) - 300 and left[3][106]["n_chars"] == len(after)


def test_run_packs_what_the_stages_leave(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    per_bin = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per_bin.where("n <> end OR n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == 61


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(
        {"n_words": F.lit("x"), "score": F.lit(1.5), "block": F.lit(None).cast("int"), "kept": F.array(F.lit(1)), "class": F.lit("c")}
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        assert out.count() > 50
