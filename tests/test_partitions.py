"""Tasks keep their share of the rows however large the tables are."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from panelwright import session
from panelwright.operators import edges, ranking
from panelwright.session import pinned

SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def links(spark, tmp_path):
    path = str(tmp_path / "links")
    spark.range(4000).select(
        (F.col("id") % 7).alias("owner"), (F.col("id") % 900).alias("item"), (2000 + F.col("id") % 5).cast("int").alias("year")
    ).write.parquet(path)
    return spark.read.parquet(path)


def tasks_of(frame):
    return len([p for p in frame.inputFiles() if os.path.basename(p.removeprefix("file:")).startswith("part-")])


def test_intermediates_are_made_in_partitions_by_the_size_of_the_tables(spark, links, monkeypatch):
    before = [spark.conf.get(c) for c in SETTINGS]
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 400)
    wanted = session.partitions_for(links)
    assert wanted > 2 * int(before[0])
    assert tasks_of(pinned(links.groupBy("item").count())) == wanted
    with pytest.raises(Exception, match="stopped"):
        pinned(links.groupBy("item").agg(F.raise_error(F.lit("stopped"))))
    assert [spark.conf.get(c) for c in SETTINGS] == before


def test_owner_productivity_is_the_same_in_many_partitions(spark, links, rows, monkeypatch):
    def made():
        return edges.owner_productivity(ranking.prior_count(links, "owner", "item", "year", "n"), "item", "n", "owner")

    few = rows(made())
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 400)
    many = made()
    assert tasks_of(many) > int(spark.conf.get(SETTINGS[0]))
    assert rows(many) == few


def test_a_ticker_is_scored_by_several_tasks(spark, rows, monkeypatch):
    from panelwright.operators import linking

    registry = linking.prepare_registry(
        spark.createDataFrame([(str(i), "aa", f"name {i} corp", "X") for i in range(200)], "cik string, ticker string, sec_name string, exchange string")
    )
    firms = spark.createDataFrame([(f"name {i}", "AA") for i in range(10)] + [("other", "")], "firm_name_norm string, ticker_hint string")
    whole = rows(linking._ticker_matches(firms, registry))
    monkeypatch.setattr(linking, "PAIRS_PER_TASK", 50)
    cut = linking._ticker_matches(firms, registry)
    assert cut.select(F.spark_partition_id()).distinct().count() > 10
    assert len(whole) == 2000 and rows(cut) == whole


def test_backbone_joins_intermediates_only(spark):
    from panelwright.plans import backbone

    def table(columns, *values):
        return spark.createDataFrame(list(values), ", ".join(f"{c} string" for c in columns.split()))

    out = backbone.build_backbone(
        backbone.BackboneInputs(
            static=table("patent_id appYear grantYear", ("a", "2000", "2002"), ("b", "2001", None), ("a", "1999", "2002")),
            core=table("patent_id patent_type patent_date patent_title num_claims", ("A", "utility", "2001-02-03", "t", "3")),
            abstracts=table("patent_id patent_abstract", ("a", "text"), ("c", "none")),
            assignees=table("patent_id assignee_sequence location_id", ("a", "1", "L1"), ("a", "2", "L2"), ("a", "3", "l2")),
            inventors=table("patent_id inventor_sequence location_id", ("b", "1", "L2")),
            locations=table("location_id disambig_country", ("l1", "de"), ("l2", "us")),
            classes=table("patent_id cpc_section cpc_subclass cpc_group", ("b", "G", "G06N", "G06N7/00")),
        )
    )
    assert out.inputFiles() and all("/pinned-" in f for f in out.inputFiles())
    found = {r["patent_id"]: r for r in out.collect()}
    assert set(found) == {"A", "B"}
    assert (found["A"]["app_year"], found["A"]["assignee_country_mode"], found["A"]["assignee_country_primary"]) == (1999, "US", "DE")
    assert (found["B"]["inventor_country_mode"], found["B"]["cpc_total_count"], found["B"]["patent_title"]) == ("US", 1, None)


def test_texts_are_matched_after_the_sample_is_chosen(spark, rows, tmp_path):
    from panelwright.bindings import learning as bound
    from panelwright.bindings.base import Tables
    from panelwright.operators import learning

    docs = [(i, f"Measured data and sensors {i}" if i % 3 else None, f"src{i % 4}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, None if i % 11 == 0 else int(i % 5 == 0)) for i in range(0, 300, 2)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    t = Tables(spark, str(tmp_path))
    sample = bound.training_sample(t)
    caps = {False: 120_000, True: 30_000}
    before = learning.balanced_sample(bound.labelled_features(t), "doc_id", "quality", "is_holdout", caps)
    assert sample.columns == before.columns and rows(sample) == rows(before) != []
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("LeftSemi", 1)
    assert "AS n_tokens" in above and "AS n_tokens" not in below
