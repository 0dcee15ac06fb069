import json
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import aggregates
from panelwright.sources import payloads, tables
from panelwright.streaming import incremental


def test_full_file_or_tranches(spark, tmp_path):
    head = "patent_id,appYear,gvkeyUO,gvkeyFR,clean_name,privateSubsidiary,grantYear,cnLink_y1\n"
    (tmp_path / "staticTranche1.csv").write_text(head + '7,2000,001000,001000,"ACME, Inc",0,2001.0,1\n8,,001000,x,A,0,2001,1\n')
    (tmp_path / "staticTranche2.csv").write_text(head + "9,2001,,x,A,0,2001,1\n10,2002,002,x,A,1,,1\n")
    got = sorted(tuple(r) for r in tables.scan_tranches(spark, str(tmp_path)).select("patent_id", "appYear", "gvkeyUO", "clean_name", "grantYear").collect())
    assert got == [("10", 2002, "002", "A", None), ("7", 2000, "001000", "ACME, Inc", 2001)]
    (tmp_path / "static.csv").write_text(head + "1,1999,003,x,A,0,2000,1\n")
    assert tables.scan_tranches(spark, str(tmp_path)).count() == 1
    assert tables.scan_tranches(spark, str(tmp_path), prefer="parts").count() == 2
    counts = tables.combine_tranches(spark, tables.discover_tranches(spark, str(tmp_path), prefer="parts"), str(tmp_path / "all"), "csv.gz")
    assert counts == {"files": 2, "rows": 4}
    with pytest.raises(FileNotFoundError):
        tables.discover_tranches(spark, str(tmp_path / "all"))


def test_quoted_tsv_is_bound_by_name(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('"extra"\t"patent_id"\t"title"\n1\t" d123 "\t"say ""hi"""\n2\t"E9"\tno\n')
    universe = spark.createDataFrame([("D123",)], "patent_id string")
    got = tables.scan_tsv_filtered(spark, str(path), ["patent_id", "title"], universe, "patent_id").collect()
    assert [tuple(r) for r in got] == [("D123", "say \"hi")]


def test_unknown_delimiter_and_line_breaks(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text('Code;Level;Note\nNA;"Loi ";"two\nlines, one; cell"\nFR;Loi;x\n', encoding="utf-8")
    got = sorted(tuple(r) for r in tables.normalize_delimited(spark, str(path)).collect())
    assert got == [("FR", "Loi", "x"), ("NA", "Loi ", "two\nlines, one; cell")]


def test_reuse_only_complete_stages(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"a": spark.range(3)}

    paths = {"a": str(tmp_path / "a")}
    assert tables.reuse_stage(spark, paths, build)["a"].count() == 3
    assert tables.reuse_stage(spark, paths, build)["a"].count() == 3 and len(calls) == 1
    (tmp_path / "a" / "_SUCCESS").unlink()
    tables.reuse_stage(spark, paths, build)
    assert len(calls) == 2


def payload(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k int, j string")


def test_registry_rows_follow_their_header(spark):
    doc = {"fields": ["cik", "name", "ticker", "exchange"], "data": [[320193, "Apple Inc.", "aapl", "Nasdaq"], [1, "X", None, None]]}
    got = sorted(tuple(r) for r in payloads.explode_fields_rows(payload(spark, doc), "j").collect())
    assert got == [("0000000001", "", "X", "x", "x", None), ("0000320193", "AAPL", "Apple Inc.", "apple", "apple", "Nasdaq")]


def test_last_fact_of_the_last_tag_wins(spark):
    def items(*vals):
        return [{"fy": 2010, "val": v, "form": f} for v, f in vals]

    doc = {"facts": {"us-gaap": {
        "Revenues": {"units": {"USD": items((1, "10-K"), (2, "10-K"), (9, "8-K"))}},
        "SalesRevenueNet": {"units": {"USD": items((5, "10-K/A")), "EUR": items((7, "10-K"))}},
        "NumberOfEmployees": {"units": {"pure": items((100, "20-F"))}},
        "ResearchAndDevelopmentExpense": {"units": {"USD": items((0.5, "10-K"))}},
    }}}
    facts = payloads.flatten_facts_json(payload(spark, doc), "j", ["k"])
    row = aggregates.firm_year_facts(facts, "k", "year", "tag", "unit", "value", "position").first()
    assert (row["revenue"], row["employees"], row["rd_to_revenue"], row["capex"]) == (5.0, 100.0, 0.1, None)


def test_filings_and_profile(spark):
    recent = {
        "accessionNumber": ["a", "b", "c", None], "filingDate": ["2011-02-01", "2012-02-01", "2013-01-01", "2013-01-01"],
        "reportDate": ["2010-12-31", "", "2012-12-31", "2012-12-31"], "form": ["10-K", "20-F", "8-K", "10-K"], "primaryDocument": ["x", "y", "z", "w"],
    }
    docs = payload(spark, {"sic": "3571", "name": "A", "tickers": ["T", "U"], "filings": {"recent": recent}}, {"name": "B", "tickers": []})
    filings = payloads.flatten_filings_json(docs, "j", ["k"])
    annual = aggregates.filing_year(filings, "form", "reportDate", "filingDate", ["accessionNumber", "primaryDocument"])
    assert sorted(tuple(r) for r in annual.select("accessionNumber", "year").collect()) == [("a", 2010), ("b", 2012)]
    assert [tuple(r) for r in payloads.firm_profile_json(docs, "j", ["k"]).select("sic", "name_sec", "ticker_sec").collect()] == [("3571", "A", "T"), (None, "B", None)]


def test_country_metadata_keeps_namibia(spark):
    def country(i3, i2, region):
        return {"id": i3, "iso2Code": i2, "name": f"N {i3}", "region": {"id": region, "value": "R"}, "incomeLevel": {"value": "High"}, "lendingType": {"value": "L"}}

    docs = payload(spark, country("NAM", "NA", "SSF"), country("WLD", "1W", "NA"), country("EU", "EU", "X"), country("NAM", "NA", "SSF"))
    got = payloads.flatten_country_metadata(docs, "j").collect()
    assert [(r["iso3c"], r["wb_name_norm"]) for r in got] == [("NAM", "N NAM")]


def test_business_patterns_and_industry_values(spark):
    table = [["NAICS2017", "EMPSZES", "EMP", "PAYANN", "ESTAB"], ["11", "210", "1", "1", "1"], ["11", "001", "10", "50", "3"], ["11", "001", "9", "9", "9"]]
    got = payloads.flatten_header_row_json(payload(spark, table, table[:1], table[:2]), "j", ["k"]).collect()
    assert [tuple(r) for r in got] == [(0, 10.0, 50.0, 3.0, 5000.0)]
    data = [("2000", "3254", "1,000.0"), ("2000", "31-33", "500"), ("2000", "GDP", "9"), ("1990", "11", "1"), ("2000", "11", "n/a")]
    doc = {"BEAAPI": {"Results": {"Data": [{"Year": y, "Industry": i, "DataValue": v} for y, i, v in data]}}}
    got = payloads.flatten_industry_json(payload(spark, doc), "j", 1995, 2005).collect()
    assert [tuple(r) for r in got] == [(2000, "31-33", 750.0)]


def test_law_map_and_pivot(spark):
    long = payloads.unpivot_map_json(payload(spark, {"NA": [0, 1, 2, 3, 7], "FR": [1, 1]}), "j")
    assert long.count() == 5
    wide = payloads.pivot_laws(long, ["cybercrime", "indirect_taxation"]).first()
    assert tuple(wide) == ("NA", 3, "no_legislation", 7, "unknown")


def test_incremental_equals_one_run(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "id long, x double"

    def score(df):
        return df.withColumn("y", F.col("x") * 2)

    for start in (0, 50, 100):
        spark.range(start, start + 50).select("id", F.col("id").cast("double").alias("x")).write.mode("append").parquet(source)
        incremental.score_incremental(spark, source, schema, score, out, state, max_files=2)
    incremental.score_incremental(spark, source, schema, score, out, state)
    got = incremental.read_scored(spark, out)
    assert got.count() == got.select("id").distinct().count() == 150
    assert got.where("y <> 2 * x").count() == 0


def delimited(rng, rows):
    """Rows as CSV with quotes, doubled quotes, delimiters and line breaks of every kind inside quoted fields."""
    parts = ["a", "b c", ";", ",", '""', "\n", "\r\n", "\n\n", "é漢", "x" * 40, "'"]
    lines = ["id;text;end"]
    for i in range(rows):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        lines.append(f'{i};"{text}";"e{i}"' if i % 3 else f"{i};plain {i};e{i}")
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split", ["40", "700", "100000"])
def test_quoted_records_across_splits(spark, tmp_path, split):
    import csv
    import io

    rng = random.Random(int(split))
    want = []
    for k in range(3):
        text = delimited(rng, 60 if k else 1)
        if k == 2:
            text += '\n7777;"' + "one field over many splits\n" * 60 + '";last'
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        found = list(csv.reader(io.StringIO(text, newline=""), delimiter=";"))
        want += [tuple(c if c or i != 1 else "" for i, c in enumerate(r)) for r in found[1:] if r]
    (tmp_path / "empty.csv").write_bytes(b"")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], split)
        spark.conf.set(names[1], "1")
        df = tables.normalize_delimited(spark, str(tmp_path))
        assert df.columns == ["id", "text", "end"]
        got = [tuple("" if c is None else c for c in r) for r in df.collect()]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sorted(got) == sorted(want)


def test_one_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a,b\n' + "".join(f'{i},"two\nlines {i}"\n' for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        records = tables.quoted_records(spark, str(tmp_path / "one.csv"))
        assert records.select("block").distinct().count() > 4
        assert tables.normalize_delimited(spark, str(tmp_path / "one.csv")).where("b = concat('two\n', 'lines ', a)").count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chunk_ranges_in_any_order_equal_one_run(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50, f"t{i}") for i in range(103)], "id int, text string").repartition(5)
    chunks = incremental.number_chunks(rows, ["id", "text"], 10, str(tmp_path / "chunks"))
    assert incremental.number_chunks(rows.limit(3), ["id"], 7, str(tmp_path / "chunks")).count() == 103  # reused as it is

    def score(version):
        def run(df):
            return df.where("text <> 't7'").select("chunk", "text", F.lit(version).alias("version"))

        return run

    out = str(tmp_path / "out")
    assert incremental.manifest(spark, out).count() == 0
    for version, (first, last) in enumerate([(5, 11), (1, 6), (2, 3), (3, 3)]):
        incremental.score_chunks(chunks, score(version), out, first, last)

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.score_chunks(chunks, fails, out, 1, 11)
    got = incremental.read_chunks(spark, out).collect()
    assert sorted(r.text for r in got) == sorted(f"t{i}" for i in range(103) if i != 7)
    newest = {c: v for v, (a, b) in enumerate([(5, 11), (1, 6), (2, 3), (3, 3)]) for c in range(a, b + 1)}
    assert all(r.version == newest[r.chunk] for r in got)
    sizes = {r.chunk: r.rows for r in incremental.manifest(spark, out).collect()}
    assert sorted(sizes) == list(range(1, 12)) and sum(sizes.values()) == 102
    one = incremental.chunk_diagnostics(spark, out, "version", 2).first()
    assert (one.n_chunks, one.last_chunk, one.n_rows, one.n_listed) == (11, 11, 102, 102)


def test_intermediates_are_released_result_by_result(spark):
    from panelwright import session

    df = spark.range(5)
    with session.intermediates(spark) as first:
        a = session.pinned(df)
        with session.intermediates(spark) as inner:
            b = session.pinned(df)
    c = session.pinned(df)
    assert len(first.paths) == len(inner.paths) == 1
    kept = list(first.paths)
    assert inner.release() == 1 and not inner.paths and a.count() == c.count() == 5
    with pytest.raises(Exception):
        b.count()
    assert first.release() == 1 and first.release() == 0 and c.count() == 5 and kept
