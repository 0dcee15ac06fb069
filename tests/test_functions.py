import html
import html.entities
import math
import re

import pytest
from pyspark.sql import functions as F

from panelwright.functions import codes, evidence, numbers, text


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("name", "norm"),
    [("Acme, Inc.", "acme"), ("The  Big-Co Holdings Ltd", "the big"), ("Incorporated Group", "incorporated"), (None, ""), ("Co", "")],
)
def test_normalize_name(spark, name, norm):
    assert one(spark, text.normalize_name("v0"), name) == norm
    assert one(spark, text.compact_name("v0"), name) == norm.replace(" ", "")


@pytest.mark.parametrize(
    ("value", "want"), [("320193", "0000320193"), ("CIK 12-3", "0000000123"), ("123456789012", "123456789012"), ("", "0000000000")]
)
def test_pad_id(spark, value, want):
    assert one(spark, text.pad_id("v0"), value) == want


@pytest.mark.parametrize(("sic", "bucket"), [("2834", "31-33"), ("6021", "52"), ("5311", "44-45"), (None, None), ("x1", None), (" 48 ", "51"), ("9999", None)])
def test_sector_bucket(spark, sic, bucket):
    assert one(spark, codes.bucket_sic_to_naics("v0"), sic) == bucket


@pytest.mark.parametrize(("code", "root"), [("31-33", "31-33"), ("3254", "31-33"), ("5415", "54"), ("44RT", "44-45"), ("48", "48-49"), ("GDP", None), ("9x", None)])
def test_industry_root(spark, code, root):
    assert one(spark, codes.bucket_industry_code("v0"), code) == root


@pytest.mark.parametrize(("value", "want"), [("0012-0", "120"), ("000", "0"), ("abc", None), (None, None), ("9" * 25, "9" * 25)])
def test_normalize_digits(spark, value, want):
    assert one(spark, text.normalize_digits("v0"), value) == want


@pytest.mark.parametrize(
    ("value", "half_up", "year", "strict"),
    [("2000.0", 2000, 2000, None), ("2000.6", 2001, 2001, None), ("2.5", 3, 2, None), (" 12 ", 12, 12, 12), ("x", None, None, None)],
)
def test_number_parsing(spark, value, half_up, year, strict):
    assert one(spark, numbers.coerce_int("v0"), value) == half_up
    assert one(spark, numbers.to_year("v0"), value) == year
    assert one(spark, numbers.parse_int("v0"), value) == strict


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0), (float("inf"), 2.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.safe_ratio("a", "b")).collect()] == [None, None, 0.25, None]


def test_labels_keep_their_blank(spark):
    expr = codes.map_codes("v0", {"no law": 0, "law": 1})
    assert one(spark, expr, "no law ") is None
    assert one(spark, codes.map_codes("v0", {"no law": 0}, trim=True), "no law ") == 0
    assert one(spark, codes.map_codes("v0", {"a": 1}), None) is None


def clean_in_python(raw):
    out = re.sub(r"<script[\s\S]*?</script>", " ", raw, flags=re.IGNORECASE)
    out = re.sub(r"<style[\s\S]*?</style>", " ", out, flags=re.IGNORECASE)
    out = html.unescape(re.sub(r"<[^>]+>", " ", out))
    return re.sub(r"\s+", " ", out).strip().lower()


@pytest.mark.parametrize(
    "raw",
    [
        "<p>A&nbsp;&nbsp;B &amp;lt; C</p><SCRIPT>\nvar x='<p>';</SCRIPT> d",
        "x &#38;lt; &#x20AC; &#8364; &copy; &mdash; café",
        "<style>\np{}</style>T U V",
        "a &#38;amp; b &unknown; &#; &",
        "&eacute;&Eacute &notin; &notit; &copy2 &AMP;lt; &amplt; &CounterClockwiseContourIntegral; &ngE; &acE;&\t;",
        "&#0; &#x0; &#128; &#x9f;&#x81; &#7; &#13; &#xD800; &#1114112; &#99999999999999999999; &#xFFFE; &#00065 &#x000041;b",
    ],
)
def test_html_text(spark, raw):
    assert one(spark, text.clean_html_text("v0"), raw) == clean_in_python(raw)


def test_keyword_counts_nested_terms(spark):
    df = spark.createDataFrame([("brand brand awareness aaa",)], "t string")
    groups = {"kw": ["brand", "brand awareness"], "a": ["aa"]}
    assert tuple(df.select(*text.keyword_counts("t", groups, "total")).first()) == (3, 1, 4)


def test_technology_flags(spark):
    df = spark.createDataFrame(
        [("G01N", "G01N33/50"), ("G06N", "G06N7/01"), ("G06F", "G06F17/18"), ("A01B", None), (None, None)], "s string, g string"
    )
    got = [tuple(r)[2:] for r in codes.technology_flags(df, "s", "g").collect()]
    names = codes.technology_flags(df, "s", "g").columns[2:]
    assert names == ["has_measurement_cpc", "has_testing_cpc", "has_ml_cpc", "has_data_processing_cpc", "has_bio_assay_cpc", "has_statistics_cpc"]
    # The long prefixes are tested against the subclass, so only the short ones can match.
    assert got == [(1, 0, 0, 0, 0, 0), (0, 0, 1, 0, 0, 1), (0, 0, 0, 0, 0, 1), (0,) * 6, (0,) * 6]


def test_country_codes(spark):
    table = {r[0]: r[1] for r in codes.iso_country_table(spark).collect()}
    assert table["US"] == "USA" and table["NA"] == "NAM" and table["XK"] == "XKX" and table["SU"] == "SUN"
    assert len(table) >= 249


def features_in_python(title, abstract, flags):
    t = ((title or "") + " " + (abstract or "")).lower()
    hits = {d: len(re.findall(p, t)) for d, p in evidence.TEXT_PATTERNS.items()}
    parts = {d: 1 - math.exp(-h / 2) for d, h in hits.items()}
    w = sum(weight * parts[d] for d, weight in evidence.DICTIONARY_WEIGHTS.items())
    dictionary = w / (w + 2.5 + 1.4 * parts["boilerplate_digital"])
    raw = 1.2 * flags.get("has_measurement_cpc", 0) + 0.9 * flags.get("has_data_processing_cpc", 0)
    return hits, dictionary, 1 / (1 + math.exp(-(raw - 1.2))), len(re.findall(r"\b\w+\b", t))


@pytest.mark.parametrize(
    ("title", "abstract", "flags", "label"),
    [
        ("Sensor calibration", "A detector probe with error correction", {}, 1),
        ("Server", "A database server storing data, receiving data; the user interface", {"has_data_processing_cpc": 1}, 0),
        ("Café chair", None, {}, None),
        ("Neural network", "machine learning with experiment data", {}, 1),
        (None, "regression and sensor", {"has_measurement_cpc": 1}, None),
        (None, "regression, sensor and dataset", {"has_measurement_cpc": 1}, 1),
        ("Data", "dataset", {}, None),
    ],
)
def test_evidence_features(spark, title, abstract, flags, label):
    schema = "title string, abstract string, " + ", ".join(f"{c} int" for c in ("has_measurement_cpc", "has_data_processing_cpc"))
    row = (title, abstract, flags.get("has_measurement_cpc"), flags.get("has_data_processing_cpc"))
    df = spark.createDataFrame([row], schema).withColumn("text", evidence.model_text("title", "abstract"))
    got = evidence.evidence_features(df, "text").first().asDict()
    hits, dictionary, metadata, tokens = features_in_python(title, abstract, flags)
    assert {d: got[f"{d}_hits"] for d in hits} == hits
    assert got["dictionary_score"] == pytest.approx(dictionary, abs=1e-12)
    assert got["metadata_score"] == pytest.approx(metadata, abs=1e-12)
    assert got["n_tokens"] == tokens
    assert got["seed_label"] == label


def test_row_sample_std(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0), (1.0, None, 3.0), (1.0, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(numbers.row_sample_std(["a", "b", "c"])).collect()]
    assert got[0] == pytest.approx(1.5275252316519468) and got[1] == pytest.approx(math.sqrt(2)) and got[2] is None


def test_extract_year(spark):
    assert one(spark, text.extract_year("v0"), "since 1899, 2018-2020") == "2018"
    assert one(spark, F.coalesce(text.extract_year("v0"), F.lit("none")), "no year") == "none"


def test_every_named_reference(spark):
    names = [f"&{n}" for n in html.entities.html5]
    made = spark.createDataFrame([(n, n + "q") for n in names], "a string, b string")
    got = made.select("a", "b", text.unescape_entities("a").alias("x"), text.unescape_entities("b").alias("y")).collect()
    assert len(got) == len(names) > 2000
    assert [r for r in got if r.x != html.unescape(r.a) or r.y != html.unescape(r.b)] == []
