import random

import pytest

from panelwright.operators import linking


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b):
    def ratio(x, y):
        return 1 - distance(x, y) / max(len(x), len(y))

    def swap(x):
        return " ".join(sorted(x.split(" ")))

    return max(ratio(a, b), 0.95 * ratio(swap(a), swap(b)))


def words(rng, n):
    parts = ["acme", "acne", "general", "generic", "data", "date", "systems", "system", "northern", "power", "powers", "ab", "x", "intl"]
    out = set()
    while len(out) < n:
        name = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.5 and len(name) > 2:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("aeiou") + name[at + rng.randrange(2):]
        out.add(" ".join(name.split()))
    return sorted(x for x in out if x)


@pytest.mark.parametrize(("threshold", "per_task"), [(0.95, 5000), (0.86, 5000), (0.86, 3), (0.8, 3), (0.7, 5000), (0.5, 5000)])
def test_fuzzy_join_loses_nothing(spark, monkeypatch, threshold, per_task):
    monkeypatch.setattr(linking, "NAMES_PER_TASK", per_task)
    rng = random.Random(int(threshold * 100))
    a, b = words(rng, 90), words(rng, 90)
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    got = {(r.a, r.b): r.score for r in linking.fuzzy_names(left, right, threshold).collect()}
    want = {(x, y): score(x, y) for x in a for y in b if score(x, y) >= threshold}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_gram_sizes():
    assert linking.gram_size(0.86) >= 3 and linking.gram_size(0.5) is None
    for t in (0.8, 0.86, 0.9, 0.95):
        q = linking.gram_size(t)
        assert q is None or all(
            q * linking._edit_budget(n, t) + 1 <= n - q + 1 for n in range(1, 300) if linking._edit_budget(n, t)
        )


@pytest.fixture()
def acme(spark):
    firms = spark.createDataFrame([("001000", "Acme Corp", 10)], "gvkey string, firm_name string, patent_count int")
    raw = spark.createDataFrame(
        [("1", "acm", "Acme Corp", "NYSE"), ("2", "ACME", "Acme Corporation", "NASDAQ")],
        "cik string, ticker string, sec_name string, exchange string",
    )
    return firms, linking.prepare_registry(raw)


CONFIG = linking.LinkConfig(fuzzy_threshold=0.5, score_gap_for_conflict=0.5, top_n_candidates=5)


def test_two_exact_matches_conflict(acme):
    links, top, conflicts = linking.link_firms(*acme, config=CONFIG)
    link = links.collect()
    assert len(link) == 1 and link[0]["link_method"] == "exact_normalized_name" and link[0]["link_conflict"]
    assert link[0]["cik"] == "0000000001" and link[0]["candidate_count"] == 2
    assert top.count() == 2 and conflicts.count() == 2


def test_ticker_hint_and_unlinked(spark, acme):
    _, registry = acme
    firms = spark.createDataFrame(
        [("1", "Totally Other", 3), ("2", "Nobody Knows This", 1), ("3", None, 1)], "gvkey string, firm_name string, patent_count int"
    )
    hints = spark.createDataFrame([("1", " acm "), ("2", "  "), ("3", "ACME")], "gvkey string, ticker string")
    links = {r["gvkey"]: r for r in linking.link_firms(firms, registry, hints)[0].collect()}
    assert links["1"]["link_method"] == "ticker_hint" and links["1"]["cik"] == "0000000001"
    assert links["2"]["link_method"] == "unlinked" and links["2"]["link_score"] == 0.0 and links["2"]["cik"] is None
    assert links["3"]["link_method"] == "ticker_hint" and links["3"]["link_score"] == pytest.approx(0.08)


def test_manual_override(spark, acme):
    firms, registry = acme
    links, _, _ = linking.link_firms(firms, registry, config=CONFIG)
    manual = linking.manual_links(spark.createDataFrame([("001000", "2")], "gvkey string, cik string"))
    row = linking.manual_override(links, manual, registry).first()
    assert (row["cik"], row["link_method"], row["link_score"], row["link_conflict"], row["ticker"]) == (
        "0000000002", "manual_override", 1.0, False, "ACME",
    )


def test_hot_name_gives_one_link_per_firm(spark):
    firms = spark.createDataFrame(
        [(str(i), "Acme Inc" if i % 3 == 0 else f"Firm number {i} Ltd", i) for i in range(120)],
        "gvkey string, firm_name string, patent_count int",
    )
    registry = linking.prepare_registry(
        spark.createDataFrame(
            [(str(i), f"t{i}", "ACME" if i % 3 == 0 else f"firm number {i}", "N") for i in range(90)],
            "cik string, ticker string, sec_name string, exchange string",
        )
    )
    links = linking.link_firms(firms, registry)[0]
    assert links.count() == links.select("gvkey").distinct().count() == 120
    hot = links.where("firm_name = 'Acme Inc'").select("cik", "candidate_count").distinct().collect()
    assert [tuple(r) for r in hot] == [("0000000000", 30)]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"\['cik', 'gvkey'\]"):
        linking.manual_links(spark.createDataFrame([(1,)], "x int"))


@pytest.mark.parametrize(("threshold", "per_task"), [(0.6, 5000), (0.5, 2), (0.35, 5000), (0.65, 4)])
def test_segments_lose_nothing_where_grams_would(spark, threshold, per_task):
    assert linking.gram_size(threshold) is None
    rng = random.Random(int(threshold * 1000))
    a, b = words(rng, 60), [*words(rng, 60), "a", "ab", "é"]
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    got = {(r.a, r.b): r.score for r in linking.fuzzy_names(left, right, threshold, per_task).collect()}
    want = {(x, y): score(x, y) for x in a for y in b if score(x, y) >= threshold}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_threshold_of_zero_is_refused(spark):
    names = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError, match="above 0"):
        linking.fuzzy_names(names, names.withColumnRenamed("a", "b"), 0.0)


@pytest.mark.parametrize("k", [1, 3])
def test_ticker_leaders_equal_scoring_all(spark, k):
    rng = random.Random(k)
    names = words(rng, 60)
    firms = [(str(i), rng.choice([*names[:30], "", None]), i) for i in range(40)]
    hints = [(str(i), rng.choice(["t0", "t1", "hot", "none"])) for i in range(36)]
    rows = [(str(i), rng.choice(["t0", "t1"]) if i % 3 else "hot", rng.choice(names), "N") for i in range(300)]
    rows += [("7", "hot", names[3], "N"), ("8", "hot", names[5], "N"), ("9", "hot", "", "N"), ("9", "t0", None, "N")]
    registry = linking.prepare_registry(spark.createDataFrame(rows, "cik string, ticker string, sec_name string, exchange string"))
    prepared = linking.prepare_firms(
        spark.createDataFrame(firms, "gvkey string, firm_name string, patent_count int"),
        spark.createDataFrame(hints, "gvkey string, ticker string"),
    )
    best = {}
    known = registry.select("cik", "ticker", "sec_name_norm").collect()
    for f in prepared.select("firm_name_norm", "ticker_hint").distinct().collect():
        ids = {}
        for r in known:
            if f.ticker_hint and r.ticker == f.ticker_hint:
                s = score(f.firm_name_norm, r.sec_name_norm) if f.firm_name_norm and r.sec_name_norm is not None else 0.0
                ids[r.cik] = max(ids.get(r.cik, 0.0), min(1.0, s + linking.TICKER_BONUS))
        if ids:
            best[f.firm_name_norm, f.ticker_hint] = {c for c, _ in sorted(ids.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]}
    got = {}
    for r in linking.ticker_leaders(prepared, registry, k, seeds=1).collect():
        got.setdefault((r.firm_name_norm, r.ticker_hint), set()).add(r.cik)
    assert got == best


def test_series_map_becomes_names(spark):
    table = spark.createDataFrame([("a.1", "first"), ("b", "second")], "series_id string, metric_name string")
    assert linking.series_names(table) == {"a.1": "first", "b": "second"}
    with pytest.raises(ValueError):
        linking.series_names(table.drop("metric_name"))
