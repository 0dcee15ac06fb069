"""Grouped aggregates. Distinct counts and conditional sums combine on the map side, so hot keys shrink
before they are shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ISO3
from ..functions.numbers import safe_ratio, to_year
from ..functions.text import as_col, clean_html_text, keyword_counts, null_if_blank
from .joins import semi_join_universe
from .ranking import mode_by_key, quantiles

SECTIONS = ("A", "B", "C", "D", "E", "F", "G", "H")


def flag_sum(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def any_flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def firm_year_panel(
    df: DataFrame, owner: str, year: str, item: str, granted: str, private: str, label: str
) -> DataFrame:
    """Counts per owner and year. Private rows are counted as rows but shared over distinct items."""
    panel = (
        df.where(F.col(owner).isNotNull() & F.col(year).isNotNull())
        .groupBy(F.col(owner).alias("gvkey"), F.col(year).alias("year"))
        .agg(
            F.countDistinct(item).alias("patents_applied"),
            F.count(granted).alias("patents_granted"),
            F.count(F.when(F.col(private) == 1, 1)).alias("private_subsidiary_patents"),
            F.countDistinct(label).alias("distinct_assignee_names"),
        )
    )
    return panel.withColumn(
        "private_subsidiary_share", safe_ratio("private_subsidiary_patents", "patents_applied")
    )


def patent_universe(df: DataFrame, item: str, app_year: str, grant_year: str) -> DataFrame:
    return (
        df.where(F.col(item).isNotNull())
        .groupBy(item)
        .agg(F.min(app_year).alias("app_year"), F.max(grant_year).alias("grant_year"))
    )


def app_year_map(df: DataFrame, item: str, date: str, low: int = 1790, high: int = 2035) -> DataFrame:
    """First filing year per item, from the leading four characters of a date text."""
    year = F.substring(F.trim(F.col(date).cast("string")), 1, 4).try_cast("int")
    return (
        df.select(item, year.alias("app_year"))
        .where(F.col(item).isNotNull() & F.col("app_year").between(low, high))
        .groupBy(item)
        .agg(F.min("app_year").alias("app_year"))
    )


def class_profile(
    df: DataFrame, item: str, subclass: str, section: str, flags: Sequence[str], sections: Sequence[str] = SECTIONS
) -> DataFrame:
    """Rows, distinct subclasses, flag maxima and rows per section for every item."""
    return df.groupBy(item).agg(
        F.count("*").alias("cpc_total_count"),
        F.countDistinct(subclass).alias("cpc_unique_subclass_count"),
        *[F.max(f).alias(f) for f in flags],
        *[flag_sum(F.col(section) == s).alias(f"cpc_section_{s}_count") for s in sections],
    )


def gov_interest(df: DataFrame, universe: DataFrame, key: str, statement: str) -> DataFrame:
    """Statement rows and whether any of them is not blank, for keys of the universe."""
    return (
        semi_join_universe(df, universe, key)
        .groupBy(key)
        .agg(
            F.count("*").alias("gov_interest_statement_count"),
            any_flag(null_if_blank(statement).isNotNull()).alias("is_publicly_funded"),
        )
    )


# How each funder is recognised: words in the agency name, words in the department, exact names.
FUNDER_RULES = {
    "has_dod_funding": {"department": ("defense",), "exact": ("army", "navy", "air force")},
    "has_nasa_funding": {"name": ("nasa",), "department": ("nasa",)},
    "has_hhs_funding": {"name": ("health",), "department": ("health",)},
    "has_doe_funding": {"name": ("energy",), "department": ("energy",)},
    "has_nsf_funding": {"name": ("science foundation",), "exact": ("nsf",)},
}


def gov_org_profile(
    df: DataFrame,
    universe: DataFrame,
    key: str,
    agency: str,
    department: str,
    rules: Mapping[str, Mapping[str, Sequence[str]]] = FUNDER_RULES,
) -> DataFrame:
    """Distinct agencies, one flag per funder rule, and the most frequent agency."""
    rows = semi_join_universe(df, universe, key).select(
        key, null_if_blank(agency).alias("__agency"), F.lower(null_if_blank(department)).alias("__dept")
    )
    name = F.lower(F.coalesce("__agency", F.lit("")))

    def hit(rule: Mapping[str, Sequence[str]]) -> Column:
        tests = [name.contains(w) for w in rule.get("name", ())]
        tests += [F.col("__dept").contains(w) for w in rule.get("department", ())]
        if rule.get("exact"):
            tests.append(name.isin(*rule["exact"]))
        return reduce(lambda a, b: a | b, tests)

    profile = rows.groupBy(key).agg(
        F.countDistinct("__agency").alias("gov_interest_org_count"),
        *[any_flag(hit(rule)).alias(flag) for flag, rule in rules.items()],
    )
    top = mode_by_key(rows, key, "__agency", "top_funding_agency")
    return profile.join(top, key, "left")


# Marks of a scientific reference and of a DOI, matched in lower-case text.
SCIENCE_REFERENCE = (
    r"doi\s*[:]|et\s+al|journal|vol\.|volume|pp\.|arxiv|pmid|"
    r"nature|science|ieee|proceedings|lancet|nejm|bioinformatics"
)
DOI_REFERENCE = r"doi\s*[:]?10\."


def science_reference_flags(
    df: DataFrame, key: str, text: str, science: str = SCIENCE_REFERENCE, doi: str = DOI_REFERENCE
) -> DataFrame:
    """Reference rows per key, and how many look scientific or carry a DOI."""
    words = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(key).agg(
        F.count("*").alias("other_reference_count"),
        F.count_if(words.rlike(science)).alias("science_reference_count"),
        F.count_if(words.rlike(doi)).alias("doi_reference_count"),
    )


# Annual report forms.
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "40-F")


def filing_year(
    df: DataFrame, form: str, report_date: str, filing_date: str, required: Sequence[str], forms: Sequence[str] = ANNUAL_FORMS
) -> DataFrame:
    """Annual filings with the year of the report date, or of the filing date when that is blank."""
    when = F.coalesce(*[F.try_to_timestamp(null_if_blank(c)) for c in (report_date, filing_date)])
    return (
        df.where(F.col(form).isin(*forms))
        .withColumn("year", F.year(when))
        .dropna(subset=["year", *required])
    )


def keyword_features_by_firm_year(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in features])


def filing_features(
    filings: DataFrame, pages: DataFrame, document: str, html: str, keys: Sequence[str], terms: Mapping[str, list[str]], total: str
) -> DataFrame:
    """Keyword counts of each filing's page, the largest by ``keys``. A page is cleaned once however many filings name it."""
    wanted = filings.select(document).distinct()
    clean = pages.join(wanted, document).select(document, clean_html_text(html).alias("__text"))
    counted = clean.select(document, *keyword_counts("__text", dict(terms), total))
    return keyword_features_by_firm_year(filings.join(counted, document), keys, [*terms, total])


def facts_with_context(facts: DataFrame, firm: str, year: str, features: DataFrame, profile: DataFrame) -> DataFrame:
    """Firm-year facts with the text features of their year and the firm's profile; facts without either are kept."""
    return facts.join(features, [firm, year], "left").join(profile, firm, "left")


# Fact tags per metric in rising priority, and whether only money units count.
FACT_TAGS = {
    "revenue": (("Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"), ("USD",)),
    "sales_marketing_expense": (("SellingAndMarketingExpense",), ("USD",)),
    "sga_expense": (("SellingGeneralAndAdministrativeExpense",), ("USD",)),
    "rd_expense": (("ResearchAndDevelopmentExpense",), ("USD",)),
    "capex": (("PaymentsToAcquirePropertyPlantAndEquipment",), ("USD",)),
    "employees": (("NumberOfEmployees",), None),
}
REVENUE_RATIOS = {
    "sales_marketing_to_revenue": "sales_marketing_expense",
    "sga_to_revenue": "sga_expense",
    "rd_to_revenue": "rd_expense",
    "capex_to_revenue": "capex",
}


def firm_year_facts(
    facts: DataFrame,
    firm: str,
    year: str,
    tag: str,
    unit: str,
    value: str,
    position: str,
    tags: Mapping[str, tuple[Sequence[str], Sequence[str] | None]] = FACT_TAGS,
    ratios: Mapping[str, str] = REVENUE_RATIOS,
    base: str = "revenue",
) -> DataFrame:
    """All metrics per firm and year in one pass: the last fact of the last listed tag wins."""
    known = F.col(year).isNotNull() & F.col(value).isNotNull()
    aggs, wanted = [], F.lit(False)
    for metric, (names, units) in tags.items():
        rank = F.lit(None).cast("int")
        for i, name in enumerate(names):
            rank = F.when(F.col(tag) == name, i).otherwise(rank)
        ok = rank.isNotNull()
        if units is not None:
            ok = ok & F.col(unit).isin(*units)
        wanted = wanted | ok
        order = F.struct(rank.alias("r"), F.col(unit).alias("u"), F.col(position).alias("p"), F.col(value).alias("v"))
        aggs.append(F.max_by(F.col(value), F.when(ok, order)).alias(metric))
    out = facts.where(known & wanted).groupBy(firm, year).agg(*aggs)
    return out.withColumns({name: safe_ratio(metric, base) for name, metric in ratios.items()})


def annual_mean_series(df: DataFrame, date_year: Column, series: str, value: str, names: Mapping[str, str], low: int, high: int) -> DataFrame:
    """Yearly mean per named series, one column each, within a range of years."""
    return (
        df.where(F.col(series).isin(*names))
        .select(date_year.alias("year"), series, F.col(value).try_cast("double").alias("__v"))
        .where(F.col("year").between(low, high) & F.col("__v").isNotNull())
        .groupBy("year")
        .agg(*[F.avg(F.when(F.col(series) == s, F.col("__v"))).alias(name) for s, name in names.items()])
    )


def filtered_series_mean(
    df: DataFrame, keys: Sequence[str], value: str, specs: Mapping[str, Mapping[str, object]]
) -> DataFrame:
    """Mean of the value per key under each named filter (column = value, or in a list), in one pass."""

    def mask(filters: Mapping[str, object]) -> Column:
        tests = [
            F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in filters.items()
        ]
        return reduce(lambda a, b: a & b, tests)

    out = df.groupBy(*keys).agg(*[F.avg(F.when(mask(f), F.col(value))).alias(n) for n, f in specs.items()])
    return out.dropna(how="all", subset=list(specs))


def oecd_clean(df: DataFrame, area: str, period: str, value: str) -> DataFrame:
    """Upper-case three-letter areas, whole years and numeric values only."""
    return (
        df.withColumns(
            {
                "iso3c": F.upper(F.col(area).cast("string")),
                "year": to_year(period),
                "obs_value": F.col(value).try_cast("double"),
            }
        )
        .where(F.col("iso3c").rlike(ISO3))
        .dropna(subset=["year", "obs_value"])
    )


def top_measures(df: DataFrame, measure: str, value: str, k: int) -> DataFrame:
    """The k measures with most observations; ties fall to the smaller name."""
    return (
        df.groupBy(measure)
        .agg(F.count(value).alias("n_obs"))
        .orderBy(F.desc("n_obs"), measure)
        .limit(k)
    )


def top_measures_pivot(
    df: DataFrame, keys: Sequence[str], measure: str, value: str, k: int, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Mean per key of each leading measure as columns. Only the k names reach the driver."""
    names = [r[0] for r in top_measures(df, measure, value, k).collect()]
    if not names:
        return df.select(*keys).limit(0)
    return (
        df.where(F.col(measure).isin(*names))
        .groupBy(*keys)
        .agg(
            *[
                F.avg(F.when(F.col(measure) == n, F.col(value))).alias(f"{prefix}{str(n).lower()}{suffix}")
                for n in sorted(names)
            ]
        )
    )


def count_by(df: DataFrame, columns: Sequence[str], name: str = "n_measures") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


SCORE_COLUMNS = (
    "dictionary_score",
    "metadata_score",
    "text_supervised_score",
    "semantic_lsa_score",
    "data_collection_score",
    "empirical_analysis_score",
    "experimental_validation_score",
    "measurement_instrumentation_score",
    "data_quality_calibration_score",
    "ml_training_data_score",
    "boilerplate_score",
)


def _score_measures(
    threshold: str = "threshold",
    scores: Sequence[str] = SCORE_COLUMNS,
    score: str = "benchmark_score",
    flag: str = "benchmark_flag",
    confidence: str = "benchmark_confidence",
    claims: str = "num_claims",
) -> list[Column]:
    weight = F.when(F.col(claims) > 0, F.col(claims))
    return [
        F.count("*").alias("patent_count"),
        F.sum(flag).alias("data_driven_patent_count"),
        F.avg(flag).alias("data_driven_patent_share"),
        F.avg(score).alias(f"{score}_mean"),
        F.avg(F.when(F.col(score) >= F.col(threshold), 1).otherwise(0)).alias("benchmark_top_decile_share"),
        *[F.avg(c).alias(f"{c}_mean") for c in scores],
        F.try_divide(F.sum(F.col(score) * weight), F.sum(weight)).alias(f"claims_weighted_{score}_mean"),
        F.avg(confidence).alias(f"{confidence}_mean"),
    ]


def country_year_scores(df: DataFrame, country: str, year: str, threshold: str = "threshold", **names) -> DataFrame:
    """Country-year measures: counts, shares, score means, share above a global threshold, weighted mean."""
    return (
        df.where(F.col(country).rlike(ISO3) & F.col(year).isNotNull())
        .groupBy(F.col(country).alias("iso3c"), F.col(year).cast("int").alias("year"))
        .agg(*_score_measures(threshold, **names))
    )


def country_year_variants(
    df: DataFrame, variants: Mapping[tuple[str, str], tuple[str, str]], threshold: str = "threshold", **names
) -> DataFrame:
    """``country_year_scores`` by several country and year columns, stacked with the labels of each.

    All variants are grouping sets of one aggregate, so the rows are read once and expanded before the partial sums.
    """
    countries = {c: f"__c{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in variants.values()))}
    years = {y: f"__y{i}" for i, y in enumerate(dict.fromkeys(y for _, y in variants.values()))}
    keys = [*countries.values(), *years.values()]
    rows = df.withColumns(
        {n: F.when(F.col(c).rlike(ISO3), F.col(c)) for c, n in countries.items()}
        | {n: F.col(y).cast("int") for y, n in years.items()}
    )
    sets = {label: [countries[c], years[y]] for label, (c, y) in variants.items()}
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets.values()], *[F.col(k) for k in keys]).agg(
        *_score_measures(threshold, **names), F.grouping_id().alias("__set")
    )
    # A grouping id has a bit for each key that its set leaves out.
    ids = {label: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for label, s in sets.items()}
    of = [F.col("__set") == i for i in ids.values()]
    picked = {
        "iso3c": F.coalesce(*[F.when(w, F.col(s[0])) for w, s in zip(of, sets.values(), strict=True)]),
        "year": F.coalesce(*[F.when(w, F.col(s[1])) for w, s in zip(of, sets.values(), strict=True)]),
        "assignment_basis": F.coalesce(*[F.when(w, F.lit(a)) for w, (a, _) in zip(of, sets, strict=True)]),
        "year_basis": F.coalesce(*[F.when(w, F.lit(y)) for w, (_, y) in zip(of, sets, strict=True)]),
    }
    found = grouped.withColumns(picked).where("iso3c IS NOT NULL AND year IS NOT NULL")
    measures = [c for c in grouped.columns if c not in {*keys, "__set"}]
    return found.select("iso3c", "year", *measures, "assignment_basis", "year_basis")


def country_year_derived(df: DataFrame, country: str, year: str, means: Mapping[str, Column | str]) -> DataFrame:
    """Row count and plain means per country and year; null keys are dropped."""
    return (
        df.where(F.col(country).isNotNull() & F.col(year).isNotNull())
        .groupBy(country, year)
        .agg(F.count("*").alias("patent_count"), *[F.avg(as_col(c)).alias(n) for n, c in means.items()])
    )


def industry_year_weighted(
    df: DataFrame,
    crosswalk: DataFrame,
    source: str,
    year: str,
    flag: str,
    scores: Sequence[str],
    shares: Sequence[str],
    policy_means: Mapping[str, str] = {},
    policy_law: tuple[str, str] | None = None,
) -> DataFrame:
    """Fractional counts and weighted means per target code and year.

    Weights depend on the source code only, so sums are taken per (source code, year) first and the
    many-to-many crosswalk meets those few rows instead of the facts. Score means divide by all weights,
    policy means by the weights of rows that have the policy value.
    """
    columns = [flag, *scores, *shares]
    aggs = [F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in columns]]
    for out, c in policy_means.items():
        aggs += [F.sum(c).alias(f"__s_{out}"), F.count(c).alias(f"__n_{out}")]
    if policy_law:
        out, c = policy_law
        aggs += [flag_sum(F.col(c) == 1).alias(f"__s_{out}"), F.count(c).alias(f"__n_{out}")]
    policies = [*policy_means, *([policy_law[0]] if policy_law else [])]
    per_source = df.where(F.col(year).isNotNull() & F.col(source).isNotNull()).groupBy(source, year).agg(*aggs)

    w = F.lit(1.0) / F.col("n_codes")
    joined = per_source.join(crosswalk, source)
    weighted = joined.groupBy("naics_code", F.col(year).alias("year")).agg(
        F.sum(F.col("__n") * w).alias("patent_count"),
        F.sum(F.col(f"__s_{flag}") * w).alias("data_driven_patent_count"),
        *[F.sum(F.col(f"__s_{c}") * w).alias(f"__w_{c}") for c in [*scores, *shares]],
        *[F.sum(F.col(f"__s_{p}") * w).alias(f"__w_{p}") for p in policies],
        *[F.sum(F.col(f"__n_{p}") * w).alias(f"__d_{p}") for p in policies],
        F.sum("__n").alias("raw_links"),
    )
    return weighted.select(
        "naics_code",
        "year",
        "patent_count",
        "data_driven_patent_count",
        *[F.try_divide(f"__w_{c}", "patent_count").alias(f"{c}_mean") for c in scores],
        *[F.try_divide(f"__w_{c}", "patent_count").alias(f"{c}_share") for c in shares],
        *[F.try_divide(f"__w_{p}", f"__d_{p}").alias(p) for p in policies],
        "raw_links",
        F.try_divide("data_driven_patent_count", "patent_count").alias("data_driven_patent_share"),
    )


def build_crosswalk(df: DataFrame, target: str, source: str) -> DataFrame:
    """Digits-only code pairs with 2, 3 and 4 digit prefixes of a six-digit target."""
    from ..functions.text import normalize_digits

    code = normalize_digits(target)
    padded = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    return (
        df.select(normalize_digits(source).alias("sic_key"), padded.alias("naics6"))
        .where(F.col("sic_key").isNotNull() & F.col("naics6").rlike(r"^[0-9]{6}$"))
        .distinct()
        .withColumns({f"naics{n}": F.substring("naics6", 1, n) for n in (2, 3, 4)})
    )


def fractional_weights(crosswalk: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct code pairs with the number of targets of each source; weights 1/n sum to one per source."""
    pairs = crosswalk.select(source, F.col(target).alias("naics_code")).distinct()
    return pairs.join(pairs.groupBy(source).agg(F.count("*").alias("n_codes")), source)


def coverage_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_with_{c}") for c in columns])


def run_summary(df: DataFrame, entity: str, year: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(entity).alias("n_entities"),
        F.min(year).alias("year_min"),
        F.max(year).alias("year_max"),
    )


def breakdown(df: DataFrame, keys: Sequence[str], means: Mapping[str, Column | str], limit: int | None = None) -> DataFrame:
    """Count and means per combination of keys, null groups kept; largest first when limited."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_patents"), *[F.avg(as_col(c)).alias(n) for n, c in means.items()])
    if limit is None:
        return out
    return out.orderBy(F.desc("n_patents"), *[F.asc_nulls_first(k) for k in keys]).limit(limit)


def technology_group(measurement: str, testing: str, ml: str, data_processing: str) -> Column:
    m, t, k, d = (F.col(c) == 1 for c in (measurement, testing, ml, data_processing))
    return (
        F.when(m & k, "Measurement + ML")
        .when(m, "Measurement only")
        .when(k, "ML only")
        .when(t, "Testing only")
        .when(d, "Data-processing only")
        .otherwise("Other/none")
    )


def yearly_distribution(df: DataFrame, year: str, value: str) -> DataFrame:
    """Count, mean and the 10th, 50th and 90th percentile per year."""
    known = df.where(F.col(year).isNotNull())
    base = known.groupBy(year).agg(F.count("*").alias("n_patents"), F.avg(value).alias("benchmark_mean"))
    points = quantiles(known, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, [year])
    return base.join(points, year, "left")


def having_count(df: DataFrame, key: Column, name: str, means: Mapping[str, Column | str], at_least: int, limit: int | None = None) -> DataFrame:
    """Groups with at least so many rows, with means; the largest ``limit`` groups if given."""
    out = (
        df.groupBy(key.alias(name))
        .agg(F.count("*").alias("patent_count"), *[F.avg(as_col(c)).alias(n) for n, c in means.items()])
        .where(F.col("patent_count") >= at_least)
    )
    return out.orderBy(F.desc("patent_count"), name).limit(limit) if limit else out
