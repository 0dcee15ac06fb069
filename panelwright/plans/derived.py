"""Citation, novelty and productivity variables per item, and their country-year and firm-year panels."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import log_plus1, safe_ratio
from ..functions.text import as_col
from ..operators import aggregates, edges, ranking
from ..operators.joins import semi_join_universe, star_left_join, year_or_mode_join
from ..session import partitions_for, pinned

KEY, YEAR = "patent_id", "app_year"


@dataclass(frozen=True)
class DerivedInputs:
    """Frames keyed by ``patent_id``; see the field comments for the other columns."""

    universe: DataFrame  # app_year, grant_year, assignee_country_mode, inventor_country_mode, num_claims
    evidence: DataFrame  # benchmark_score, benchmark_flag and component scores, one row per item
    applications: DataFrame  # filing_date
    gov_interest: DataFrame  # gi_statement
    gov_org: DataFrame  # fedagency_name, level_one
    references: DataFrame  # other_reference_text
    citations: DataFrame  # citing_patent_id, citation_category; patent_id is the cited item
    current_classes: DataFrame  # cpc_subclass
    issue_classes: DataFrame  # cpc_subclass
    main_classes: DataFrame  # uspc_mainclass_id
    inventors: DataFrame  # inventor_id
    assignees: DataFrame  # assignee_id
    owners: DataFrame  # gvkey, app_year; may repeat items
    firm_year: DataFrame  # gvkey, year, employees, revenue, rd_expense, capex


# How the two kinds of citing parties are written.
CATEGORIES = {
    "forward_citation_examiner_10y": ("cited by examiner", 10),
    "forward_citation_applicant_10y": ("cited by applicant", 10),
}
SPANS = {"forward_citation_count_5y": 5, "forward_citation_count_10y": 10}
FIRM_MEANS = {
    "benchmark_score_mean": "benchmark_score",
    "public_funded_share": "is_publicly_funded",
    "science_reference_share_mean": "science_reference_share",
    "forward_citation_count_10y_mean": "forward_citation_count_10y",
    "citing_cpc4_count_10y_mean": "citing_cpc4_count_10y",
    "opens_new_cpc_field_share": "opens_new_cpc_field_flag",
}


def owner_history(links: DataFrame, universe: DataFrame, owner: str, prefix: str) -> DataFrame:
    """Owners per item and their earlier item counts."""
    dated = links.where(F.col(owner).isNotNull()).join(universe.select(KEY, YEAR), KEY)
    prior = ranking.prior_count(dated, owner, KEY, YEAR, "__prior")
    return edges.owner_productivity(prior, KEY, "__prior", prefix)


def citing_sizes(
    citing: DataFrame, years: DataFrame, owners: DataFrame, firm_year: DataFrame
) -> DataFrame:
    """Employees of the owner of each citing item: in its year, else the owner's most frequent rounded value."""
    modes = ranking.mode_by_key(
        firm_year.where("employees is not null").withColumn("__bin", F.round("employees")), "gvkey", "__bin", "mode"
    )
    dated = citing.join(
        years.select(F.col(KEY).alias("citing_patent_id"), F.col(YEAR).alias("year")), "citing_patent_id", "left"
    ).join(owners.select(F.col(KEY).alias("citing_patent_id"), "gvkey"), "citing_patent_id", "left")
    return year_or_mode_join(dated, firm_year, modes, "gvkey", "year", "employees", "mode", "employees")


def clean_ids(x: DerivedInputs) -> DerivedInputs:
    """All text ids without surrounding blanks, blank ones null, those of items in upper case, in every source alike."""

    def cleaned(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        text = [c for c in (*ITEM_IDS, *OWNER_IDS) if kinds.get(c) == "string"]
        trimmed = {c: F.nullif(F.trim(c), F.lit("")) for c in text}
        return df.withColumns({c: F.upper(e) if c in ITEM_IDS else e for c, e in trimmed.items()}) if text else df

    frames = {f.name: getattr(x, f.name) for f in fields(x)}
    return replace(x, **{n: cleaned(df) for n, df in frames.items() if isinstance(df, DataFrame)})


ITEM_IDS = ("patent_id", "citing_patent_id")
OWNER_IDS = ("inventor_id", "assignee_id", "cpc_subclass", "uspc_mainclass_id")


def patent_variables(x: DerivedInputs) -> DataFrame:
    """One row per item of the universe with all derived variables."""
    x = clean_ids(x)
    u = x.universe
    # The year map feeds most of the branches below; it is written once.
    years = pinned(aggregates.app_year_map(x.applications, KEY, "filing_date"))
    citing_years = years.select(F.col(KEY).alias("citing_patent_id"), YEAR)
    cited = semi_join_universe(x.citations, u, KEY)
    owners = ranking.best_owner(x.owners, KEY, "gvkey", YEAR)
    sizes = citing_sizes(edges.distinct_citing(cited, "citing_patent_id"), years, owners, x.firm_year)
    citing_classes = x.current_classes.select(F.col(KEY).alias("citing_patent_id"), "cpc_subclass")
    intro = edges.class_intro_year(x.issue_classes, years, KEY, "cpc_subclass", YEAR, "intro_year")
    backward = edges.backward_citations(x.citations, u.select(F.col(KEY).alias("citing_patent_id")), "citing_patent_id", KEY)
    parts = [
        x.evidence,
        aggregates.gov_interest(x.gov_interest, u, KEY, "gi_statement"),
        aggregates.gov_org_profile(x.gov_org, u, KEY, "fedagency_name", "level_one"),
        aggregates.science_reference_flags(semi_join_universe(x.references, u, KEY), KEY, "other_reference_text"),
        backward.withColumnRenamed("citing_patent_id", KEY),
        edges.citation_profile(
            cited, u, citing_years, citing_classes, sizes, KEY, "citing_patent_id", "citation_category", "cpc_subclass",
            "employees", YEAR, SPANS, CATEGORIES,
        ),
        edges.class_ahead(x.current_classes, u, intro, KEY, "cpc_subclass", YEAR, "intro_year"),
        edges.first_generation_flag(x.main_classes, u, KEY, "uspc_mainclass_id", YEAR),
        owner_history(x.inventors, u, "inventor_id", "inventor"),
        owner_history(x.assignees, u, "assignee_id", "assignee"),
    ]
    zero = [
        c
        for p in parts[1:]
        for c in p.columns
        if c not in (KEY, "top_funding_agency", "patent_uspc_first_app_year_min")
        and not c.startswith("small_firm_citation_")
    ]
    # Each part is made in as many partitions as the tables it comes from ask for; the parts' own size says how many join them.
    parts = [parts[0], *map(pinned, parts[1:])]
    wide = star_left_join(u.repartition(partitions_for(u, *parts), KEY), parts, KEY, zero)
    return wide.withColumns(
        {
            "ln_num_claims_plus1": log_plus1("num_claims", fill=0),
            "science_reference_share": safe_ratio("science_reference_count", "other_reference_count"),
            "ln_forward_citation_count_10y_plus1": log_plus1("forward_citation_count_10y", fill=0),
        }
    )


def country_year_panel(items: DataFrame) -> DataFrame:
    means = {
        "benchmark_score_mean": "benchmark_score",
        "empirical_driven_share": F.coalesce("benchmark_flag", F.lit(0)),
        "public_funded_share": "is_publicly_funded",
        "science_reference_share_mean": "science_reference_share",
        "ln_forward_citation_10y_plus1_mean": "ln_forward_citation_count_10y_plus1",
        "citing_cpc4_count_10y_mean": "citing_cpc4_count_10y",
        "opens_new_cpc_field_share": "opens_new_cpc_field_flag",
        "years_ahead_cpc_mean": "years_ahead_of_cpc_intro",
    }
    out = aggregates.country_year_derived(items, "assignee_country_mode", YEAR, means)
    return out.withColumnsRenamed({"assignee_country_mode": "iso2c", YEAR: "year"})


def firm_year_derived(
    facts: DataFrame,
    items: DataFrame,
    firm: str,
    item_year: str,
    means: Mapping[str, Column | str],
    logs: Mapping[str, str],
) -> DataFrame:
    """Firm facts with the means of their items in the same year and log outcomes."""
    per_firm = (
        items.where(F.col(firm).isNotNull() & F.col(item_year).isNotNull())
        .groupBy(firm, F.col(item_year).alias("year"))
        .agg(F.count("*").alias("patent_count_linked"), *[F.avg(as_col(c)).alias(n) for n, c in means.items()])
    )
    joined = facts.join(per_firm, [firm, "year"], "left")
    per_worker = safe_ratio("revenue", "employees")
    return joined.withColumns(
        {
            **{name: log_plus1(c, fill=0, floor=0) for name, c in logs.items()},
            "ln_sales_per_worker_plus1": log_plus1(per_worker, fill=0, floor=0),
        }
    )


def firm_year_panel_with_changes(items: DataFrame, owners: DataFrame, firm_year: DataFrame, steps: int = 5) -> DataFrame:
    """Firm-year panel of derived variables and their changes over the next rows."""
    best = ranking.best_owner(owners, KEY, "gvkey", YEAR).select(KEY, "gvkey")
    means = {
        **FIRM_MEANS,
        "empirical_driven_share": F.coalesce("benchmark_flag", F.lit(0)),
    }
    logs = {
        "ln_sales_plus1": "revenue",
        "ln_rd_plus1": "rd_expense",
        "ln_capital_proxy_plus1": "capex",
        "ln_patent_count_plus1": "patent_count_linked",
    }
    panel = firm_year_derived(firm_year, items.join(best, KEY), "gvkey", YEAR, means, logs)
    changed = [*logs, "ln_sales_per_worker_plus1", "empirical_driven_share", "public_funded_share", "science_reference_share_mean"]
    return ranking.lead_change(panel, "gvkey", "year", changed, steps)
