"""Linking firms to a registry by exact name, ticker hint and fuzzy name.

All candidate work happens on distinct names, so copies of one name cost nothing extra, and results are
joined back to firms at the end. The fuzzy join is lossless at every threshold: it blocks on the rarest q-grams of a
name (prefix filtering), which any name within the allowed edit distance must share, and where so many edits are
allowed that no gram need survive, on segments of the longer name, one of which must (pigeonhole).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import as_col, compact_name, normalize_name, pad_id, sorted_tokens, trim_all
from ..session import partitions_for as _partitions
from ..session import pinned
from .ranking import keep_best, top_k_per_key

# Order in which methods win on equal scores, and the scores of the exact methods.
METHOD_RANK = {"exact_normalized_name": 0, "exact_compact_name": 1, "ticker_hint": 2, "fuzzy_name": 3}
EXACT_NAME_SCORE, COMPACT_NAME_SCORE, TICKER_BONUS = 1.0, 0.985, 0.08
TOKEN_SORT_WEIGHT = 0.95

REGISTRY_COLUMNS = ("cik", "ticker", "sec_name", "exchange")
# A gram or segment held by more names than this is spread over several join keys, unless a caller says otherwise.
NAMES_PER_TASK = 5_000
# Pairs of a profile and a registry row under one ticker that are scored together, and the most tasks that share them.
PAIRS_PER_TASK, MOST_TASKS = 200_000, 10_000


@dataclass(frozen=True)
class LinkConfig:
    fuzzy_threshold: float = 0.86
    score_gap_for_conflict: float = 0.03
    top_n_candidates: int = 5

    @property
    def fuzzy_limit(self) -> int:
        return max(20, 4 * self.top_n_candidates)


def prepare_registry(df: DataFrame) -> DataFrame:
    """Registry rows with padded id, upper-case ticker and the two name keys."""
    return df.select(
        pad_id("cik").alias("cik"),
        F.upper(F.coalesce("ticker", F.lit(""))).alias("ticker"),
        "sec_name",
        normalize_name("sec_name").alias("sec_name_norm"),
        compact_name("sec_name").alias("sec_name_compact"),
        "exchange",
    )


def prepare_firms(firms: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Firms with their normalised name and ticker hint ('' when there is none)."""
    named = firms.withColumn("firm_name_norm", normalize_name("firm_name"))
    if hints is None:
        return named.withColumn("ticker_hint", F.lit(""))
    clean = clean_hints(hints).select("gvkey", F.col("ticker").alias("ticker_hint"))
    return named.join(clean, "gvkey", "left").fillna("", ["ticker_hint"])


def clean_hints(hints: DataFrame) -> DataFrame:
    ticker = F.upper(trim_all(F.coalesce("ticker", F.lit(""))))
    return hints.select("gvkey", ticker.alias("ticker")).where(F.col("ticker") != "")


def similarity(a: Column, b: Column) -> Column:
    """One minus edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))


def similarity_from(a: Column, b: Column, least: Column | float) -> Column:
    """``similarity`` where it reaches ``least``, else null; the edit distance stops at the edits that allows."""
    least = F.lit(least) if isinstance(least, float) else least
    longest = F.greatest(F.length(a), F.length(b))
    budget = F.greatest(F.lit(0), F.floor((F.lit(1.0) - least) * longest + 1e-9)).cast("int")
    edits = F.call_function("levenshtein", a, b, budget)
    return F.when(edits >= 0, F.lit(1.0) - edits / F.nullif(longest, F.lit(0)))


def name_score(a: str | Column, b: str | Column) -> Column:
    """The better of plain similarity and 0.95 times the similarity of alphabetically sorted words."""
    a, b = as_col(a), as_col(b)
    return F.greatest(similarity(a, b), F.lit(TOKEN_SORT_WEIGHT) * similarity(sorted_tokens(a), sorted_tokens(b)))


def _edit_budget(length: int, threshold: float) -> int:
    """Most edits between a name of this length and any partner that still reaches the threshold."""
    return int((1 - threshold) * length / threshold + 1e-9)


def gram_size(threshold: float) -> int | None:
    """Largest q for which prefix filtering loses nothing at this threshold, or None.

    With r = (1 - threshold) / threshold, a name of n characters has at most r n edits, so q (r n) + 1 <= n - q + 1 holds
    from n = q / (1 - q r) on; only shorter names need the exact budget.
    """
    rate = (1 - threshold) / threshold
    for q in (4, 3, 2):
        if q * rate <= 0.99:
            short = range(1, math.ceil(q / (1 - q * rate)) + 1)
            budgets = {n: _edit_budget(n, threshold) for n in short}
            if all(q * k <= n - q for n, k in budgets.items() if k):
                return q
    return None


def _grams(names: DataFrame, text: str, q: int, threshold: float) -> DataFrame:
    """(name, gram, position, budget): all q-grams, or the whole name where only equality can match."""
    budget = F.floor(F.lit((1 - threshold) / threshold) * F.length(text) + 1e-9).cast("int")
    positions = F.sequence(F.lit(1), F.length(text) - (q - 1))
    pieces = F.when(
        F.col("budget") > 0,
        F.transform(positions, lambda p: F.struct(F.substring(F.col(text), p, F.lit(q)).alias("gram"), p.alias("at"))),
    ).otherwise(F.array(F.struct(F.concat(F.lit("="), F.col(text)).alias("gram"), F.lit(1).alias("at"))))
    return names.withColumn("budget", budget).select("*", F.inline(pieces))


def _rarest(grams: DataFrame, frequency: DataFrame, name: str, q: int, names_per_task: int) -> DataFrame:
    """The ``q * budget + 1`` rarest grams of every name. A name has boundedly many grams."""
    ranked = grams.join(frequency, "gram", "left").fillna(0, ["freq"])
    listed = ranked.groupBy(name).agg(
        F.max("budget").alias("budget"),
        F.array_sort(F.collect_list(F.struct("freq", "gram", "at"))).alias("sorted"),
    )
    prefix = F.slice("sorted", 1, F.lit(q) * F.col("budget") + 1)
    return listed.select(name, F.inline(prefix)).withColumn("parts", F.expr(f"int(freq div {names_per_task}) + 1"))


def _segment_layout(m: str, n: str) -> dict[str, str]:
    """SQL of segment i of a text of ``n`` characters cut into ``m`` even parts, the longer ones last: length and start."""
    short = f"({m} - {n} % {m})"
    return {"size": f"({n} div {m} + int(i > {short}))", "start": f"((i - 1) * ({n} div {m}) + greatest(0, i - 1 - {short}) + 1)"}


def _segments(names: DataFrame, text: str, threshold: float) -> DataFrame:
    """(text, n, i, piece): each name cut into one segment more than the edits that a name no longer than it may need."""
    where = _segment_layout("m", "n")
    cut = f"transform(sequence(1, m), i -> struct(i, substring({text}, {where['start']}, {where['size']}) as piece))"
    sized = names.withColumn("n", F.length(text)).withColumn("m", F.expr(f"int(floor((1 - {threshold!r}D) * n + 1e-9D)) + 1"))
    return sized.select(text, "n", F.expr(f"inline({cut})"))


def _probes(names: DataFrame, text: str, threshold: float, least_longer: int) -> DataFrame:
    """(text, n, i, piece): for each length n of a partner at least ``least_longer`` characters longer, and each of its
    segments, what stands in the name where the segment can stand.

    With m segments and at most m - 1 edits, some segment is whole, has i - 1 edits before it and at most m - i behind it
    (take the first i by which fewer than i edits have come). That bounds its shift from both ends of the name.
    """
    where = _segment_layout("m", "n")
    low = f"greatest(1, {where['start']} - (i - 1), {where['start']} + l - n - (m - i))"
    high = f"least(l - {where['size']} + 1, {where['start']} + (i - 1), {where['start']} + l - n + (m - i))"
    at = f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>))"
    found = f"flatten(transform(sequence(1, m), i -> transform({at}, p -> struct(i, substring({text}, p, {where['size']}) as piece))))"
    longer = F.expr(f"sequence(l + {least_longer}, greatest(l + {least_longer}, int(floor(l / {threshold!r}D + 1e-9D))))")
    sized = (
        names.withColumn("l", F.length(text))
        .withColumn("n", F.explode(longer))
        .withColumn("m", F.expr(f"int(floor((1 - {threshold!r}D) * n + 1e-9D)) + 1"))
    )
    return sized.select(text, "n", F.expr(f"inline(array_distinct({found}))"))


def _segment_pairs(left: DataFrame, right: DataFrame, threshold: float, names_per_task: int) -> DataFrame:
    """Pairs (a, b) that can reach the threshold by a shared segment of the longer of the two.

    A segment of very many names is split: each of its names goes to one of its parts, probes go to all of them.
    """
    keys = ["n", "i", "piece"]
    both = []
    for index, probe, shorter in ((("b", right), ("a", left), 0), (("a", left), ("b", right), 1)):
        held = _segments(index[1].select(index[0]), index[0], threshold)
        asked = _probes(probe[1].select(probe[0]), probe[0], threshold, shorter)
        hot = held.groupBy(*keys).agg(F.count("*").alias("names")).where(F.col("names") > names_per_task)
        hot = hot.select(*keys, F.expr(f"int(names div {names_per_task}) + 1").alias("parts"))
        held = held.join(hot, keys, "left").withColumn("part", F.expr(f"int(pmod(xxhash64({index[0]}), coalesce(parts, 1)))"))
        asked = asked.join(hot, keys, "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
        met = held.drop("parts").join(asked.drop("parts"), [*keys, "part"])
        both.append(met.select("a", "b"))
    # A pair that shares several segments is scored once.
    return both[0].unionByName(both[1]).distinct()


def _blocked_pairs(left: DataFrame, right: DataFrame, threshold: float, names_per_task: int) -> DataFrame:
    """Pairs (a, b) of distinct texts that can reach the similarity threshold."""
    q = gram_size(threshold)
    short = F.least(F.length("a"), F.length("b"))
    longest = F.greatest(F.length("a"), F.length("b"))
    fits = short >= F.lit(threshold) * longest - 1e-9
    if q is None:
        return _segment_pairs(left, right, threshold, names_per_task)
    grams_a, grams_b = _grams(left, "a", q, threshold), _grams(right, "b", q, threshold)
    frequency = grams_a.select("gram").unionAll(grams_b.select("gram")).groupBy("gram").agg(F.count("*").alias("freq"))
    # A frequent gram is split: each left name goes to one of its parts, right names go to all of them.
    # Both sides read the number of parts from the same frequency. The stated partition count keeps the growth
    # of the join out of few tasks.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_of = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    pre_a = _rarest(grams_a, frequency, "a", q, names_per_task).select("a", "gram", F.col("at").alias("at_a"), part_of.alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pre_b = _rarest(grams_b, frequency, "b", q, names_per_task).select("b", "gram", F.col("at").alias("at_b"), every.alias("part"))
    keys = ["gram", "part"]
    shift = F.lit(1 - threshold) * longest + 1e-9
    near = F.abs(F.col("at_a") - F.col("at_b")) <= shift
    joined = pre_a.repartition(tasks, *keys).join(pre_b.repartition(tasks, *keys), keys)
    # A pair that shares several rare grams is scored once.
    return joined.where(fits & near).select("a", "b").distinct()


def fuzzy_names(left: DataFrame, right: DataFrame, threshold: float, names_per_task: int | None = None) -> DataFrame:
    """(a, b, score) for all distinct name pairs whose ``name_score`` reaches the threshold, which must be above 0.

    A blocking key of more than ``names_per_task`` names is spread over several tasks; no pair is lost by it.
    """
    if threshold <= 0:
        raise ValueError("the similarity threshold must be above 0: every pair reaches 0")
    names_per_task = names_per_task or NAMES_PER_TASK
    parts = []
    plain = _blocked_pairs(left.select("a"), right.select("b"), threshold, names_per_task)
    parts.append(plain.select("a", "b", similarity_from(F.col("a"), F.col("b"), threshold).alias("score")))
    inner = threshold / TOKEN_SORT_WEIGHT
    if inner <= 1:
        ls = left.select("a", sorted_tokens("a").alias("sa"))
        rs = right.select("b", sorted_tokens("b").alias("sb"))
        pairs = _blocked_pairs(
            ls.select(F.col("sa").alias("a")).distinct(), rs.select(F.col("sb").alias("b")).distinct(), inner, names_per_task
        )
        scored = pairs.select(
            F.col("a").alias("sa"),
            F.col("b").alias("sb"),
            (F.lit(TOKEN_SORT_WEIGHT) * similarity_from(F.col("a"), F.col("b"), inner)).alias("score"),
        )
        close = scored.where(F.col("score") >= threshold).groupBy("sa", "sb").agg(F.max("score").alias("score"))
        parts.append(close.join(ls, "sa").join(rs, "sb").select("a", "b", "score"))
    both = reduce(lambda x, y: x.unionByName(y), parts).where(F.col("score") >= threshold)
    return both.groupBy("a", "b").agg(F.max("score").alias("score"))


def link_fuzzy(firms: DataFrame, registry: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Best registry names per distinct firm name, expanded to all registry rows of those names."""
    # Both name lists feed several branches of the join, so they are cleaned and written once.
    left = pinned(firms.select(F.col("firm_name_norm").alias("a")).where(F.col("a") != "").distinct())
    right = pinned(registry.select(F.col("sec_name_norm").alias("b")).where(F.col("b") != "").distinct())
    pairs = fuzzy_names(left, right, config.fuzzy_threshold)
    top = top_k_per_key(pairs, ["a"], [F.desc("score"), F.col("b")], config.fuzzy_limit, "__rank")
    return top.join(registry, top["b"] == registry["sec_name_norm"]).select(
        F.col("a").alias("firm_name_norm"), *REGISTRY_COLUMNS, "score", F.lit("fuzzy_name").alias("method")
    )


def _name_matches(firms: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows with the same normalised or compact name. A registry row has one of each, so these joins
    on distinct firm names cannot multiply it."""
    names = firms.select("firm_name_norm").where(F.col("firm_name_norm") != "").distinct()
    names = names.withColumn("__compact", F.replace("firm_name_norm", F.lit(" "), F.lit("")))
    found = [
        ("firm_name_norm", "sec_name_norm", EXACT_NAME_SCORE, "exact_normalized_name"),
        ("__compact", "sec_name_compact", COMPACT_NAME_SCORE, "exact_compact_name"),
    ]
    frames = [
        names.join(registry, F.col(mine) == F.col(theirs)).select(
            "firm_name_norm", *REGISTRY_COLUMNS, F.lit(score).alias("score"), F.lit(method).alias("method")
        )
        for mine, theirs, score, method in found
    ]
    return frames[0].unionByName(frames[1])


def _hinted(firms: DataFrame) -> DataFrame:
    """Distinct profiles (firm_name_norm, ticker_hint) that have a hint."""
    hinted = firms.select("firm_name_norm", "ticker_hint").where(F.col("ticker_hint") != "").distinct()
    return hinted.withColumn("__fs", sorted_tokens("firm_name_norm"))


def _ticker_score(similar: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(similar, F.lit(0.0)) + TICKER_BONUS)


def _ticker_matches(firms: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows under a firm's ticker hint, scored by name. The rows are made by the last join and sent nowhere.

    A ticker is cut into parts of about ``PAIRS_PER_TASK`` pairs: each part has some of its registry rows and all of its
    profiles, so that the scoring is spread even where a ticker is held by most rows.
    """
    hinted = _hinted(firms)
    held = registry.where(F.col("ticker") != "").groupBy("ticker").agg(F.count("*").alias("__rows"))
    asked = hinted.groupBy(F.col("ticker_hint").alias("ticker")).agg(F.count("*").alias("__profiles"))
    pairs = F.col("__rows") * F.col("__profiles")
    parts = F.least(F.col("__rows"), F.floor(pairs / F.lit(PAIRS_PER_TASK)) + 1)
    layout = pinned(held.join(asked, "ticker").select("ticker", parts.alias("__parts")))
    tasks = min(max(_partitions(layout), layout.agg(F.sum("__parts")).first()[0] or 0), MOST_TASKS)
    listed = registry.withColumn("__rs", sorted_tokens("sec_name_norm")).join(layout, "ticker")
    listed = listed.withColumn("__part", F.pmod(F.xxhash64(*registry.columns), F.col("__parts")))
    # Both sides are dealt by number: whichever is broadcast in the end, the other keeps its tasks.
    listed = listed.repartition(tasks, "ticker", "__part")
    spread = hinted.join(layout.withColumnRenamed("ticker", "ticker_hint"), "ticker_hint")
    spread = spread.withColumn("__at", F.explode(F.expr("sequence(0L, __parts - 1)"))).repartition(tasks, "ticker_hint", "__at")
    plain = similarity(F.col("firm_name_norm"), F.col("sec_name_norm"))
    swapped = F.lit(TOKEN_SORT_WEIGHT) * similarity(F.col("__fs"), F.col("__rs"))
    similar = F.when(F.col("firm_name_norm") != "", F.greatest(plain, swapped))
    here = (F.col("ticker_hint") == F.col("ticker")) & (F.col("__at") == F.col("__part"))
    return spread.drop("__parts").join(listed.drop("__parts"), here).select(
        "firm_name_norm", "ticker_hint", *REGISTRY_COLUMNS, "sec_name_norm", _ticker_score(similar).alias("score")
    )


def ticker_leaders(firms: DataFrame, registry: DataFrame, k: int, seeds: int = 4) -> DataFrame:
    """(firm_name_norm, ticker_hint, cik): the ``k`` best registry ids under each profile's hint, ties by id.

    Two passes. Names near in length, ``seeds * k`` of each ticker and length, give every profile ids of its own and with
    them the score that others must reach. Only names whose length can reach it are visited then, and their edit distance
    stops where it can no longer be reached. Of either pass a task sends on no more than the leading rows of a profile.
    """
    profile = ["firm_name_norm", "ticker_hint"]
    rows = registry.where(F.col("ticker") != "").select("ticker", "sec_name_norm", "cik").distinct()
    # An id with several names under a ticker takes several places; so many more rows hold the k best ids.
    names_of_id = rows.groupBy("ticker", "cik").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    places = k * names_of_id
    by_name = top_k_per_key(rows, ["ticker", "sec_name_norm"], [F.col("cik")], places, "__nth")
    listed = by_name.select(
        "ticker", "sec_name_norm", "cik", sorted_tokens("sec_name_norm").alias("__rs"), F.coalesce(F.length("sec_name_norm"), F.lit(0)).alias("__n")
    )
    hinted = _hinted(firms).withColumn("__l", F.length("firm_name_norm"))

    def leaders(met: DataFrame, least: Column) -> DataFrame:
        plain = similarity_from(F.col("firm_name_norm"), F.col("sec_name_norm"), least)
        swapped = F.lit(TOKEN_SORT_WEIGHT) * similarity_from(F.col("__fs"), F.col("__rs"), least)
        similar = F.when(F.col("firm_name_norm") != "", F.greatest(plain, swapped))
        # Where the name cannot matter any more, the hint alone counts.
        scored = met.withColumn("score", _ticker_score(similar)).where(similar.isNotNull() | (least <= 0))
        return top_k_per_key(scored, profile, [F.desc("score"), F.col("cik")], places, "__nth").select(*profile, "cik", "score")

    def best_ids(found: DataFrame) -> DataFrame:
        return found.groupBy(*profile, "cik").agg(F.max("score").alias("score"))

    first = listed.withColumn("__nth", F.row_number().over(W.partitionBy("ticker", "__n").orderBy(F.xxhash64("cik", "sec_name_norm"))))
    first = first.where(F.col("__nth") <= seeds * k).drop("__nth")
    near = hinted.withColumn("__at", F.explode(F.expr("sequence(greatest(0, __l - 1), __l + 1)")))
    here = (F.col("ticker_hint") == F.col("ticker")) & (F.col("__at") == F.col("__n"))
    seeded = pinned(best_ids(leaders(near.join(first, here), F.lit(0.0))))
    kth = top_k_per_key(seeded, profile, [F.desc("score"), F.col("cik")], k, "__nth").groupBy(*profile).agg(
        F.when(F.count("*") >= k, F.min("score")).alias("__kth")
    )
    # A score of 1 is capped: names below it by no more than the bonus tie with it.
    least = F.greatest(F.lit(0.0), F.coalesce(F.col("__kth") - TICKER_BONUS, F.lit(0.0)) - 1e-9)
    bounded = hinted.join(kth, profile, "left").withColumn("__least", least).drop("__kth")
    lengths = listed.select(F.col("ticker").alias("ticker_hint"), F.col("__n").alias("__at")).distinct()
    fits = F.least("__l", "__at") >= F.col("__least") * F.greatest("__l", "__at") - 1e-9
    visits = bounded.join(lengths, "ticker_hint").where(fits)
    return top_k_per_key(
        best_ids(leaders(visits.join(listed, here), F.col("__least"))), profile, [F.desc("score"), F.col("cik")], k, "__nth"
    ).select(*profile, "cik")


def link_exact(firms: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates by equal normalised name, equal compact name and equal ticker hint."""
    named = _name_matches(firms, registry).withColumn("ticker_hint", F.lit(None).cast("string"))
    by_ticker = _ticker_matches(firms, registry).withColumn("method", F.lit("ticker_hint"))
    return named.unionByName(by_ticker.select(*named.columns))


def method_rank(method: str | Column) -> Column:
    out = F.lit(9)
    for name, rank in METHOD_RANK.items():
        out = F.when(as_col(method) == name, rank).otherwise(out)
    return out


CANDIDATE = ("cik", "ticker", "sec_name", "exchange", "score", "method", "method_rank")
ATTRIBUTE_ORDER = ("sec_name", "ticker", "exchange")


def name_candidates(firms: DataFrame, registry: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Best candidate per firm name and registry id from equal and similar names."""
    both = _name_matches(firms, registry).unionByName(link_fuzzy(firms, registry, config))
    ranked = both.withColumn("method_rank", method_rank("method"))
    order = F.struct((-F.col("score")).alias("s"), "method_rank", *ATTRIBUTE_ORDER)
    rest = CANDIDATE[1:]
    best = ranked.groupBy("firm_name_norm", "cik").agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select("firm_name_norm", "cik", *[f"best.{c}" for c in rest])


def _top_by_ticker(firms: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """The k best registry ids per hinted profile with the attributes of their best row."""
    keys = ["firm_name_norm", "ticker_hint", "cik"]
    top = ticker_leaders(firms, registry, k).withColumnRenamed("cik", "__id")
    wanted = top.join(registry, (F.col("ticker_hint") == F.col("ticker")) & (F.col("__id") == F.col("cik"))).drop("__id")
    similar = F.when(F.col("firm_name_norm") != "", name_score("firm_name_norm", "sec_name_norm"))
    score = _ticker_score(similar)
    scored = wanted.withColumns(
        {"score": score, "method": F.lit("ticker_hint"), "method_rank": method_rank(F.lit("ticker_hint"))}
    )
    best = keep_best(scored, keys, [F.desc("score"), *[F.col(c) for c in ATTRIBUTE_ORDER]])
    return best.select("firm_name_norm", "ticker_hint", *CANDIDATE)


def link_resolve(
    firms: DataFrame, registry: DataFrame, config: LinkConfig = LinkConfig()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, top candidates, conflicts) for prepared firms. Links hold one row per firm, unlinked ones too.

    Name candidates do not depend on hints, so each firm name is resolved once. Of either kind only the leading
    few per profile can reach the result; the rest is only counted.
    """
    profile = ["firm_name_norm", "ticker_hint"]
    order = [F.desc("score"), F.col("method_rank"), F.col("cik")]
    k = max(config.top_n_candidates, 2)
    named = pinned(name_candidates(firms, registry, config))
    profiles = firms.select(*profile).distinct()

    top_named = top_k_per_key(named, ["firm_name_norm"], order, k, "__rank").drop("__rank").join(profiles, "firm_name_norm")
    leading = top_named.select(*profile, *CANDIDATE).unionByName(_top_by_ticker(firms, registry, k))
    once = keep_best(leading, [*profile, "cik"], order)
    ranked = top_k_per_key(once, profile, order, k, "candidate_rank")

    n_named = named.groupBy("firm_name_norm").agg(F.count("*").alias("__named"))
    # Ids under a profile's hint: all ids of the ticker, less those already found by name.
    under = registry.where(F.col("ticker") != "").select(F.col("ticker").alias("ticker_hint"), "cik").distinct()
    n_under = under.groupBy("ticker_hint").agg(F.count("*").alias("__under"))
    n_both = (
        profiles.where(F.col("ticker_hint") != "")
        .join(named.select("firm_name_norm", "cik"), "firm_name_norm")
        .join(under, ["ticker_hint", "cik"])
        .groupBy(*profile)
        .agg(F.count("*").alias("__both"))
    )
    n_extra = (
        profiles.join(n_under, "ticker_hint")
        .join(n_both, profile, "left")
        .select(*profile, (F.col("__under") - F.coalesce("__both", F.lit(0))).alias("__extra"))
    )
    first = F.col("candidate_rank") == 1
    heads = ranked.groupBy(*profile).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in REGISTRY_COLUMNS],
        F.max(F.when(first, F.col("method"))).alias("link_method"),
        F.max(F.when(first, F.col("score"))).alias("link_score"),
        F.max(F.when(F.col("candidate_rank") == 2, F.col("score"))).alias("__second"),
    )
    gap = (F.col("link_score") - F.col("__second")) < config.score_gap_for_conflict
    links = (
        firms.join(heads, profile, "left")
        .join(n_named, "firm_name_norm", "left")
        .join(n_extra, profile, "left")
        .fillna({"link_method": "unlinked", "link_score": 0.0, "__named": 0, "__extra": 0})
        .withColumns(
            {
                "link_conflict": F.coalesce(gap, F.lit(False)),
                "candidate_count": F.col("__named") + F.col("__extra"),
            }
        )
        .select(
            "gvkey", "firm_name", "patent_count", *REGISTRY_COLUMNS, "link_method", "link_score",
            "link_conflict", "candidate_count", "ticker_hint",
        )
    )
    shown = ranked.where(F.col("candidate_rank") <= config.top_n_candidates)
    top = firms.join(shown, profile).select(
        "gvkey", "firm_name", "patent_count", "candidate_rank",
        F.col("cik").alias("candidate_cik"),
        F.col("ticker").alias("candidate_ticker"),
        F.col("sec_name").alias("candidate_sec_name"),
        F.col("exchange").alias("candidate_exchange"),
        F.col("method").alias("candidate_method"),
        F.col("score").alias("candidate_score"),
        "ticker_hint",
    )
    conflicts = links.where("link_conflict").join(top, ["gvkey", "firm_name", "patent_count", "ticker_hint"], "left")
    return links, top, conflicts


def link_firms(
    firms: DataFrame, registry: DataFrame, hints: DataFrame | None = None, config: LinkConfig = LinkConfig()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole linking job on raw firms (gvkey, firm_name, patent_count) and a prepared registry."""
    return link_resolve(prepare_firms(firms, hints), registry, config)


def manual_override(links: DataFrame, manual: DataFrame, registry: DataFrame) -> DataFrame:
    """Links with hand-made ids put in, and registry attributes taken afresh for every id."""
    by_hand = manual.select("gvkey", pad_id("cik").alias("__manual"))
    fixed = F.col("__manual").isNotNull()
    reference = keep_best(
        registry.select(*REGISTRY_COLUMNS), ["cik"], [F.col("sec_name"), F.col("ticker"), F.col("exchange")]
    )
    return (
        links.join(by_hand, "gvkey", "left")
        .withColumns(
            {
                "cik": F.coalesce("__manual", "cik"),
                "link_method": F.when(fixed, "manual_override").otherwise(F.col("link_method")),
                "link_score": F.when(fixed, 1.0).otherwise(F.col("link_score")),
                "link_conflict": F.when(fixed, False).otherwise(F.col("link_conflict")),
            }
        )
        .drop("__manual", "ticker", "sec_name", "exchange")
        .join(reference, "cik", "left")
    )


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
    return df


def manual_links(df: DataFrame) -> DataFrame:
    require_columns(df, ["gvkey", "cik"], "manual link file")
    return df.select("gvkey", pad_id("cik").alias("cik"), F.lit("manual_override").alias("link_method"))


def ticker_hints(df: DataFrame) -> DataFrame:
    return clean_hints(require_columns(df, ["gvkey", "ticker"], "ticker hints file"))


def series_names(df: DataFrame) -> Mapping[str, str]:
    """A user's small series map as a dictionary."""
    require_columns(df, ["series_id", "metric_name"], "series map")
    return {str(r[0]): str(r[1]) for r in df.select("series_id", "metric_name").collect()}
