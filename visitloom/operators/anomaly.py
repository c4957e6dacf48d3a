"""Anomaly scores over session features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions import rules
from visitloom.functions.numbers import z_score
from visitloom.operators.joins import null_safe_join
from visitloom.operators.kpi import with_shares
from visitloom.sources.staging import stage


def baseline(df: DataFrame, scores: dict[str, str], by: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each value column per group."""
    stats = []
    for value, name in scores.items():
        stats += [F.avg(value).alias(f"_m_{name}"), F.stddev(value).alias(f"_s_{name}")]
    return df.groupBy(*by).agg(*stats)


def scored_against(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Scores from the baseline columns that were joined to the rows."""
    return df.withColumns(
        {
            name: z_score(F.col(value), F.col(f"_m_{name}"), F.nullif(F.col(f"_s_{name}"), F.lit(0.0)))
            for value, name in scores.items()
        }
    ).drop(*[f"_{k}_{n}" for n in scores.values() for k in "ms"])


def with_z_scores(df: DataFrame, scores: dict[str, str], baseline_by: Sequence[str]) -> DataFrame:
    """Adds ``scores`` (value column to score name) against the mean and sample
    deviation of the row's baseline group."""
    return scored_against(df.join(baseline(df, scores, baseline_by), list(baseline_by), "left"), scores)


def count_z_scores(counts: DataFrame, name: str, per: Sequence[str], baseline_by: Sequence[str]) -> DataFrame:
    """Score of each group's ``n`` against the groups that share its baseline
    keys. Groups without rows are absent, not zero."""
    return with_z_scores(counts.select(*per, "n"), {"n": name}, baseline_by).select(*per, name)


DAY = ("session_date", "traffic_type")
#: Score, the columns that tell its groups apart besides the day and traffic, and those that tell its baselines apart.
CONTEXTS = {
    "daily_z_sessions": ((), ()),
    "os_z_sessions": (("operating_system",), ("operating_system",)),
    "device_z_sessions": (("device_category",), ("device_category",)),
    "geo_z_sessions": (("city",), ("city",)),
    "user_z_sessions": (("brand", "user_pseudo_id"), ("brand",)),
}
OWN = {"engagement_seconds": "z_eng", "event_count": "z_evt", "pageviews": "z_pv"}


def context_scores(features: DataFrame) -> DataFrame:
    """One row per group of each context, named by ``score``, with its ``z``.

    Distinct sessions of all contexts are counted in one pass with grouping
    sets. Baselines are moments (number, mean and deviation of the counts) of
    groups that differ in the day or user only, again one aggregate for all
    contexts, which adds up on the map side. Columns foreign to a context are
    NULL; ``score`` tells that from a group whose value is NULL.
    """
    extra = ["operating_system", "device_category", "city", "brand", "user_pseudo_id"]
    sets = [[*DAY, *own] for own, _ in CONTEXTS.values()]
    level = {name: sum(1 << (len(extra) - 1 - i) for i, c in enumerate(extra) if c not in own)
             for name, (own, _) in CONTEXTS.items()}
    named = F
    for name, bits in level.items():
        named = named.when(F.grouping_id() == bits, name)
    counts = features.groupingSets(sets, *DAY, *extra).agg(
        named.alias("score"), F.count_distinct("session_key").alias("n")
    )
    counts = stage(counts)
    within = {c: F.when(F.col("score").isin([n for n, (_, by) in CONTEXTS.items() if c in by]), F.col(c)) for c in extra}
    grouped = counts.withColumns({f"_b_{c}": v for c, v in within.items()})
    by = ["score", "traffic_type", *(f"_b_{c}" for c in extra)]
    moments = grouped.groupBy(*by).agg(F.avg("n").alias("_m_z"), F.stddev("n").alias("_s_z"))
    scored = scored_against(null_safe_join(grouped, moments, by), {"n": "z"})
    return scored.select("score", *DAY, *extra, "z")


def score_sessions(features: DataFrame) -> DataFrame:
    """Session features with their own z-scores and those of their day, system,
    device, place and user.

    The features are written once to the staging folder, as several aggregates
    read them. On the way to the scores they are moved twice at most, whatever
    does not fit a broadcast: once to the context of their user, once to that of
    their day and city. The latter carries the scores of the day's systems and
    devices along, in a short map each (these are names from short lists), and
    the moments of the session's own baseline, which has one row per traffic
    type. A value that is NULL has no context, and its score is 0.
    """
    features = stage(features)
    scores = stage(context_scores(features))
    of = lambda name: scores.where(F.col("score") == name)
    listed = lambda name, column: (
        of(name).where(F.col(column).isNotNull())
        .groupBy(*DAY).agg(F.map_from_entries(F.collect_list(F.struct(column, "z"))).alias(f"_{name}"))
    )
    daily = of("daily_z_sessions").select(*DAY, F.col("z").alias("daily_z_sessions"))
    daily = daily.join(baseline(features, OWN, ["traffic_type"]), "traffic_type", "left")
    daily = null_safe_join(daily, listed("os_z_sessions", "operating_system"), DAY, "left")
    daily = null_safe_join(daily, listed("device_z_sessions", "device_category"), DAY, "left")
    cities = of("geo_z_sessions").select(*DAY, "city", F.col("z").alias("_city"))
    placed = stage(null_safe_join(cities, daily, DAY))
    scored = null_safe_join(features, placed, [*DAY, "city"], "left")
    dated = F.col("session_date").isNotNull() & F.col("traffic_type").isNotNull()
    known = lambda z: F.coalesce(F.when(dated, z), F.lit(0.0))
    scored = scored.withColumns(
        {
            "daily_z_sessions": known(F.col("daily_z_sessions")),
            "os_z_sessions": known(F.col("_os_z_sessions")[F.col("operating_system")]),
            "device_z_sessions": known(F.col("_device_z_sessions")[F.col("device_category")]),
            "geo_z_sessions": known(F.when(F.col("city").isNotNull(), F.col("_city"))),
        }
    ).drop("_os_z_sessions", "_device_z_sessions", "_city")
    scored = scored_against(scored, OWN)
    user_day = [*DAY, "brand", "user_pseudo_id"]
    users = of("user_z_sessions").select(*user_day, F.col("z").alias("user_z_sessions"))
    joined = scored.join(users, user_day, "left")
    return joined.withColumn("user_z_sessions", F.coalesce("user_z_sessions", F.lit(0.0)))


def classify_sessions(scored: DataFrame, spike_traffic: str) -> DataFrame:
    return scored.withColumn("session_class", rules.bot_class(spike_traffic))


def class_summary(classified: DataFrame) -> DataFrame:
    """Sessions, users and purchases per class and day, with their shares.

    The summary is staged, as its totals are computed from it: a handful of rows
    is read back, and the scoring before it runs once.
    """
    within = ["session_date", "brand", "traffic_type"]
    summary = classified.groupBy(*within, "session_class").agg(
        F.count_distinct("session_key").alias("sessions"),
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count_if(F.col("has_conversion") == 1).alias("purchases"),
    )
    return with_shares(
        stage(summary), {"sessions": "pct_sessions_within_day", "users": "pct_users_within_day"}, within
    )
