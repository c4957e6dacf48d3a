"""Key figures over sessions and transactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.numbers import percent_change, ratio, share_of_rows
from visitloom.operators.joins import null_safe_join

FIGURES = ("user_pseudo_id", "session_id", "transaction_id", "revenue")


def _figures(revenue: str, digits: int | None) -> list[Column]:
    total = F.sum("revenue")
    if revenue == "zero":
        total = F.coalesce(total, F.lit(0.0))
    if digits is not None:
        total = F.round(total, digits)
    return [
        F.count_distinct("user_pseudo_id").alias("users"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("transaction_id").alias("transactions"),
        total.alias("revenue"),
    ]


def session_sales(
    sessions: DataFrame,
    transactions: DataFrame,
    join_keys: Sequence[str],
    keys: Sequence[str],
    copies: str | None = None,
) -> DataFrame:
    """Rows whose distinct counts and sum equal those of sessions LEFT JOIN
    transactions.

    Users and sessions come from the sessions alone; transactions and revenue
    from the inner join, where revenue repeats once per matching session row,
    exactly as in the left join. The point of the split: AQE can divide a hot
    key on either side of an inner join, but only on the left of a left one.

    The join is null-safe against transactions without NULL keys. A plain one
    would push "key is not NULL" below the aggregation that made the sessions;
    the two uses would then differ, and their common shuffle would run twice.
    """
    amount = F.col("revenue").cast("double")
    if copies:
        amount = amount * F.col(copies)
    visits = sessions.select(
        *keys,
        "user_pseudo_id",
        "session_id",
        F.lit(None).cast(transactions.schema["transaction_id"].dataType).alias("transaction_id"),
        F.lit(None).cast("double").alias("revenue"),
    )
    keyed = transactions.dropna(subset=list(join_keys))
    sales = null_safe_join(sessions, keyed, join_keys).select(
        *keys,
        F.lit(None).cast(sessions.schema["user_pseudo_id"].dataType).alias("user_pseudo_id"),
        F.lit(None).cast(sessions.schema["session_id"].dataType).alias("session_id"),
        "transaction_id",
        amount.alias("revenue"),
    )
    return visits.unionByName(sales)


def session_kpi(
    sessions: DataFrame,
    transactions: DataFrame,
    keys: Sequence[str],
    *,
    join_keys: Sequence[str] = ("brand", "session_id"),
    copies: str | None = None,
    revenue: str = "sum",
    digits: int | None = 2,
) -> DataFrame:
    """Users, sessions, transactions and revenue per key.

    ``sessions`` may hold one session several times (one row per date, say);
    its revenue then counts once per row. Rows that were counted together name
    the column with their number in ``copies``. ``revenue`` is 'sum' (NULL
    without a sale) or 'zero'. No keys gives one row.
    """
    rows = session_sales(sessions, transactions, join_keys, keys, copies)
    return rows.groupBy(*keys).agg(*_figures(revenue, digits))


def session_kpi_with_total(
    sessions: DataFrame,
    transactions: DataFrame,
    keys: Sequence[str],
    group: str,
    *,
    join_keys: Sequence[str] = ("brand", "session_id"),
    total: str = "All",
    revenue: str = "zero",
    digits: int | None = 2,
) -> DataFrame:
    """As ``session_kpi`` per (keys, group), plus one ``total`` row per keys.

    Grouping sets count the total anew from the same rows, so a user seen in
    two groups counts once in it. One scan serves both levels.
    """
    rows = session_sales(sessions, transactions, join_keys, [*keys, group])
    grouped = rows.groupingSets([[*keys, group], list(keys)], *keys, group).agg(
        F.grouping(group).alias("_total"), *_figures(revenue, digits)
    )
    label = F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(group))
    return grouped.withColumn(group, label).drop("_total")


def collapse(events: DataFrame, keys: Sequence[str], copies: str = "copies") -> DataFrame:
    """Equal event rows as one session row with their number, so that a KPI over
    event rows moves sessions and not events."""
    return events.groupBy(*keys, "user_pseudo_id", "session_id").agg(F.count(F.lit(1)).alias(copies))


def wide_kpi(
    report: DataFrame, keys: Sequence[str], *, revenue_col: str = "purchase_revenue", digits: int | None = 2
) -> DataFrame:
    """The same figures from a table that already holds session x transaction."""
    rows = report.select(
        *keys, "user_pseudo_id", "session_id", "transaction_id", F.col(revenue_col).alias("revenue")
    )
    return rows.groupBy(*keys).agg(*_figures("sum", digits))


def segment_rows(df: DataFrame, segments: Mapping[str, Column], name: str = "segment") -> DataFrame:
    """Each row once per segment it belongs to; one scan for all segments."""
    labels = F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in segments.items()]))
    return df.withColumn(name, F.explode(labels))


def year_over_year(
    df: DataFrame, keys: Sequence[str], *, period: str = "period", digits: int = 2
) -> DataFrame:
    """Current and previous figures side by side, with their change in percent.

    Conversion and order value are ratios of the period's own figures; their
    change is computed from the ratios, not from the changes.
    """
    sides = {"current": "Current Year", "previous": "Previous Year"}
    measures = []
    for side, label in sides.items():
        own = lambda c, label=label: F.when(F.col(period) == label, F.col(c))
        measures += [
            F.count_distinct(own("user_pseudo_id")).alias(f"users_{side}"),
            F.count_distinct(own("session_id")).alias(f"sessions_{side}"),
            F.count_distinct(own("transaction_id")).alias(f"transactions_{side}"),
            F.round(F.sum(own("revenue")), digits).alias(f"revenue_{side}"),
        ]
    table = df.groupBy(*keys).agg(*measures)
    for side in sides:
        table = table.withColumns(
            {
                f"conversion_rate_{side}": ratio(F.col(f"transactions_{side}"), F.col(f"users_{side}")),
                f"average_order_value_{side}": ratio(
                    F.col(f"revenue_{side}"), F.col(f"transactions_{side}")
                ),
            }
        )
    changes = {
        f"{m}_yoy_change": percent_change(F.col(f"{m}_current"), F.col(f"{m}_previous"))
        for m in (
            "users", "sessions", "transactions", "revenue", "conversion_rate", "average_order_value",
        )
    }
    return table.withColumns(changes)


def with_shares(
    df: DataFrame, shares: Mapping[str, str], within: Sequence[str], digits: int = 2
) -> DataFrame:
    """Adds ``shares`` (metric to share name): percentage of the metric within
    its partition; meant for aggregated rows.

    The totals are a second, partial aggregate joined back, so no partition is
    gathered in one task.
    """
    totals = df.groupBy(*within).agg(*[F.sum(m).alias(f"_all_{m}") for m in shares])
    joined = null_safe_join(df, totals, within)
    return joined.withColumns(
        {name: F.round(F.col(m) / F.col(f"_all_{m}") * 100, digits) for m, name in shares.items()}
    ).drop(*[f"_all_{m}" for m in shares])


def daily_signals(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions per key, and the counts of each bot signal among the sessions
    with one page view and no purchase."""
    c = F.col
    base = (c("pageviews") == 1) & ~c("did_purchase")
    system = F.lower("device_operating_system")
    signals = {
        "sessions_same_lp_1pv_non_purchase": F.lit(True),
        "suspected_bot_sessions": c("suspected_bot"),
        "session_duration_0s": c("event_span_s") == 0,
        "session_duration_le_3s": c("event_span_s") <= 3,
        "no_user_engagement_event": c("user_engagement_events") == 0,
        "session_engagement_0ms": c("session_engagement_time_msec") == 0,
        "no_geo_city": c("geo_city").isNull() | (c("geo_city") == ""),
        "ios_sessions": system == "ios",
        "macintosh_sessions": system == "macintosh",
    }
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        *[F.count_if(base & cond).alias(name) for name, cond in signals.items()],
    )


def cohort_rates(df: DataFrame, cohort: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Sessions per cohort and the share of them that meets each condition."""
    return df.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("sessions"),
        *[share_of_rows(cond).alias(name) for name, cond in conditions.items()],
    )


def organic_revenue(
    report: DataFrame, page_types: Sequence[str], *, keys: Sequence[str] = ("brand",), mode: str = "all"
) -> DataFrame:
    """Revenue of organic-like landings: organic medium, or untagged traffic
    without promotion marks in the landing URL.

    ``mode='any'`` accepts a URL that lacks either mark, ``'all'`` one that
    lacks both.
    """
    url = F.col("landing_page_location")
    no_promo, no_campaign = ~url.like("%promoCode=%"), ~url.like("%cid=%")
    unmarked = (no_promo | no_campaign) if mode == "any" else (no_promo & no_campaign)
    organic = (F.col("lnd_medium") == "organic") | (
        (F.col("lnd_source_medium") == "none / none") & unmarked
    )
    return (
        report.where(F.col("landing_page_type").isin(*page_types) & organic)
        .groupBy(*keys)
        .agg(F.round(F.sum("purchase_revenue"), 2).alias("revenue"))
    )
