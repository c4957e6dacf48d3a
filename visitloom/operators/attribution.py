"""First touch, purchases and what happened before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.dates import Day, in_days
from visitloom.sources.staging import stage


def first_by(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Values of the row with the lowest order tuple per key, NULL sorting first.

    No group is collected; Spark sorts the rows of a task by key, as a struct
    is no fixed-width value. End the order with an id, or ties are undecided.
    """
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return picked.select(*keys, "_first.*")


def first_non_null(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per key, the first non-NULL of each value by the order, independently, so
    the values may come from different rows.

    Rows first shrink to one per key and combination of values, with its lowest
    order, in which NULL comes first. For an order of a time and a whole number
    that is a fixed-width minimum: tasks hash the rows and sort nothing before
    the first shuffle.
    """
    lowest = df.groupBy(*keys, *values).agg(F.min(order_key(df, order)).alias("_o"))
    return lowest.groupBy(*keys).agg(
        *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_o"))).alias(v) for v in values]
    )


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """The order as one value that is never NULL: a decimal for a time and a
    whole number, which aggregates without a sort; else a struct.

    The decimal has the microseconds before the number, each with a lowest value
    of its own for NULL, so both forms order alike, negative numbers included.
    Times beyond the year 33,658 do not fit and raise.
    """
    types = [df.schema[c].dataType.typeName() for c in order]
    if len(order) != 2 or types[0] not in ("timestamp", "timestamp_ntz") or types[1] not in ("long", "integer"):
        return F.struct(*order)
    ts, number = (f"`{c}`" for c in order)
    micros = f"unix_micros({ts})" if types[0] == "timestamp" else _micros(ts)
    time = f"cast(coalesce({micros}, -1000000000000000000) as decimal(19, 0))"
    place = f"coalesce(cast({number} as decimal(20, 0)) + 9223372036854775809, 0)"
    return F.expr(f"cast({time} * 20000000000000000000 + {place} as decimal(38, 0))")


def _micros(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))"


def order_sql(ts: str, number: str) -> str:
    """Microseconds and a whole number from 0 below 10 ** 19 in one decimal, from which the number can be read
    back; NULL if either is."""
    return f"cast(cast({_micros(ts)} as decimal(18, 0)) * 10000000000000000000 + {number} as decimal(38, 0))"


def first_touch(
    sessions: DataFrame,
    values: Sequence[str],
    *,
    user: str = "user_pseudo_id",
    session: str = "session_id",
    number: str = "ga_session_number",
    start: str = "session_start_timestamp_utc",
) -> DataFrame:
    """The user's first session: by number where that is also the earliest one,
    else by start time; ``first_touch_disagrees`` tells which users differ.

    Both picks come from one pass. A missing number sorts first.
    """
    row = F.struct(session, *[c for c in values if c != session])
    picks = (
        sessions.where(F.col(start).isNotNull())
        .groupBy(user)
        .agg(
            F.min_by(row, F.struct(number, start, session)).alias("by_num"),
            F.min_by(row, F.struct(start, number, session)).alias("by_time"),
        )
    )
    same = F.col(f"by_num.{session}") == F.col(f"by_time.{session}")
    return picks.select(
        user,
        F.when(same, F.col("by_num")).otherwise(F.col("by_time")).alias("ft"),
        (~same).alias("first_touch_disagrees"),
    )


def exclude_ambiguous(df: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """Drops the keys that have more than one row in ``source``."""
    repeated = source.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return df.join(repeated, key, "left_anti")


def only_single(df: DataFrame, key: str) -> DataFrame:
    """The rows that are the only ones of their key.

    What ``exclude_ambiguous(df, key, df)`` gives for known keys, in one pass:
    a group of one row is its own aggregate, and larger groups shrink to a
    count on the map side.
    """
    counted = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[c for c in df.columns if c != key])).alias("_row")
    )
    return counted.where("_n = 1").select(key, "_row.*").select(*df.columns)


def of_users(df: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """Rows of the users that occur in ``users``."""
    return df.join(users.select(user).distinct(), user, "left_semi")


def purchase_rows(orders: DataFrame, report: DataFrame, order_id: str = "order_id") -> DataFrame:
    """Report rows whose transaction is one of the orders."""
    ids = orders.select(F.col(order_id).alias("transaction_id"))
    return report.join(ids, "transaction_id")


def purchase_snapshot(purchases: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per (brand, user, transaction): first date and start, summed
    revenue, and one value of each attribute (the lowest, to be repeatable)."""
    return purchases.groupBy("brand", "user_pseudo_id", "transaction_id").agg(
        F.min("date").alias("purchase_date"),
        F.min("session_start_timestamp_utc").alias("purchase_ts"),
        F.sum("purchase_revenue").alias("revenue"),
        *[F.min(a).alias(f"purchase_{name}") for a, name in _named(attributes)],
    )


def _named(attributes: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, "session_number" if a == "ga_session_number" else a) for a in attributes]


def _seconds(df: DataFrame, ts: str) -> Column:
    """Seconds since 1970. A zone-less clock is read as it stands: in a session
    zone with daylight saving, a cast would let some times trade places."""
    t = F.col(ts)
    if df.schema[ts].dataType.typeName() != "timestamp_ntz":
        return F.unix_seconds(t.cast("timestamp"))
    return F.unix_date(t.cast("date")) * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def count_until(
    points: DataFrame,
    anchors: DataFrame,
    key: str,
    ts: str,
    name: str,
    *,
    bucket_seconds: int = 60,
) -> DataFrame:
    """For each distinct (key, ts) of ``anchors``: points of the key with time <= ts.

    A join on key and time would emit every pair, which for a key with n points
    and m anchors is n * m rows. This is a running count in two levels instead:
    points of one time collapse to a number, numbers run within a (key, bucket)
    window, and bucket totals run within a key. The largest window is one
    bucket of one key, or one row per bucket of one key, whatever the key holds.
    """
    ticks = (
        points.select(key, ts, F.lit(1).alias("_n"), F.lit(0).alias("_anchor"))
        .unionByName(anchors.select(key, ts, F.lit(0).alias("_n"), F.lit(1).alias("_anchor")))
        .where(F.col(ts).isNotNull() & F.col(key).isNotNull())
        .groupBy(key, ts)
        .agg(F.sum("_n").alias("_n"), F.max("_anchor").alias("_anchor"))
    )
    ticks = ticks.withColumn("_bucket", F.floor(_seconds(ticks, ts) / bucket_seconds))
    so_far = "rows between unbounded preceding and current row"
    before = "rows between unbounded preceding and 1 preceding"
    totals = ticks.groupBy(key, "_bucket").agg(
        F.sum("_n").alias("_in_bucket"), F.max("_anchor").alias("_wanted")
    )
    earlier = totals.select(
        key,
        "_bucket",
        "_wanted",
        F.expr(f"coalesce(sum(_in_bucket) over (partition by `{key}` order by _bucket {before}), 0)").alias(
            "_earlier"
        ),
    ).where("_wanted = 1")
    within = ticks.withColumn(
        "_within", F.expr(f"sum(_n) over (partition by `{key}`, _bucket order by `{ts}` {so_far})")
    ).where("_anchor = 1")
    return within.join(earlier, [key, "_bucket"]).select(
        key, ts, (F.col("_within") + F.col("_earlier")).alias(name)
    )


def sessions_until(
    snapshot: DataFrame,
    sessions: DataFrame,
    *,
    user: str = "user_pseudo_id",
    session: str = "session_id",
    start: str = "session_start_timestamp_utc",
) -> DataFrame:
    """Sessions of the user started at or before each purchase, the purchase
    session included; purchases without any are left out."""
    starts = (
        of_users(sessions.where(F.col(start).isNotNull()), snapshot, user)
        .groupBy(user, session)
        .agg(F.min(start).alias("purchase_ts"))
        .where(F.col(session).isNotNull())
    )
    counts = count_until(starts, snapshot, user, "purchase_ts", "sessions_until_purchase")
    return (
        snapshot.select(user, "transaction_id", "purchase_ts")
        .join(counts, [user, "purchase_ts"])
        .where("sessions_until_purchase > 0")
        .select(user, "transaction_id", "sessions_until_purchase")
    )


def first_touch_purchases(orders: DataFrame, report: DataFrame) -> DataFrame:
    """Purchases of users with exactly one new order, with the touchpoint of
    their lowest-numbered session (unnumbered sessions are not considered).

    Writes the purchases to the staging folder: their users then narrow the
    report before it is aggregated.
    """
    kept = only_single(purchase_rows(orders, report), "user_pseudo_id")
    attributes = ["ga_session_number", "lnd_source_medium"]
    snapshot = stage(purchase_snapshot(kept, attributes).drop("purchase_ts"))
    numbered = of_users(report.where(F.col("ga_session_number").isNotNull()), snapshot, "user_pseudo_id")
    first = first_by(
        numbered,
        ["user_pseudo_id"],
        ["date", "lnd_source_medium"],
        ["ga_session_number", "date", "session_id"],
    ).withColumnsRenamed(
        {"date": "first_session_date", "lnd_source_medium": "first_session_lnd_source_medium"}
    )
    return snapshot.join(first, "user_pseudo_id")


def days_to_purchase(orders: DataFrame, report: DataFrame) -> DataFrame:
    """First touch, purchase, days between them and sessions up to the purchase,
    for users with exactly one new order.

    Users with several are dropped before anything is counted for them, and the
    remaining purchases are staged, as for ``first_touch_purchases``.
    """
    touch_columns = ["date", "lnd_source_medium", "marketing_category", "channel_category"]
    kept = only_single(purchase_rows(orders, report), "user_pseudo_id")
    snapshot = stage(
        purchase_snapshot(
            kept, ["ga_session_number", "lnd_source_medium", "marketing_category", "channel_category"]
        )
    )
    touch = first_touch(of_users(report, snapshot, "user_pseudo_id"), touch_columns)
    counts = sessions_until(snapshot, report)
    return (
        snapshot.join(touch, "user_pseudo_id")
        .join(counts, ["user_pseudo_id", "transaction_id"], "left")
        .select(
            *[c for c in snapshot.columns if c != "purchase_ts"],
            F.col("ft.date").alias("first_session_date"),
            *[F.col(f"ft.{c}").alias(f"first_session_{c}") for c in touch_columns[1:]],
            F.date_diff("purchase_date", "ft.date").alias("days_to_purchase"),
            "sessions_until_purchase",
            "first_touch_disagrees",
        )
    )


def event_before(
    anchors: DataFrame,
    events: DataFrame,
    condition: Column,
    first_day: Day,
    last_day: Day,
    *,
    per: Sequence[str],
    user: str = "user_pseudo_id",
    ts: str = "event_timestamp_utc",
    date_col: str = "event_date",
) -> DataFrame:
    """Per order: did a matching event happen strictly before one of its rows,
    and on which earliest date.

    An order is what ``per`` tells apart; its rows in ``anchors`` may repeat, as
    each has its own time. The flag is NULL where the user has no event before
    any of them, or none on which the condition can be decided. Only events of
    the anchors' users are looked at. They shrink to one row per user and day
    (first time, first matching time), then to one short list per user: never
    longer than the day range, which is why the range is required. An anchor
    then reads its user's list; no anchor-event pair is built.
    """
    daily = (
        of_users(events.where(in_days(F.col(date_col), first_day, last_day)), anchors, user)
        .groupBy(user, date_col)
        .agg(
            F.min(F.when(condition.isNotNull(), F.col(ts))).alias("seen"),
            F.min(F.when(condition, F.col(ts))).alias("hit"),
        )
    )
    per_user = daily.groupBy(user).agg(
        F.min("seen").alias("_seen"),
        F.collect_list(F.when(F.col("hit").isNotNull(), F.struct(F.col(date_col).alias("day"), "hit"))).alias(
            "_hits"
        ),
    )
    joined = anchors.join(per_user, user, "left")
    hits = F.filter(F.col("_hits"), lambda h: h["hit"] < F.col(ts))
    first_date = F.array_min(F.transform(hits, lambda h: h["day"]))
    flag = F.when(first_date.isNotNull(), True).when(F.col("_seen") < F.col(ts), False)
    flagged = joined.select(*per, flag.alias("flag"), first_date.alias("page_visited_date"))
    return flagged.groupBy(*per).agg(
        F.bool_or("flag").alias("flag"), F.min("page_visited_date").alias("page_visited_date")
    )
