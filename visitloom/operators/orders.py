"""Orders, items and their reconciliation with web transactions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions import text
from visitloom.operators.joins import null_safe_join, split_left_join
from visitloom.sources.staging import stage

#: Rows of one id, on one side of a reconciliation, that a single task should not join.
HEAVY = 1_000_000


def flag_group_has(df: DataFrame, key: str, condition: Column, row_flag: str, group_flag: str) -> DataFrame:
    """0/1 flag of each row, and whether any row of its group has it.

    The group flag comes from a join with the distinct keys that have it, not
    from a window: a window would gather a group in one task, and here only
    matching rows are moved to find the keys.
    """
    flagged = df.where(condition).select(key, F.lit(1).alias(group_flag)).distinct()
    return null_safe_join(df, flagged, [key], "left").withColumns(
        {
            row_flag: F.when(condition, 1).otherwise(0),
            group_flag: F.coalesce(group_flag, F.lit(0)),
        }
    )


def match_ids(df: DataFrame, column: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows whose id is in a list (literal values) or in the only column of a
    table of ids. A table is semi-joined, so repeated ids do not repeat rows."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(*ids))


def buyers_of_or_non_buyers(
    visits: DataFrame, transactions: DataFrame, items: DataFrame, item_id, session: str = "session_id"
) -> DataFrame:
    """Visits without a transaction, and visits with a transaction that holds
    the item; other buyers are dropped. A line of the item repeats its visit.

    The lines of the item shrink to their number per transaction, which is
    noted on the transactions; these meet the visits once."""
    lines = items.where(F.col("item_id") == item_id).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_lines"))
    noted = transactions.join(lines, "transaction_id", "left")
    joined = visits.join(noted, session, "left").where(F.col("transaction_id").isNull() | F.col("_lines").isNotNull())
    times = F.array_repeat(F.lit(0), F.coalesce(F.col("_lines"), F.lit(1)).cast("int"))
    return joined.withColumn("_line", F.explode(times)).drop("_lines", "_line")


def reconcile(
    web: DataFrame,
    back_office: DataFrame,
    web_id: str,
    office_id: str,
    web_condition: Column | None = None,
    *,
    heavy: int = HEAVY,
) -> DataFrame:
    """Full outer join of web transactions with back-office orders.

    A web row that fails ``web_condition`` stays, unmatched. Ids should be nearly
    unique on both sides; NULL matches nothing. Rows without an id, and web rows
    that fail, go round the join. A full join cannot be split at a hot key, so
    ids with more than ``heavy`` rows on a side are found first, by a count of
    the ids alone (eager). Those known to one side only go round the join too;
    the others are an inner join, which AQE splits on either side.
    """
    matches = F.lit(True) if web_condition is None else F.coalesce(web_condition, F.lit(False))
    joinable = matches & F.col(web_id).isNotNull()
    known = F.col(office_id).isNotNull()
    left, right = web.where(joinable), back_office.where(known)
    ids = left.select(F.col(web_id).alias("_id"), F.lit(1).alias("_w"), F.lit(0).alias("_o")).unionByName(
        right.select(F.col(office_id).alias("_id"), F.lit(0).alias("_w"), F.lit(1).alias("_o"))
    )
    counted = ids.groupBy("_id").agg(F.sum("_w").alias("_w"), F.sum("_o").alias("_o"))
    hot = stage(counted.where(F.greatest("_w", "_o") > heavy))
    parts = []
    if not hot.isEmpty():
        hot_left = left.join(hot.select("_id", "_o"), left[web_id] == hot["_id"]).drop("_id")
        hot_right = right.join(hot.select("_id", "_w"), right[office_id] == hot["_id"]).drop("_id")
        both = hot_left.where("_o > 0").drop("_o").join(
            hot_right.where("_w > 0").drop("_w"), F.col(web_id) == F.col(office_id)
        )
        parts = [both, hot_left.where("_o = 0").drop("_o"), hot_right.where("_w = 0").drop("_w")]
        left = left.join(hot.select("_id"), left[web_id] == hot["_id"], "left_anti")
        right = right.join(hot.select("_id"), right[office_id] == hot["_id"], "left_anti")
    joined = left.join(right, F.col(web_id) == F.col(office_id), "full")
    parts += [web.where(~joinable), back_office.where(~known)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, joined)


def url_params(df: DataFrame, url: str, names: Sequence[str]) -> DataFrame:
    """One column per URL parameter, NULL where it is missing or empty."""
    return df.withColumns({n: text.url_param(F.col(url), n) for n in names})


def first_url_with(
    events: DataFrame, params: Sequence[str], order: Sequence[str], name: str = "first_url"
) -> DataFrame:
    """First page of each session, by the order, whose URL holds all parameters."""
    condition = F.lit(True)
    for p in params:
        condition = condition & F.col("page_location").contains(f"{p}=")
    return (
        events.where(condition)
        .groupBy("session_id")
        .agg(F.min_by("page_location", F.struct(*order)).alias(name))
    )


def dedupe_transactions(
    transactions: DataFrame, keys: Sequence[str] = ("brand", "transaction_id"), order: Sequence[str] = ()
) -> DataFrame:
    """One row per transaction: the lowest by ``order``, ties by all columns, so
    a rerun keeps the same row (``dropDuplicates`` would keep any)."""
    values = [c for c in transactions.columns if c not in keys]
    rank = F.struct(*order, *[c for c in values if c not in order])
    picked = transactions.groupBy(*keys).agg(F.min_by(F.struct(*values), rank).alias("_row"))
    return picked.select(*keys, "_row.*").select(*transactions.columns)


def cancel_reasons(
    events: DataFrame, confirm: str, feedback: str, no_reason: str = "ABANDONED", *, one_row: bool = False
) -> DataFrame:
    """Confirmed cancellations with the upper-cased reason given on the same
    page fragment; several feedback rows repeat the cancellation.

    ``one_row`` keeps one row per cancellation, with the lowest reason: reasons
    then shrink to one per fragment, and nothing is multiplied.
    """
    reasons = events.where(F.col("event_category") == feedback).select(
        "brand", "page_fragment", F.upper("event_label").alias("_reason")
    )
    if one_row:
        reasons = reasons.groupBy("brand", "page_fragment").agg(F.min("_reason").alias("_reason"))
    confirmed = events.where(F.col("event_category") == confirm).select(
        "brand", "event_date", "page_fragment", "event_order"
    )
    return split_left_join(confirmed, reasons, ["brand", "page_fragment"]).select(
        "brand",
        F.col("event_order").alias("club"),
        F.col("event_date").alias("date"),
        text.split_part_at(F.col("page_fragment"), "/", 2).alias("subscription_id"),
        F.coalesce("_reason", F.lit(no_reason)).alias("cancel_reason"),
    )


def order_lines(report: DataFrame, items: DataFrame, details: DataFrame) -> DataFrame:
    """Report rows with their item lines and back-office attributes, where any.
    Lines repeat per transaction, the details are one row per order."""
    return split_left_join(report, items, ["transaction_id"]).join(details, "transaction_id", "left")
