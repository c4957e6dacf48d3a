"""What the final plans must not have: repeated scans of the events, and sorts of raw events."""

import contextlib
import io
import re

import pytest

from visitloom.operators import anomaly
from visitloom.plans import bots, catalog
from visitloom.plans.views import Views

SF = "/root/testdata/sf0.001"
PLANS = catalog.queries()


def final_plan(spark, name):
    df = PLANS[name](spark, SF)
    df.collect()
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    text = out.getvalue()
    return text.split("== Initial Plan ==")[0], text


def scans(spark, name, table="events"):
    """Scans of a table that ran; a reused exchange is none."""
    tree, text = final_plan(spark, name)
    numbers = set(re.findall(r"Scan parquet\s+\((\d+)\)", tree))
    found = 0
    for block in re.split(r"\n\n+", text):
        m = re.match(r"\((\d+)\) Scan parquet", block.strip())
        found += bool(m and m[1] in numbers and f"/{table}.parquet" in block)
    return found


@pytest.mark.parametrize(
    ("name", "most"),
    [
        ("intraday_sessions", 1), ("property_union_daily", 0), ("order_match_outcomes", 2), ("order_reconciliation", 3),
        ("presale_item_buyers", 2), ("session_attribution", 1), ("cancellation_reasons", 0), ("login_groups", 1),
    ],
)
def test_scans_of_the_events(spark, name, most):
    assert scans(spark, name) <= most


@pytest.mark.parametrize("name", ["session_attribution", "landing_channel_revenue", "login_groups"])
def test_no_sort_of_raw_events(spark, name):
    tree, _ = final_plan(spark, name)
    lines = [x for x in tree.splitlines() if "+- " in x or ":- " in x or x.startswith("*")]
    depth = [len(re.match(r"[\s:|+\-*()\d]*", x)[0]) for x in lines]
    for i, line in enumerate(lines):
        if "Scan parquet" not in line:
            continue
        at = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                if "Exchange" in lines[j]:
                    break
                assert "Sort" not in lines[j], (name, lines[j])


def test_bot_scoring_joins_small_contexts_without_a_shuffle(spark):
    """Contexts of this size are broadcast by their measured size, without a hint."""
    tree, _ = final_plan(spark, "session_z_scores")
    assert tree.count("SortMergeJoin") == 0
    assert len(re.findall(r"(?<!Broadcast)Exchange \(", tree)) <= 6


def above(tree, found):
    """Operators over the first line of the plan that has all the marks, from the root down."""
    lines = tree.splitlines()
    depth = [len(re.match(r"[\s:|+\-]*", x)[0]) for x in lines]
    at = next(i for i, x in enumerate(lines) if all(m in x for m in found))
    path = [lines[at]]
    for i in range(at - 1, -1, -1):
        if depth[i] < depth[at]:
            path.append(lines[i])
            at = i
    return path


def test_bot_scoring_moves_the_features_twice_at_most(spark):
    """With no broadcast at all: once for the user's context, once for those of the day and city."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        views = Views(spark, SF)
        scored = anomaly.score_sessions(bots._features(views))
        tree = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    path = above(tree, ["FileScan", "session_key", "interaction_events"])
    assert sum("Exchange" in x for x in path) == 2 and sum("SortMergeJoin" in x for x in path) >= 2
    assert tree.count("interaction_events#") and "BroadcastHashJoin" not in tree
    # the baseline of the sessions themselves reads the features too, but only adds up
    assert sum(line.count("FileScan") for line in tree.splitlines() if "session_key" in line) == 1
