"""Mixing sources to target weights: copy numbers by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import free_name
from visitloom.sources.staging import stage

#: Fractional rows that one step of the tree folds into one.
FAN = 1024
#: Rows of over a part of so many of their source's words are settled against all others of it: fewer than this.
LARGE = 256


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` and ``n`` with the ``target`` of each source.

    Sources in code point order, null last, weigh ``weights``, repeating. They
    share ``share`` times all sizes by weight; a target stops at ``most`` times
    its source, and what is left over is shared again by weight until none is
    above. That ends where all others get one amount per unit of weight, hence:
    by rising size per weight a source stops while the amount that it and those
    after it would get is too much for it. One row per source is looked at.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    number = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), number + 1)
    cap = F.col("source_size") * most
    ranked = sizes.select("*", weight.alias("weight"), cap.alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * share
    ranked = ranked.select(
        "*",
        (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(after).alias("waiting"),
    )
    stops = F.col("cap") * F.col("waiting") <= F.col("left") * F.col("weight")
    ranked = ranked.withColumn("stops", stops)
    everyone = Window.partitionBy()
    first = F.min_by(F.struct("left", "waiting"), F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "source")))
    ranked = ranked.withColumn("rate", first.over(everyone))
    shared = F.col("rate.left") * F.col("weight") / F.col("rate.waiting")
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", shared))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def draw(seed: int, *of: Column) -> Column:
    """A number from 0 up to 1 that the values decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / float(1 << 53)


ROW = "struct<id:bigint,tie:bigint,size:bigint,p:double>"
DONE = "array<struct<id:bigint,extra:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def settled(row: Column, taken: Column) -> Column:
    return F.array(F.struct(row["id"].alias("id"), taken.cast("int").alias("extra")))


def pivot(old: Column, new: Column, seed: int) -> Column:
    """One pivotal step of two fractional rows: the ``open`` one, and the settled one in ``done``.

    One gets words of the other, so that together they keep their expected
    words and each its chance, until one is settled at 0 or 1.
    """
    a, p, b, q = old["size"], old["p"], new["size"], new["p"]
    up = F.least((1 - p) * a, q * b)
    down = F.least(p * a, (1 - q) * b)

    def moved(rises: Column) -> Column:
        ends_old = F.when(rises, (1 - p) * a <= q * b).otherwise(p * a <= (1 - q) * b)
        moved_old = F.when(rises, p + q * b / a).otherwise(p - (1 - q) * b / a)
        moved_new = F.when(rises, q - (1 - p) * a / b).otherwise(q + p * a / b)

        def result(stays: Column, chance: Column, done: Column) -> Column:
            chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance))
            row = F.struct(stays["id"].alias("id"), stays["tie"].alias("tie"), stays["size"].alias("size"), chance.alias("p"))
            return F.struct(row.alias("open"), done.alias("done"))

        return F.when(ends_old, result(new, moved_new, settled(old, rises))).otherwise(
            result(old, moved_old, settled(new, ~rises))
        )

    return let(draw(seed, old["tie"], new["tie"]) * (up + down) < down, moved)


def _fold(seed: int) -> tuple:
    """Folds fractional rows into one by pivotal steps, and lists the settled ones."""

    def merge(state: Column, new: Column) -> Column:
        first = F.struct(new.alias("open"), state["done"].alias("done"))
        step = let(
            pivot(state["open"], new, seed),
            lambda x: F.struct(x["open"].alias("open"), F.concat(state["done"], x["done"]).alias("done")),
        )
        return F.when(state["open"].isNull(), first).otherwise(step)

    start = F.struct(F.lit(None).cast(ROW).alias("open"), F.array().cast(DONE).alias("done"))
    return start, merge


def _settle_large(rows: DataFrame, seed: int) -> DataFrame:
    """Per source the settled large rows (``done``), one that may be ``open``, and the chance ``left`` of the others.

    A row with much of its source's words could stay open to the end and leave
    its words as the error. So large rows come first, largest first. Those of
    one size class, between two powers of 2, are paired with each other; the
    open one of a class is then paired with all smaller rows together: it is
    settled by its own chance, and the words that this moves change the others'
    chance alike. All keep their expected chance, and the source its expected
    words. Where the others' chance would leave 0 to 1 the row stays open.
    """
    parts = ("left", "rest", "open", "done")
    made = lambda **columns: F.struct(*(columns[c].alias(c) for c in parts))

    def against_all(state: Column, due: Column) -> Column:
        p, rest, row = state["left"], state["rest"], state["open"]
        lower, higher = p - (1 - row["p"]) * row["size"] / rest, p + row["p"] * row["size"] / rest
        fits = due & row.isNotNull() & (rest > 0) & (lower >= 0) & (higher <= 1)

        def moved(taken: Column) -> Column:
            return made(
                left=F.when(taken, lower).otherwise(higher), rest=rest, open=F.lit(None).cast(ROW),
                done=F.concat(state["done"], settled(row, taken)),
            )

        return F.when(fits, let(draw(seed, row["tie"], F.lit(1)) < row["p"], moved)).otherwise(state)

    def step(state: Column, row: Column) -> Column:
        smaller = F.floor(F.log2(state["open"]["size"])) > F.floor(F.log2(row["size"]))

        def entered(now: Column) -> Column:
            new = F.struct(row["id"].alias("id"), row["tie"].alias("tie"), row["size"].alias("size"), now["left"].alias("p"))
            rest = now["rest"] - row["size"]
            paired = let(
                pivot(now["open"], new, seed),
                lambda x: made(left=now["left"], rest=rest, open=x["open"], done=F.concat(now["done"], x["done"])),
            )
            alone = made(left=now["left"], rest=rest, open=new, done=now["done"])
            return F.when(now["open"].isNull(), alone).otherwise(paired)

        return let(against_all(state, smaller), entered)

    listed = F.collect_list(F.struct((-F.col("size")).alias("down"), F.col("tie"), F.col("place").alias("id"), F.col("size")))
    grouped = rows.where(F.col("size") * LARGE > F.col("source_size")).groupBy("source", "source_size", "p").agg(
        F.array_sort(listed).alias("all")
    )
    start = made(
        left=F.col("p"), rest=F.col("source_size").cast("double"), open=F.lit(None).cast(ROW), done=F.array().cast(DONE)
    )
    folded = F.aggregate("all", start, step, lambda state: against_all(state, F.lit(True)))
    return grouped.select(F.col("source").alias("of"), folded.alias("state")).select("of", "state.left", "state.open", "state.done")


def _occurrence(rows: DataFrame, place: str, tie: str) -> DataFrame:
    """``rows`` with ``tie`` different for rows alike, whatever their places.

    Rows whose tie is unique keep it. The others are numbered in two steps,
    within an input partition and over the partitions, so rows that repeat
    without end are spread like any others.
    """
    same = rows.groupBy(tie).agg(F.count(F.lit(1)).alias("same")).where("same > 1").select(tie)
    single = rows.join(same, tie, "left_anti")
    several = rows.join(same, tie, "left_semi").withColumn("part", F.shiftright(place, 33))
    inner = F.row_number().over(Window.partitionBy(tie, "part").orderBy(place))
    counts = several.groupBy(tie, "part").agg(F.count(F.lit(1)).alias("m"))
    offsets = counts.select(tie, "part", (F.sum("m").over(Window.partitionBy(tie).orderBy("part")) - F.col("m")).alias("m"))
    numbered = several.select("*", inner.alias("inner")).join(offsets, [tie, "part"])
    numbered = numbered.withColumn(tie, F.xxhash64(F.col("inner") + F.col("m"), tie))
    return single.unionByName(numbered.select(*single.columns))


def mix(
    docs: DataFrame,
    source: str = "source",
    size: str = "size",
    key: str = "doc_id",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (see ``targets``) and ``copies``.

    A source's rows are expected ``target / source_size`` times each; the whole
    part is sure, the fraction is a chance. Pivotal steps settle the chances:
    each pair of rows of a source moves expected words from one to the other
    until one is settled at 0 or 1. Large rows come first, what is open of them
    against all others of the source (``_settle_large``). The others are dealt by hash into blocks of about
    ``FAN`` of one source, a block is folded into one open row, largest first, and
    the open rows go up a tree whose levels shrink ``FAN``-fold, however many
    rows a source has. The last open row of a source is rounded, so the words of
    a source miss its target by at most half of one row's size (``targets`` are
    met exactly before that), which has 1 / ``LARGE`` of the source's words or
    less wherever the smaller rows can make up for the larger. No row is taken more than ``most`` times.

    Draws depend on ``key``, source, size and ``seed``, not on files or tasks, so
    reruns agree; among rows equal in these three any may get the extra copy.
    Null sizes count as 0; a row without words has no weight in the balance and
    is taken by its own draw. A null source is a source. All rows stay, with
    their other columns; no rows give no rows. Columns named like the three new
    ones are replaced.
    """
    new = ["source_size", "target", "copies"]
    kept = [c for c in docs.columns if c.lower() not in new]
    place = free_name(docs, "place")
    rows = stage(docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(place, F.monotonically_increasing_id()))
    thin = rows.select(
        F.col(place).alias("place"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{size}`")).alias("tie"),
    )
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = stage(targets(sizes, weights, share, float(most)))
    sources = aims.select(
        F.col("source").alias("of"), "source_size", "target",
        F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("ratio"),
        F.ceil(F.col("n") / FAN).alias("blocks"),
    )
    aimed = _occurrence(thin, "place", "tie").join(sources, F.col("source").eqNullSafe(F.col("of")))
    whole = F.floor("ratio").cast("int")
    aimed = stage(
        aimed.select(
            "place", "source", "source_size", "size", "tie", "blocks", whole.alias("whole"),
            (F.col("ratio") - whole).alias("p"),
        )
    )

    large = stage(_settle_large(aimed.where("size > 0 and p > 0"), seed))
    first = large.select(F.inline("done"))
    open_ = aimed.join(first, F.col("place") == F.col("id"), "left_anti")
    open_ = open_.join(large.select("of", "left", "open"), F.col("source").eqNullSafe(F.col("of")), "left")
    chance = F.when(F.col("open.id") == F.col("place"), F.col("open.p")).otherwise(F.coalesce("left", "p"))
    open_ = stage(open_.withColumn("p", F.when(F.col("size") > 0, chance).otherwise(F.col("p"))).drop("of", "left", "open"))
    fraction = "size > 0 and p > 0 and p < 1"
    light = open_.where(f"not ({fraction})")
    drawn = (draw(seed, F.col("tie")) < F.col("p")).cast("int").alias("extra")
    done = [first, light.select(F.col("place").alias("id"), drawn)]
    tree = open_.where(fraction).select(
        "source", "blocks", F.pmod(F.xxhash64(F.col("tie")), F.col("blocks")).alias("block"),
        F.struct(F.col("place").alias("id"), "tie", "size", "p").alias("row"),
    )
    start, merge = _fold(seed)
    largest = int(aims.agg(F.max("n")).first()[0] or 0)
    blocks = max(1, -(-largest // FAN))
    while True:
        listed = F.collect_list(F.struct((-F.col("row.size")).alias("down"), F.col("row.tie").alias("by"), "row"))
        by_size = F.transform(F.array_sort("all"), lambda x: x["row"])
        folded = tree.groupBy("source", "blocks", "block").agg(listed.alias("all")).select(
            "source", "blocks", "block", F.aggregate(by_size, start, merge).alias("state")
        )
        folded = stage(folded)
        done.append(folded.select(F.inline("state.done")))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN)
        tree = folded.select(
            "source", F.ceil(F.col("blocks") / FAN).alias("blocks"), F.floor(F.col("block") / FAN).alias("block"),
            F.col("state.open").alias("row"),
        )
    last = folded.select(F.col("state.open.id").alias("id"), (F.col("state.open.p") >= 0.5).cast("int").alias("extra"))
    extras = reduce(DataFrame.unionByName, [*done, last])
    copies = aimed.join(extras, F.col("place") == F.col("id")).select(
        F.col("place").alias("id"), (F.col("whole") + F.col("extra")).alias("copies")
    )
    joined = rows.join(copies, F.col(place) == F.col("id"))
    joined = joined.join(
        sources.select("of", "source_size", "target"), F.col(f"`{source}`").eqNullSafe(F.col("of"))
    )
    return joined.select(*(F.col(f"`{c}`") for c in kept), *new)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, without that column; 0 copies leave the row out."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    number = free_name(mixed, "number")
    return mixed.select("*", times.alias(number)).drop(number, "copies")
