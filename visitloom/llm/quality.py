"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm import trees
from visitloom.llm.common import add_columns, free_name
from visitloom.llm.words import Words, visible
from visitloom.sources.staging import stage

#: Labelled rows that the model is fitted on, about: a sample by hash of the key.
MOST_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 17
#: Weight of the lasso penalty.
PENALTY = 0.002
#: Scores below it reject a text.
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "symbols", "punctuation",
    "beyond_ascii", "lines", "capital_words", "symbol_words", "end_marks", "distinct_words", "distinct_lines",
)


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


def statistics(values: pa.Array) -> list[np.ndarray]:
    """The statistics of each text, in the order of their names; 0 wherever there is nothing to count."""
    words = Words(values, visible())
    data, start, stop, first = words.data, words.start, words.stop, words.first
    begins = words.begins
    n = np.diff(begins).astype(float)
    n_words = np.diff(first).astype(float)

    def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.divide(count, of, out=np.zeros(len(of)), where=of > 0)

    def totals(mask: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(mask)))

    def per_text(total: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    upper = totals(_bytes_in(bytes(range(65, 91)))[data])
    lower = totals(_bytes_in(bytes(range(97, 123)))[data])
    symbol = totals(_bytes_in(b"#$%&*|@^~<>={}[]\\/_+")[data])
    size = stop - start
    word_upper, word_lower = upper[stop] - upper[start], lower[stop] - lower[start]
    marks = _bytes_in(b"!?")[data[np.maximum(stop - 1, 0)]] if len(stop) else np.zeros(0, dtype=bool)
    lines = Words(values, ~_bytes_in(b"\n"))
    n_lines = np.diff(lines.first).astype(float)
    return [
        np.log1p(n),
        np.log1p(n_words),
        share(per_text(totals(size), first), n_words),
        share(per_text(totals(size > 20), first), n_words),
        share(per_text(upper, begins), n),
        share(per_text(totals(_bytes_in(b"0123456789")[data]), begins), n),
        share(per_text(symbol, begins), n),
        share(per_text(totals(_bytes_in(b".,;:!?'\"()-")[data]), begins), n),
        share(per_text(totals(data >= 128), begins), n),
        share(n_lines, n_words),
        share(per_text(totals((word_upper >= 2) & (word_lower == 0)), first), n_words),
        share(per_text(totals(symbol[stop] > symbol[start]), first), n_words),
        share(per_text(totals(marks), first), n_words),
        share(_distinct(words), n_words),
        share(_distinct(lines), n_lines),
    ]


def _distinct(words: Words) -> np.ndarray:
    """Different words of each text."""
    count = len(words.first) - 1
    text = np.repeat(np.arange(count), np.diff(words.first))
    order = np.lexsort((words.hash, text))
    new = np.ones(len(order), dtype=bool)
    t, h = text[order], words.hash[order]
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.bincount(t[new], minlength=count).astype(float)


def add_statistics(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the statistics of a text column, under ``names``. Null and empty texts have those of no text;
    all rows stay, repeated ones too, and columns of these names are replaced."""
    names = names or {s: s for s in STATISTICS}
    return add_columns(docs, text, {names[s]: "double" for s in STATISTICS}, lambda v: list(statistics(v)))


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules. A rule is a set of bounds: statistic, whether it must be above, bound."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, names: dict[str, str]) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.bias)
        for weight, bounds in self.rules:
            total = total + F.when(holds(bounds, names), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(bounds: tuple[tuple[str, bool, float], ...], names: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, above, bound in bounds:
        column = F.col(names[name])
        out = out & ((column > bound) if above else (column <= bound))
    return out


def tree_rules(described: str) -> list[tuple[tuple[str, bool, float], ...]]:
    """Paths to all nodes of the trees in a model's description, each once."""
    found = dict.fromkeys(bounds for bounds, leaf in trees.paths(described) if leaf is None)
    return [tuple((STATISTICS[f], above, bound) for f, above, bound in bounds) for bounds in found]


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    most: int = MOST_ROWS,
) -> Ensemble:
    """Ensemble for label 1 against label 0, from about ``most`` labelled rows at most.

    Labels other than 0 and 1 and null keys are left out. With fewer than two
    labels the score is constant: their share, a half without any.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).cast("double").alias("y")
    )
    total = known.count()
    share = min(1.0, most / max(1, total))
    part = known.where(F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    # Of bounded size by the sampling above.
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(part), "k")
    # One sorted part, of bounded size: sums then run in one order, and equal inputs give equal models.
    sample = add_statistics(texts, "t").select("k", "y", *STATISTICS)
    rows = stage(sample.repartition(1).sortWithinPartitions("k", "y", *STATISTICS)).drop("k")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        rate = (counts.get(1.0, 0) + 1) / (n + 2)
        return Ensemble(math.log(rate / (1 - rate)), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).select("y", "x", *STATISTICS)
    boosted = GBTClassifier(
        featuresCol="x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, maxBins=64,
        minInstancesPerNode=max(1, min(10, n // 50)),
    ).fit(vectors)
    rules = tree_rules(boosted.toDebugString)
    if not rules:
        rate = (counts[1.0] + 1) / (n + 2)
        return Ensemble(math.log(rate / (1 - rate)), ())
    names = {s: s for s in STATISTICS}
    fired = rows.select("y", *(holds(r, names).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(fired)
    lasso = LogisticRegression(
        featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, tol=1e-5
    ).fit(fired.select("y", "x"))
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), tuple((w, r) for w, r in zip(weights, rules) if w))


def score(docs: DataFrame, model: Ensemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score reaches the threshold, else 0).

    All rows and columns stay; columns named like the two new ones are
    replaced. Null and empty texts have a score too, that of zero statistics.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    names = {s: free_name(docs, f"stat_{s}") for s in STATISTICS}
    scored = add_statistics(docs.select(*(F.col(f"`{c}`") for c in kept)), text, names)
    scored = scored.select(*(F.col(f"`{c}`") for c in kept), model.score(names).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from the fit: a fifth, by the checksum of the key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, that the classifier does not reject.

    Null and empty texts have the statistics of an empty text and are scored
    like any other; rows with equal texts share their fate. Without usable
    labels nothing is rejected. Columns named like statistics are kept.
    """
    model = fit(docs, labels.where(~held_out(key)), key, text)
    mark, names = free_name(docs, "score_"), {s: free_name(docs, f"stat_{s}") for s in STATISTICS}
    scored = add_statistics(docs, text, names).withColumn(mark, model.score(names))
    return scored.where(F.col(mark) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
