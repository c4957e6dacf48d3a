"""Personal data: proposed spans are judged by boosted trees over their format and context.

The trees learn from the given formats, their rewritten forms and what check
digits and neighbours disprove; they decide on the looser proposals.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm import trees
from visitloom.llm.common import add_columns, cut_out, free_name, text_bytes
from visitloom.sources.staging import stage

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
#: Different lessons that the trees are fitted on, about: a sample by hash, as many of each kind.
MOST_LESSONS = 20_000
TREES, DEPTH, PACE, SEED = 40, 5, 0.3, 23
#: Share of right ones that a threshold must reach on all lessons kept from the fit, and steps of the score.
PRECISION, STEPS = 0.98, 1000
MARK = "<PRIVATE>"

SPAN = "struct<kind:string,start:int,end:int>"
PROPOSAL = "struct<kind:string,start:int,end:int,features:array<double>>"
LESSON = "struct<kind:string,right:boolean,features:array<double>>"

# The given formats. A run of digits is taken whole, so a part of it is never tried alone.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms, for recall: what they find counts only if the trees say so.
_LOOSE = (
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![A-Z0-9])")),
)
_HIDDEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}|[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9.-]{1,63}")
# Words before a span that speak for a kind, in the languages of the texts.
_HINTS = re.compile(
    r"(?i)(phone|tel|call|fax|mobil|anruf|appel|llam)|(mail|contact|write|kontakt|correo)|(card|visa|credit|kart|carte|tarjeta)"
    r"|(ip|host|server|address|adres)|(iban|account|konto|compte|cuenta)"
)
FEATURES = (
    "kind", "length", "digits", "letters", "spaces", "dots", "dashes", "brackets", "plus", "at", "longest_run",
    "different_digits", "check_digits", "before", "after", "digits_near", "hint",
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def iban_valid(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind number, start and end of the given kinds, by kind, then start."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    found += [(1, *m.span()) for m in _IP.finditer(text) if small_parts(m[0])]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((3, *m.span()))
    return found


class Taken:
    """Stretches of a text, merged where they overlap or touch."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        """A stretch that overlaps none."""
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of all generators, which may overlap: kind number, start, end."""
    found = set(base) | {(0, *m.span()) for m in _HIDDEN.finditer(text)}
    for kind, regex in _LOOSE:
        found |= {(KINDS.index(kind), *m.span()) for m in regex.finditer(text)}
    found |= {(1, *m.span()) for m in _IP.finditer(text)} | {(3, *m.span()) for m in _PHONE.finditer(text)}
    return sorted(found)


def _grouped(digits: str, sizes: tuple[int, ...], between: str) -> str:
    """The digits in groups of these sizes, the last size repeating."""
    out, at = [], 0
    while at < len(digits):
        size = sizes[min(len(out), len(sizes) - 1)]
        out.append(digits[at : at + size])
        at += size
    return between.join(out)


def rewritten(kind: int, own: str) -> list[tuple[bool, str]]:
    """Looser forms of a given span, which are as private, and look-alikes that are not.

    Which ones, its characters decide. Separators are dropped or changed and a
    digit is mistaken, as people write; look-alikes are grouped by thousands,
    have parts no address has, or are stuck to letters like a part of a name.
    """
    h = zlib.crc32(own.encode())
    digits = re.sub(r"[^0-9]", "", own)
    if kind == 0:
        local, domain = own.split("@", 1)
        return [(True, local + (" [at] ", " (at) ", "[at]")[h % 3] + domain), (False, f"{local}@{domain.split('.')[0]}")]
    if kind == 1:
        parts = own.split(".")
        above = [str(int(p) + 256 * (i == h % 4)) for i, p in enumerate(parts)]
        return [
            (True, (",", ", ", " . ")[h % 3].join(parts)), (True, own),
            (False, ".".join(above)), (False, f"v{own}"), (False, f"{own}.{h % 9}"),
        ]
    if kind == 2:
        i = h % len(digits)
        mistaken = digits[:i] + str((int(digits[i]) + 1 + h // 64 % 9) % 10) + digits[i + 1 :]
        return [
            (True, _grouped(mistaken, (4,), ("", " ", "-")[h % 3])), (True, _grouped(mistaken, (len(digits),), "")),
            (True, _grouped(digits, (4,), ("-", "", " ")[h % 3])),
            (False, _grouped(digits, (len(digits) % 3 or 3, 3), " ")), (False, f"a{mistaken}"), (False, f"{mistaken}f"),
        ]
    if len(digits) < 10:
        return []
    near = digits[-10:]
    loose = (f"({near[:3]}) {near[3:6]}-{near[6:]}", _grouped(near, (3, 3, 4), "."), _grouped(near, (3, 3, 4), " "))
    amount = _grouped(digits[: 8 + h % 2], (2 + h % 2, 3), (" ", ".")[h // 8 % 2])
    return [(True, loose[h % 3]), (True, loose[h // 8 % 3]), (False, amount), (False, f"x{loose[1 + h % 2]}")]


def lessons(
    text: str, base: list[tuple[int, int, int]], proposed: list[tuple[int, int, int]], near: list[list[float]]
) -> list[tuple[int, bool, list[float]]]:
    """What is known for sure: kind, whether right, features.

    Given spans, and their rewritten forms in the same surroundings; proposals
    that check digits prove or disprove, that have parts no address has, or
    that are stuck to letters or digits. All others are open and teach nothing.
    """
    out = []
    for kind, start, end in base:
        own, before, after = text[start:end], text[max(0, start - 25) : start], text[end : end + 25]
        out.append((kind, True, features(text, kind, start, end)))
        for right, form in rewritten(kind, own):
            lead = len(before) + (form[0] in "avx" and not own.startswith(form[0]) and kind != 0)
            tail = len(form) - (kind == 2 and form.endswith("f"))
            stop = len(before) + tail
            out.append((kind, right, features(before + form + after, kind, lead, stop)))
    sure = [Taken([(s, e) for k, s, e in base if k == kind]) for kind in range(len(KINDS))]
    for (kind, start, end), row in zip(proposed, near):
        if sure[kind].touches(start, end):
            continue
        if kind == 4:
            out.append((kind, iban_valid(text[start:end]), row))
        elif text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
            out.append((kind, False, row))
        elif kind == 1 and not small_parts(re.sub(r"[ ,.]+", ".", text[start:end])):
            out.append((kind, False, row))
    return out


def _side(char: str) -> float:
    """Kind of a neighbouring character: none, blank, letter, digit, other."""
    return 0.0 if not char else 1.0 if char.isspace() else 2.0 if char.isalpha() else 3.0 if char.isdigit() else 4.0


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    own = text[start:end]
    digits = re.sub(r"[^0-9]", "", own)
    near = text[max(0, start - 24) : start]
    hint = None
    for hint in _HINTS.finditer(near):
        pass
    return [
        float(kind), float(len(own)), float(len(digits)), float(sum(map(str.isalpha, own))), float(own.count(" ")),
        float(own.count(".")), float(own.count("-")), float(own.count("(") + own.count(")")), float(own.count("+")),
        float(own.count("@")), float(max(map(len, re.findall(r"[0-9]+", own)), default=0)), float(len(set(digits))),
        float(kind == 4 and iban_valid(own)), _side(text[start - 1 : start]), _side(text[end : end + 1]),
        float(sum(map(str.isdigit, near + text[end : end + 24]))), float(hint.lastindex if hint else 0),
    ]


def propose(docs: DataFrame, text: str, base: str, name: str, taught: str) -> DataFrame:
    """``docs`` with the given spans, the open proposals of a text column and its lessons. Texts without a digit
    and ``@`` have none."""
    wanted = np.zeros(256, dtype=bool)
    wanted[48:58] = wanted[64] = True
    hidden = re.compile(r"[\[(]at[\])]")

    def make(values: pa.Array) -> list[list]:
        data, begins = text_bytes(values)
        total = np.concatenate(([0], np.cumsum(wanted[data])))
        possible = total[begins[1:]] > total[begins[:-1]]
        texts = values.to_pylist()
        given, proposed, known = [], [], []
        for text, some in zip(texts, possible.tolist()):
            sure = base_spans(text) if some else []
            more = proposals(text, sure) if some or (text and hidden.search(text)) else []
            near = [features(text, *p) for p in more]
            taken = Taken([(s, e) for _, s, e in sure])
            given.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sure])
            proposed.append(
                [
                    {"kind": KINDS[k], "start": s, "end": e, "features": f}
                    for (k, s, e), f in zip(more, near)
                    if not taken.touches(s, e)
                ]
            )
            known.append([{"kind": KINDS[k], "right": r, "features": f} for k, r, f in lessons(text, sure, more, near)])
        return [given, proposed, known]

    types = {base: f"array<{SPAN}>", name: f"array<{PROPOSAL}>", taught: f"array<{LESSON}>"}
    return add_columns(docs, text, types, make)


class Judge:
    """Boosted trees as leaves, and per kind the score from which a proposal is taken."""

    def __init__(self, leaves: list[tuple[tuple[trees.Bound, ...], float]], thresholds: dict[str, float]):
        self.leaves, self.thresholds = leaves, thresholds

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for bounds, value in self.leaves:
            inside = np.ones(len(rows), dtype=bool)
            for feature, above, bound in bounds:
                inside &= rows[:, feature] > bound if above else rows[:, feature] <= bound
            margin[inside] += value
        return 1 / (1 + np.exp(-2 * margin))

    def select(self, base: list[dict], proposed: list[dict]) -> list[dict]:
        """The given spans and, best score first, proposals above their threshold that touch none taken."""
        taken = Taken([(s["start"], s["end"]) for s in base])
        rivals = [p for p in proposed if p["kind"] in self.thresholds and not taken.touches(p["start"], p["end"])]
        chosen = [(s["start"], s["end"], s["kind"]) for s in base]
        if rivals:
            scores = self.scores(np.array([p["features"] for p in rivals]))
            for score, p in sorted(zip(scores.tolist(), rivals), key=lambda x: (-x[0], x[1]["start"], x[1]["end"])):
                if score >= self.thresholds[p["kind"]] and not taken.touches(p["start"], p["end"]):
                    taken.add(p["start"], p["end"])
                    chosen.append((p["start"], p["end"], p["kind"]))
        ordered = sorted(chosen, key=lambda t: (KINDS.index(t[2]), t[0], t[1]))
        return [{"kind": k, "start": a, "end": b} for a, b, k in ordered]


def fit(rows: DataFrame, taught: str, most: int = MOST_LESSONS) -> Judge:
    """Trees that tell right lessons from wrong ones, fitted on about ``most`` different ones.

    No text is labelled for personal data; see ``lessons`` for what is known.
    Equal lessons are one row with their number as weight, so the sample is
    bounded however often a text is copied. Those of a quarter of the texts, by
    hash, are kept from the fit: on all of these the threshold of each kind is set to the lowest score from which
    ``PRECISION`` are right. A kind that does not get there, or with fewer than
    20 right ones, adds nothing.
    """
    apart = F.pmod(F.xxhash64(F.lit(SEED), taught), F.lit(4)) == 0
    each = rows.select(F.explode(taught).alias("p"), apart.alias("apart")).groupBy("p.kind", "p.right", "p.features", "apart")
    each = each.agg(F.count(F.lit(1)).cast("double").alias("w"))
    each = stage(each.withColumn("place", F.pmod(F.xxhash64("kind", "features", F.lit(SEED)), F.lit(1_000_000))))
    kinds = {r["kind"]: r["n"] for r in each.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F
    for kind, n in sorted(kinds.items()):
        share = share.when(F.col("kind") == kind, min(1.0, most / len(kinds) / n))
    if not kinds:
        return Judge([], {})
    # One sorted part, bounded as different rows are sampled: sums run in one order, equal inputs give equal models.
    part = each.where(~F.col("apart") & (F.col("place") < share * 1_000_000)).repartition(1)
    part = stage(part.sortWithinPartitions("place", "kind", "right", "features"))
    counts = {r["right"]: r["n"] for r in part.groupBy("right").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(True, 0), counts.get(False, 0)) < 20:
        return Judge([], {})
    vectors = part.select(F.col("right").cast("double").alias("y"), array_to_vector("features").alias("x"), "w")
    boosted = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, stepSize=PACE, seed=SEED,
    ).fit(vectors)
    judge = Judge([(b, v) for b, v in trees.paths(boosted.toDebugString) if v is not None], {})
    scores = judge.scores

    def make(values: pa.Array) -> list[list]:
        return [np.floor(scores(np.array(values.to_pylist())) * STEPS).astype(int).tolist() if len(values) else []]

    scored = add_columns(each.where("apart"), "features", {"step": "int"}, make)
    bins = scored.groupBy("kind", "step").agg(
        F.sum(F.when(F.col("right"), F.col("w")).otherwise(0.0)).alias("right"), F.sum("w").alias("all")
    )
    # At most one row per kind and step of the score.
    for kind, group in bins.toPandas().sort_values("step", ascending=False).groupby("kind"):
        fine = group["right"].cumsum() / group["all"].cumsum() >= PRECISION
        if group["right"].sum() >= 20 and fine.any():
            judge.thresholds[kind] = float(group["step"][fine].min()) / STEPS
    return judge


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``base`` and ``spans``: arrays of kind, start, end.

    ``base`` has the given formats, ``spans`` also what the trees add; the
    latter overlap nothing. Offsets count code points, the end is exclusive;
    both stand by kind, then start. Null and empty texts have none. Every row
    stays, repeated ones too; columns named like the new ones are replaced.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("base", "spans")]
    proposed, taught, both = (free_name(docs, c) for c in ("proposed", "taught", "both"))
    rows = propose(docs.drop("base"), text, "base", proposed, taught)
    rows = stage(rows.select(*(F.col(f"`{c}`") for c in kept), "base", proposed, taught))
    judge = fit(rows, taught)
    rows = rows.withColumn(both, F.struct(F.col("base").alias("base"), F.col(proposed).alias("proposed")))
    select = judge.select

    def make(values: pa.Array) -> list[list]:
        given, more = values.field("base").to_pylist(), values.field("proposed").to_pylist()
        return [[select(b, p) if p else b for b, p in zip(given, more)]]

    out = add_columns(rows.drop(proposed, taught), both, {"spans": f"array<{SPAN}>"}, make)
    return out.select(*(F.col(f"`{c}`") for c in kept), "base", "spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``<PRIVATE>`` for each span found; all rows and columns stay."""
    renamed = {c: free_name(docs, f"own_{c}") for c in docs.columns if c in ("base", "spans")}
    own = renamed.get(text, text)
    found = find(docs.withColumnsRenamed(renamed), own)
    both = free_name(found, "both")
    found = found.withColumn(both, F.struct(F.col(f"`{own}`").alias("text"), F.col("spans").alias("spans")))

    def make(values: pa.Array) -> list[list]:
        texts, spans = values.field("text").to_pylist(), values.field("spans").to_pylist()
        cuts = [sorted((s["start"], s["end"]) for s in own) for own in spans]
        return [[cut_out(t, c, MARK) if c else t for t, c in zip(texts, cuts)]]

    out = add_columns(found, both, {own: "string"}, make)
    return out.select(*(F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns))
