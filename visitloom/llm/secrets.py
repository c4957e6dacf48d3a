"""Secret scans: a trigram index picks the texts on which a rule's regex runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as kinds
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import add_columns, cut_out, free_name, text_bytes

#: Stands in a redacted text for each secret.
MARK = "<SECRET>"
SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    regex: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        flags = re.ASCII | (re.IGNORECASE if self.ignore_case else 0)
        object.__setattr__(self, "regex", re.compile(self.pattern, flags))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The three kinds every scan has, in their order.
# A run of hex digits is matched whole by either form, so the shorter runs need not be listed.
BASE_RULES = (
    Rule(
        "assign",
        r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=1,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published forms of keys that issuers mark by a prefix.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._%-]+:[^\x00-\x20/@:]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: A set of exact strings larger than this is turned into its trigrams.
MOST_EXACT = 64


def trigram_query(pattern: str, flags: int = re.ASCII):
    """Boolean query over lower-case trigrams that each matching text meets.

    True (nothing is mandatory), a trigram as bytes, ``("and", parts)`` or
    ``("or", parts)``.
    """
    exact, query = _sequence(_parser.parse(pattern, flags))
    return _both(query, _flush(exact))


def _both(a, b):
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", (a, b))


def _flush(exact):
    """Query that one of the exact strings occurs."""
    if exact is None:
        return True
    ways = []
    for text in sorted(exact):
        data = text.encode()
        grams = tuple(dict.fromkeys(data[i : i + 3] for i in range(len(data) - 2)))
        if not grams:
            return True
        ways.append(grams[0] if len(grams) == 1 else ("and", grams))
    return ways[0] if len(ways) == 1 else ("or", tuple(ways))


def _sequence(items):
    """Exact strings of a sequence (None: unknown) and the query of what was given up on the way."""
    exact, query, whole = {""}, True, True
    for item in items:
        more, asked = _item(*item)
        query = _both(query, asked)
        if more is not None and len(exact) * len(more) <= MOST_EXACT:
            exact = {a + b for a in exact for b in more}
            continue
        query, whole = _both(query, _flush(exact)), False
        exact = more if more is not None else {""}
    if whole:
        return exact, query
    return None, _both(query, _flush(exact))


def _item(kind, value):
    if kind is kinds.LITERAL:
        return {chr(value).lower() if value < 128 else chr(value)}, True
    if kind is kinds.IN:
        found = set()
        for what, x in value:
            if what is kinds.LITERAL:
                found.add(chr(x).lower() if x < 128 else chr(x))
            elif what is kinds.RANGE and x[1] - x[0] < 4:
                found |= {chr(c).lower() if c < 128 else chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (found, True) if len(found) <= 8 else (None, True)
    if kind is kinds.SUBPATTERN:
        return _sequence(value[3])
    if kind is kinds.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(e is not None and q is True for e, q in parts):
            return set().union(*(e for e, _ in parts)), True
        ways = [_both(q, _flush(e)) for e, q in parts]
        return None, True if True in ways else ("or", tuple(ways))
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        low, high, inner = value
        exact, query = _sequence(inner)
        if low == 0:
            return (exact | {""}, True) if high == 1 and exact is not None and query is True else (None, True)
        if exact is not None and low == high and low <= 4 and len(exact) == 1:
            return {next(iter(exact)) * low}, query
        return None, _both(query, _flush(exact))
    if kind is kinds.AT or kind is kinds.ASSERT or kind is kinds.ASSERT_NOT:
        return {""}, True
    return None, True


def _trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Index:
    """Inverted trigram index of the texts in one block, for the trigrams that rules ask for."""

    def __init__(self, values: pa.Array, lower: np.ndarray, wanted: np.ndarray):
        data, begins = text_bytes(values)
        self.n, self.postings = len(values), {}
        if len(data) < 3:
            return
        folded = lower[data].astype(np.uint32)
        codes = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
        at = np.flatnonzero(wanted[codes])
        text = np.searchsorted(begins, at, side="right") - 1
        inside = at + 2 < begins[text + 1]
        entries = np.unique((codes[at[inside]].astype(np.int64) << 32) | text[inside])
        grams = entries >> 32
        cuts = np.flatnonzero(np.diff(grams)) + 1
        for part in np.split(entries, cuts):
            if len(part):
                self.postings[int(part[0] >> 32)] = part & 0xFFFFFFFF

    def texts(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.zeros(0, dtype=np.int64))
        sets = sorted((self.texts(q) for q in query[1]), key=len)
        found = sets[0]
        for other in sets[1:]:
            if query[0] == "and" and not len(found):
                break
            found = (np.intersect1d if query[0] == "and" else np.union1d)(found, other)
        return found


def block_scanner(rules: tuple[Rule, ...]):
    """Function from a block of texts to the spans of each: (start, rule number, end), sorted.

    Postings are kept per block and die with it: a corpus that is scanned once
    needs no index that outlives the pass. A rule runs on the texts that its
    Boolean query leaves; rules without mandatory trigrams run on all.
    """
    queries = [trigram_query(r.pattern, r.regex.flags & ~re.UNICODE) for r in rules]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    grams = sorted({int.from_bytes(g, "big") for q in queries for g in _trigrams(q)})
    table: list[np.ndarray] = []

    def spans_of(values: pa.Array, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        if not table:
            table.append(np.zeros(1 << 24, dtype=bool))
            table[0][grams] = True
        index, found = Index(values, lower, table[0]), {}
        for order, (rule, query) in enumerate(zip(rules, queries)):
            for i in index.texts(query).tolist():
                if texts[i]:
                    found.setdefault(i, []).extend((s, order, e) for s, e in rule.spans(texts[i]))
        return [sorted(found.get(i, ())) for i in range(len(texts))]

    return spans_of


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` with the secrets of a text column: an array of kind, start, end.

    Offsets count code points, the end is exclusive. Per rule matches are the
    leftmost, not overlapping, and those that are too short are dropped; spans
    of different rules may overlap. They stand by start, then in rule order.
    Null and empty texts have an empty array. A column of the same name is
    replaced; rows, repeated ones too, stay.
    """
    spans_of = block_scanner(rules)

    def make(values: pa.Array) -> list[list]:
        found = spans_of(values, values.to_pylist())
        return [[[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in own] for own in found]]

    return add_columns(docs, text, {name: SPAN}, make)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by ``<SECRET>``; all rows and columns stay.

    Spans that overlap or touch are replaced as one. A column ``n_chars``, if
    there is one, is counted anew where the text changed.
    """
    spans_of, columns = block_scanner(rules), [F.col(f"`{c}`") for c in docs.columns]
    changed = free_name(docs, "changed")

    def make(values: pa.Array) -> list[list]:
        texts = values.to_pylist()
        found = spans_of(values, texts)
        cuts = [[(start, end) for start, _, end in own] for own in found]
        return [[cut_out(t, c, MARK) if c else t for t, c in zip(texts, cuts)], [bool(c) for c in cuts]]

    out = add_columns(docs, text, {text: "string", changed: "boolean"}, make)
    if "n_chars" in docs.columns:
        counted = F.length(F.col(text)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(changed), counted).otherwise(F.col("n_chars")))
    return out.select(*columns)
