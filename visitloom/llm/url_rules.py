"""URL filters: rules are found by a rare token of theirs, only those found run their regex."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import free_name

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path (``site``) or in the whole lower-case URL.

    ``tokens`` are runs of a-z and 0-9 that stand, as whole tokens, in each URL
    that the pattern finds; a rule without any is tried on every URL.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(verdict: str, rule: str) -> Rule:
    """A host with all its subdomains and the beginning of a path: ``example.net/en/``."""
    host, slash, rest = rule.partition("/")
    whole = slash + rest
    sure = whole if re.search(r"[^A-Za-z0-9]$", whole) else re.sub(r"[A-Za-z0-9]+$", "", whole)
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(whole)}"
    return Rule(rule, verdict, pattern, _tokens(f"{host} {sure}"), True)


def part_rule(verdict: str, part: str) -> Rule:
    """A part of the URL, with ``*`` for any characters: ``/login/``, ``/ads/*.gif``."""
    pattern = ".*".join(map(re.escape, part.lower().split("*")))
    # A token at an end of a literal stretch may be part of a longer one in the URL.
    inner = [re.sub(r"^[a-z0-9]+|[a-z0-9]+$", "", x) for x in part.lower().split("*")]
    return Rule(part, verdict, pattern, _tokens(" ".join(inner)), False)


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))


# The given rules.
SITE_RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)
# Pages without prose of their own.
PART_RULES = tuple(
    part_rule("block", part)
    for part in (
        "/login/", "/signin/", "/register/", "/cart/", "/checkout/", "/wp-admin/", "/cgi-bin/",
        "?sessionid=", "&sessionid=", "?phpsessid=", "/ads/*.gif", "/casino/", "/porn/",
    )
)
RULES = SITE_RULES + PART_RULES


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    start = F.instr(url, "://")
    after = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``.

    Site rules come first, the longest that fits; ``rule`` is its name. Without
    one the longest other rule found gives the verdict, and without that it is
    ``default``, which null, empty and malformed URLs get. Equal lengths: the
    first by name. All rows stay, repeated ones too; columns named like the new
    ones are replaced.

    Each distinct URL is judged once. Its tokens fetch the rules that are
    indexed by them; a rule is indexed by that of its tokens which the fewest
    URLs have, so a token in every URL fetches only rules that have no other.
    """
    spark = pages.sparkSession
    names = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in names]
    own = free_name(pages, "own_url")
    given = pages.withColumn(own, F.col(url)).select(*(F.col(f"`{c}`") for c in kept), own)
    host, path = host_path(F.col("u"))
    urls = given.where(F.col(own).isNotNull()).select(F.col(own).alias("u")).distinct()
    urls = urls.select("u", F.concat(host, path).alias("site"), F.translate("u", _UPPER, _LOWER).alias("whole"))
    found = F.array_distinct(F.split("whole", "[^a-z0-9]+"))
    tokens = urls.select("u", "site", "whole", F.explode(found).alias("token"))

    listed = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, r.site) for i, r in enumerate(rules)],
        "id int, name string, verdict string, pattern string, on_site boolean",
    )
    asked = spark.createDataFrame(
        [(i, t) for i, r in enumerate(rules) for t in r.tokens], "id int, token string"
    )
    seen = tokens.join(asked.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        asked.join(seen, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = listed.join(rarest, "id")
    subject = F.when(F.col("on_site"), F.col("site")).otherwise(F.col("whole"))
    fits = tokens.join(index, "token").withColumn("subject", subject).where(F.expr("subject rlike pattern"))
    fits = fits.select("u", "name", "verdict", "on_site")
    for r in (r for r in rules if not r.tokens):
        fits = fits.unionByName(
            urls.where(F.col("site" if r.site else "whole").rlike(r.pattern)).select(
                "u", F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.site).alias("on_site")
            )
        )
    order = F.struct(F.col("on_site"), F.length("name"))
    best = fits.groupBy("u").agg(
        F.max(order).alias("best"), F.max_by("name", F.struct(order, F.col("name"))).alias("name"),
        F.max_by("verdict", F.struct(order, F.col("name"))).alias("verdict"),
    )
    host, path = host_path(F.col(own))
    return given.join(best, F.col(own) == F.col("u"), "left").select(
        *(F.col(f"`{c}`") for c in kept),
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.on_site"), F.col("name")).alias("rule"),
        F.coalesce(F.col("verdict"), F.lit(default)).alias("verdict"),
    )
