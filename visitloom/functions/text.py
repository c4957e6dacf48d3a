"""String and URL expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, NULL where nothing matches.

    Spark returns '' on no match, so patterns must not allow an empty group.
    """
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def url_param(url: Column, name: str) -> Column:
    """Value of ``name=`` up to the next ``&``, wherever it stands in the URL.

    ``parse_url`` would miss parameters that sit behind a ``#``.
    """
    return regex_group(url, re.escape(name) + r"=([^&]+)")


def strip_host(url: Column, host: str) -> Column:
    """Path and query of ``url`` when it lies on ``host``, else ``url`` unchanged."""
    return F.regexp_replace(url, r"^https?://(?:www\.)?" + re.escape(host), "")


def split_part_at(text: Column, separator: str, index: int) -> Column:
    """0-based part of a split, NULL when there are too few parts."""
    return F.get(F.split(text, re.escape(separator)), F.lit(index))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def or_unknown(text: Column, label: str = "unknown") -> Column:
    """``label`` where the text is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(label))


def source_medium(source: Column, medium: Column, fill: str | None = None) -> Column:
    """``"source / medium"``; without ``fill`` a NULL side makes the result NULL."""
    if fill is not None:
        source, medium = F.coalesce(source, F.lit(fill)), F.coalesce(medium, F.lit(fill))
    return F.concat(source, F.lit(" / "), medium)


def _alternatives(patterns: Sequence[str] | None) -> str:
    accepted = []
    for pattern in (p for p in patterns or () if p):
        if pattern == "*":
            accepted.append(".*")
        elif "*" not in pattern:
            accepted.append(re.escape(pattern))
        elif not pattern.startswith("*"):
            accepted.append(re.escape(pattern.split("*", 1)[0]) + ".*")
    return "|".join(accepted)


def name_passes(name: Column, allow: Sequence[str] | None, block: Sequence[str] | None = None) -> Column:
    """Case-insensitive test against lists of names, ``prefix*`` or ``*``: the
    block list wins, no allow list means all, an empty name never passes.

    One regular expression, because a filter repeats its column as often as it
    is named, and the name may have to be parsed out of JSON each time.
    """
    wanted = _alternatives(allow) if allow else ".*"
    if not wanted:
        return F.lit(False)
    unwanted = _alternatives(block)
    refuse = rf"(?!(?:{unwanted})\z)" if unwanted else ""
    return name.rlike(rf"(?isu)\A(?!\z){refuse}(?:{wanted})\z")
