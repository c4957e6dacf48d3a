"""Paths of fitted trees, read from a model's description."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Statistic or feature by number, whether the value must be above the bound, the bound.
Bound = tuple[int, bool, float]


def paths(described: str) -> Iterator[tuple[tuple[Bound, ...], float | None]]:
    """Bounds on the way to each node below a root, in order; for leaves also tree weight times prediction."""
    weight, path, base = 1.0, [], None
    for line in described.splitlines():
        tree = re.match(r"\s+Tree \d+ (?:\(weight ([-+.\dEe]+)\))?", line)
        node = re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        leaf = re.match(r"( +)Predict: ([-+.\dEe]+)", line)
        if tree:
            weight, path, base = float(tree[1] or 1.0), [], None
        elif node:
            base = len(node[1]) if base is None else base
            del path[len(node[1]) - base :]
            path.append((int(node[2]), node[3] == ">", float(node[4])))
            yield tight(path), None
        elif leaf:
            yield tight(path), weight * float(leaf[2])


def tight(path: list[Bound]) -> tuple[Bound, ...]:
    """The same bounds, of several on one side only the tightest, sorted."""
    found: dict[tuple[int, bool], float] = {}
    for feature, above, bound in path:
        old = found.get((feature, above), bound)
        found[feature, above] = max(old, bound) if above else min(old, bound)
    return tuple(sorted((f, above, bound) for (f, above), bound in found.items()))
