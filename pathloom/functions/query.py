"""Queries: a path of node types, and maybe an equality on one of them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Constraint:
    """``type.attribute = value``; values are strings, compared exactly. ``also`` has more attributes that must be equal."""

    type: str
    attribute: str
    value: str
    also: tuple[tuple[str, str], ...] = ()

    @property
    def equalities(self) -> tuple[tuple[str, str], ...]:
        return ((self.attribute, self.value), *self.also)

    def __str__(self) -> str:
        return " AND ".join(f'{self.type}.{a}="{v}"' for a, v in self.equalities)


@dataclass(frozen=True, eq=False)
class Predicate:
    """Any condition on the nodes of a type, as a column; two are alike if they read alike."""

    type: str
    where: Any

    def __str__(self) -> str:
        return f"{self.type}: {self.where}"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Predicate) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))


@dataclass(frozen=True)
class MetapathQuery:
    """Node types in order, such as ``("A", "P", "C")``, and the constraint."""

    path: tuple[str, ...]
    constraint: Constraint | Predicate | None = None

    def __post_init__(self):
        if len(self.path) < 2:
            raise ValueError(f"a path needs two node types at least: {self.path!r}")

    @property
    def relations(self) -> list[tuple[str, str]]:
        return list(zip(self.path[:-1], self.path[1:], strict=True))

    @property
    def positions(self) -> frozenset[int]:
        """Places of the path that the constraint binds.

        It binds the first place of its type, and with it the next one if the
        first relation that touches the type has it on both ends.
        """
        if self.constraint is None or self.constraint.type not in self.path:
            return frozenset()
        kind = self.constraint.type
        for at, ends in enumerate(self.relations):
            if kind in ends:
                return frozenset(at + i for i, x in enumerate(ends) if x == kind)
        return frozenset()

    def __str__(self) -> str:
        text = "".join(self.path) if all(len(x) == 1 for x in self.path) else "-".join(self.path)
        return f"{text}\t{self.constraint}" if self.constraint else text


def parse_query(line: str) -> MetapathQuery:
    """``PATH<tab>TYPE.ATTR="VALUE"``; the constraint is optional, quotes do not count.

    A path is a run of one-letter types, or names joined by hyphens. The
    constraint is split at its first ``=`` and its first ``.``. After a quote
    ``AND`` begins another equality, on the same type.
    """
    path, _, rest = line.rstrip("\r\n").partition("\t")
    types = tuple(path.split("-")) if "-" in path else tuple(path)
    if not rest.strip():
        return MetapathQuery(types)
    kinds, pairs = [], []
    for one in re.split(r'(?<=")\s+AND\s+', rest):
        left, sign, value = one.replace('"', "").partition("=")
        kind, dot, attribute = left.strip().partition(".")
        if not (sign and dot and kind and attribute):
            raise ValueError(f"not a constraint: {one!r}")
        kinds.append(kind)
        pairs.append((attribute, value))
    if len({*kinds}) > 1:
        raise ValueError(f"a constraint is on one type: {rest!r}")
    return MetapathQuery(types, Constraint(kinds[0], *pairs[0], tuple(pairs[1:])))


def read_workload(source: str | Path | Iterable[str]) -> list[MetapathQuery]:
    """Queries in order, from a file with one in a line or from lines; blank lines do not count."""
    lines = Path(source).read_text().splitlines() if isinstance(source, (str, Path)) else source
    return [parse_query(x) for x in lines if x.strip()]
