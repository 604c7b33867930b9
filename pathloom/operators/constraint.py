"""Constraints: which nodes they pick, and the relations they narrow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.query import Constraint, MetapathQuery, Predicate
from ..sources.schema import Graph

#: Up to so many picked ids are written into the filter; beyond, they are joined.
LITERALS = 100


@dataclass
class Picked:
    """Ids that meet a constraint: a short list, or a table of distinct ids if they are many."""

    ids: list[int] | None
    table: DataFrame | None
    count: int

    def keep(self, rel: DataFrame, end: str) -> DataFrame:
        """The relation's pairs whose end is picked.

        Literals reach the scan of the files; a table is a semi-join, whose
        strategy the optimizer chooses by size.
        """
        if self.ids is not None:
            return rel.where(F.col(end).isin(self.ids) if self.ids else F.lit(False))
        return rel.join(self.table.withColumnRenamed("id", end), end, "left_semi").select("src", "dst", "n")


def matches(graph: Graph, constraint: Constraint | Predicate) -> DataFrame:
    """Ids of the nodes that meet all equalities of a constraint, or a predicate; null values meet none."""
    nodes = graph.node_table(constraint.type)
    if isinstance(constraint, Predicate):
        where = constraint.where
    else:
        where = F.lit(True)
        for attribute, value in constraint.equalities:
            if attribute not in nodes.columns:
                raise ValueError(f"nodes of type {constraint.type} have no attribute {attribute}")
            where &= F.col(attribute).cast("string") == F.lit(value)
    return nodes.where(where).select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()


def resolve(graph: Graph, query: MetapathQuery, first_match_only: bool = True) -> Picked | None:
    """What the query's constraint picks: its smallest id alone, or all.

    None if there is no constraint or its type is not on the path.
    """
    if not query.positions:
        return None
    key = (query.constraint, first_match_only)
    if key not in graph.picked:  # the graph does not change, so what a constraint picks does not
        graph.picked[key] = _resolve(matches(graph, query.constraint), first_match_only)
    return graph.picked[key]


def _resolve(ids: DataFrame, first_match_only: bool) -> Picked:
    if first_match_only:
        low = ids.agg(F.min("id")).first()[0]
        return Picked([] if low is None else [low], None, int(low is not None))
    few = [r.id for r in ids.limit(LITERALS + 1).collect()]
    if len(few) <= LITERALS:
        return Picked(sorted(few), None, len(few))
    return Picked(None, ids, ids.count())


def bind(graph: Graph, query: MetapathQuery, picked: Picked | None) -> list[DataFrame]:
    """The path's relations, each narrowed at the bound places it touches.

    Narrowing the relation on either side of a bound place changes no result
    and makes each stretch of the path depend on nothing but its own letters
    and bound places, which is what caches go by.
    """
    out = []
    for at, (src, dst) in enumerate(query.relations):
        rel = (graph.rows if len(query.relations) > 1 else graph.relation)(src, dst)
        for end, place in (("src", at), ("dst", at + 1)):
            if picked is not None and place in query.positions:
                rel = picked.keep(rel, end)
        out.append(rel)
    return out
