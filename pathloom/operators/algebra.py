"""Counting paths: joins on the shared node, summed by the two ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import Plan

#: Joins after which a long chain is cut by a reliable checkpoint.
CUT = 8


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that a path through a shared node joins, with the number of paths.

    Numbers are 64-bit and overflow is an error. The sum by ends comes right
    after the join, so partial sums meet before the shuffle and the node in
    the middle goes no further.
    """
    left, right = a.select("src", F.col("dst").alias("mid"), F.col("n").alias("left_n")), b.select(F.col("src").alias("mid"), "dst", F.col("n").alias("right_n"))
    return left.join(right, "mid").groupBy("src", "dst").agg(F.sum(F.col("left_n") * F.col("right_n")).alias("n"))


def evaluate(plan: Plan, factors: list[DataFrame]) -> DataFrame:
    """One lazy DataFrame for a plan; a plan of one relation is that relation."""
    return _evaluate(plan, factors)[0]


def _evaluate(plan: Plan, factors: list[DataFrame]) -> tuple[DataFrame, int]:
    if isinstance(plan, int):
        return factors[plan], 0
    (a, m), (b, n) = _evaluate(plan[0], factors), _evaluate(plan[1], factors)
    out, depth = product(a, b), m + n + 1
    if depth >= CUT and out.sparkSession.sparkContext.getCheckpointDir():
        return out.checkpoint(), 0
    return out, depth
