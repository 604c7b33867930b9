"""Mixing sources to target weights: budgets filled exactly by lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_spread, materialize, release

#: Documents that the last step of a source's fit first gives back, and leaves aside.
SOME = 25
#: Bits of reachable sums that it keeps at most, and words of 64 bits that it goes through.
ROOM = 1 << 29


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Each source's share of the sum of ``sizes``.

    Sources in order of code points, null last, weigh ``weights``, repeating.
    A share stops at ``most`` times the source's size; the excess is shared
    again by weight among the others until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    out: dict[str | None, float] = {}
    free = list(names)
    while free:
        left = total - sum(out.values())
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / whole for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return {s: out[s] for s in names}


def draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` documents, drawn over all lengths alike, fall on each length.

    Systematic rounding of cumulated counts from a seeded start: a length with
    ``c`` of all documents gets its share of ``n`` rounded down or up, one with
    a single document the document or nothing. Lengths are cumulated in order,
    neighbours shuffled, so the drawn documents' mean length is near that of all.
    """
    total = int(counts.sum())
    if not total or not n:
        return np.zeros(len(counts), np.int64)
    order = np.argsort(np.arange(len(counts)) + rng.uniform(0, 8, len(counts)))
    # Integers: a float's product would be off at the sizes of a large corpus.
    at = int(rng.random() * total)
    out, before = np.zeros(len(counts), np.int64), at // total
    for i in order.tolist():
        at += int(counts[i]) * n
        out[i], before = at // total - before, at // total
    return out


def nearest(lengths: np.ndarray, free: np.ndarray, left: int, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """Documents out of ``free`` whose sum comes next to ``left``.

    Bounded-knapsack dynamic programming over sums, each length in as many as
    there are. Documents drawn over all lengths come first, enough to hold
    ``left`` and some choice, then the others until no sum is nearer.
    Returns also whether ``ROOM`` was enough for all of them.
    """
    take, limit = np.zeros(len(lengths), np.int64), left + min(left, int(lengths.max()))  # none beyond is nearer than 0
    total, words = int(free.sum()), int((lengths * free).sum())
    if not left or not total or limit > ROOM // 4:
        return take, limit <= ROOM // 4
    pool = draw(free, min(total, left * total // words + SOME), rng)
    tries = [(i, int(n[i]), n is not pool) for n in (pool, free - pool) for i in rng.permutation(len(lengths)).tolist() if n[i]]
    step = int(np.gcd.reduce(lengths[free > 0]))
    off = min(left % step, -left % step)  # sums are multiples of the step
    mask = (1 << (limit + 1)) - 1
    reach, steps, tried, room = 1, [], 0, True
    for i, n, last in tries:
        if last and (reach >> (left - off) | reach >> (left + off)) & 1:
            break
        size, chunk = int(lengths[i]), 1
        n = min(n, limit // size)
        while n > 0 and room:
            chunk = min(chunk, n)
            more = (reach | reach << size * chunk) & mask
            if more != reach:
                steps.append((i, chunk, reach))
                reach = more
            n -= chunk
            chunk *= 2
            tried += 1
            room = max(len(steps), tried // 64) * limit < ROOM
    low = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    high = left + ((above & -above).bit_length() - 1) if above else None
    at = low if high is None or left - low <= high - left else high
    ahead = sum(chunk * int(lengths[i]) for i, chunk, _ in steps)
    for i, chunk, before in reversed(steps):
        size = chunk * int(lengths[i])
        # Where the sum is reached with and without, chance decides, so that no lengths are preferred.
        if not before >> at & 1 or at >= size and before >> (at - size) & 1 and rng.random() * ahead < at:
            take[i] += chunk
            at -= size
        ahead -= size
    return take, room


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 7) -> np.ndarray:
    """How many documents of each length to take so that their sum comes next to ``budget``.

    First the budget's share of all documents is drawn over all lengths (see
    :func:`draw`), so the choice keeps the source's mix of lengths however
    many documents share one. If that does not meet the budget, ``SOME`` drawn
    documents are given back, of whatever length, and what is left is fitted by
    :func:`nearest`: the largest sum not above it, or one nearer above it. While
    that misses, four times as many are given back, until all are, when no
    choice is nearer, or until the sums take more than ``ROOM``.
    """
    order = np.argsort(lengths)
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.int64)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    whole, total = int((lengths * counts).sum()), int(counts.sum())
    budget = max(0, min(int(budget), whole))
    if not whole:
        return out
    rng = np.random.default_rng(seed)
    take = draw(counts, budget * total // whole, rng)
    step = int(np.gcd.reduce(lengths))
    off = lambda take: abs(int((lengths * take).sum()) - budget)
    # More documents are given back, at last all, until the sum is met or the room is used up.
    n, drawn, room = SOME, take, True
    while room and off(take) > min(budget % step, -budget % step):
        kept = drawn - draw(drawn, min(n, int(drawn.sum())), rng)
        left = budget - int((lengths * kept).sum())
        if left >= 0:
            more, room = nearest(lengths, counts - kept, left, rng)
            take = min(take, kept + more, key=off)
        if not kept.any():
            break
        n *= 4
    out[order] = take
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, most_sources: int = 1_000_000) -> DataFrame:
    """How often each document is taken so that sources meet their targets.

    A document's size is its number of words between ASCII white space. A
    source's target (see ``targets``) is met by whole documents: all of them
    as often as the target holds the source, and for the rest of the budget
    some once more (or more often, if only that comes nearer), drawn over all
    lengths: documents are counted by exact size, :func:`fit` says how many of
    each size, and within a size those with the smallest seeded hashes of id
    and text are taken. Documents that share a
    size and a source are ranked by ranges of the hash, as many as the square
    root of their number, so neither a range nor the ranges grow large.

    Returns ``docs``'s id and source columns with ``size``, ``source_size``,
    ``target``, ``copies`` (0 to ``most``), ``taken`` (size times copies) and
    ``row``: the row's value of ``row_col``, which numbers the rows, if given. Null text: size 0, never taken. Null sources are one source.
    Repeated rows count each. No rows give no rows. Sources are listed on the
    driver, up to ``most_sources`` (then an error).
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed))
    base = docs.select((F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words.alias("size"), draw.alias("draw"))
    base = materialize(base, "mix-sizes")
    by_length = materialize(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(most_sources + 1).collect()
    if len(sizes) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    size = {r.source: int(r.size) for r in sizes}
    target = targets(size, weights, most)
    plan = []
    for s, t in target.items():
        whole = min(most, int(t // size[s])) if size[s] else 0
        rest = round(t) - whole * size[s] if whole < most else 0
        plan.append((s, size[s], float(t), whole, max(0, rest)))
    # One row for each source, bounded by ``most_sources``; joined, not broadcast by hint.
    plans = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, rest long")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        size, n, rest = rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["rest"].iloc[0])
        more = fit(size, n, rest, seed=seed)
        if (size * more).sum() != rest:  # some documents more than once may come nearer
            again = fit(size, n * (most - int(rows["whole"].iloc[0])), rest, seed=seed)
            if abs((size * again).sum() - rest) < abs((size * more).sum() - rest):
                more = again
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "n": rows["n"], "more": more})

    # A source's rows here are its distinct sizes, no more than its longest document has words.
    joined = by_length.join(plans.select("source", "whole", "rest"), by_length["source"].eqNullSafe(plans["source"])).select(by_length["source"], "size", "n", "whole", "rest")
    more = joined.groupBy("source").applyInPandas(fitted, "source string, size long, n long, more long")
    more = materialize(more.join(plans.drop("rest").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mix-counts")
    no_null = {"source_key": F.coalesce("source", F.lit("")), "no_source": F.col("source").isNull()}
    keys = ["source_key", "no_source", "size"]
    rows = join_spread(base.withColumns(no_null), more.withColumns(no_null).drop("source").withColumn("held", F.col("n")), keys)
    # Ranges of the hash: those below the one where the count is reached are taken whole.
    ranges = F.ceil(F.sqrt("n"))
    unit = F.pmod("draw", F.lit(1 << 40)).cast("double") / float(1 << 40)
    rows = materialize(rows.withColumn("range", F.floor(unit * ranges).cast("long")), "mix-rows")
    held = rows.groupBy(*keys, "range").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("before", F.coalesce(before, F.lit(0))).drop("held")
    rows = rows.join(held, [*keys, "range"])
    rest = F.col("more") - F.expr("more div n") * F.col("n")
    rank = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("draw", "id", "row"))
    rows = rows.withColumn("extra", F.expr("more div n") + F.when(F.col("before") + rank <= rest, 1).otherwise(0))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int")
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "row")
