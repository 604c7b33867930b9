"""Consistent sharding by a permutation-filled lookup table, DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a key's MD5 that are read as a number; 60 bits fit a long.
DIGITS = 15


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def hashed(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def lookup_table(shards: list[str], size: int) -> list[int]:
    """For each of ``size`` slots the number of its shard in ``shards``.

    Shards take turns in the order given; at its turn a shard claims the first
    free slot of its own order of preference, which starts at an offset and
    goes on by a step, both hashed from its name. ``size`` is prime, so any
    step visits all slots, and shards' shares differ by one slot at most. If a
    shard goes, few slots besides its own change hands.
    """
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime not below the number of shards")
    if not shards or len({*shards}) < len(shards):
        raise ValueError("shards must be named, each by a name of its own")
    at = [hashed(f"{s}/offset") % size for s in shards]
    step = [hashed(f"{s}/step") % (size - 1) + 1 for s in shards]
    table, free, turn = [-1] * size, size, 0
    while free:
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % size
        table[at[i]] = i
        free, turn = free - 1, turn + 1
    return table


def slot(key: Column, size: int) -> Column:
    """The slot of a key; null keys hash as the empty string."""
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS), 16, 10)
    return F.pmod(number.cast("long"), F.lit(size).cast("long"))


def shard(df: DataFrame, key: str, shards: list[str], size: int, to: str = "shard") -> DataFrame:
    """``df`` with each row's ``slot`` and shard by ``key``.

    The table has ``size`` rows whatever the data, so it is broadcast and each
    row finds its shard by one lookup; no row is moved. Rows with equal keys
    share a shard; null keys are placed as the empty string is. All columns
    stay (those named ``slot`` or ``to`` are replaced, so the key may not be
    named so); no rows give no rows.
    """
    if key in {"slot", to}:
        raise ValueError(f"the key may not be named {key}")
    rows = [(i, shards[x]) for i, x in enumerate(lookup_table(shards, size))]
    places = df.sparkSession.createDataFrame(rows, f"slot long, `{to}` string")
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in {"slot", to}))
    return kept.withColumn("slot", slot(F.col(f"`{key}`"), size)).join(F.broadcast(places), "slot")


def shard_sql(table: str, key: str, shards: list[str], size: int) -> str:
    """The same in SQL, the table filled turn by turn by a recursive query."""
    number = f"('0x' || substr(md5({{}}), 1, {DIGITS}))::BIGINT"
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""
WITH RECURSIVE shards(i, shard) AS (VALUES {names}),
ways AS (SELECT i, shard, {number.format("shard || '/offset'")} % {size} AS start, {number.format("shard || '/step'")} % {size - 1} + 1 AS step FROM shards),
fill(turn, slot, taken) AS (
  SELECT 0, start, [start] FROM ways WHERE i = 0
  UNION ALL
  SELECT turn + 1, s, list_append(taken, s) FROM (
    SELECT turn, taken, list_filter(list_transform(range({size}), lambda j: (start + j * step) % {size}), lambda x: NOT list_contains(taken, x))[1] AS s
    FROM fill JOIN ways ON i = (turn + 1) % {len(shards)} WHERE turn + 1 < {size})
),
places AS (SELECT f.slot, w.shard FROM fill f JOIN ways w ON w.i = f.turn % {len(shards)})
SELECT d.{key}, p.slot, p.shard FROM {table} d JOIN places p ON p.slot = {number.format(f"coalesce(d.{key}::VARCHAR, '')")} % {size}
"""
