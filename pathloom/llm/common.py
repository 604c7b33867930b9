"""What the corpus operators share: scratch tables, id ranges, hashing, names."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and a word as what lies between it.
WORD = "[^\\x20\\x09-\\x0D]+"


#: What this driver has written below the shared folder.
written: list[str] = []
#: A key is frequent if it has more than one in so many rows; so there are fewer frequent keys than this.
FREQUENT = 1000
#: And it has more rows than this: fewer weigh on no task.
WEIGHTY = 1000
#: Bytes of bitmaps that :func:`with_marks` may broadcast.
BITMAPS = 64 << 20
#: Bits that :func:`likely` has for a key, or up to twice as many, while they fit into ``BITMAPS``.
SPARSE = 32


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(at, True)
    store.cancelDeleteOnExit(at)


def discard(spark: SparkSession) -> None:
    """Deletes all scratch tables and files, once nothing that reads them is needed any more."""
    while written:
        _delete(spark, written.pop())


def release(*tables: DataFrame) -> None:
    """Deletes scratch tables of :func:`materialize` that no later step reads."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path in written:
            written.remove(path)
            _delete(df.sparkSession, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    It goes with the driver, if :func:`release` or :func:`discard` have not
    deleted it before. Where the setting is absent, a local temporary folder
    does on one machine; elsewhere that is an error, as executors would not
    see each other's files.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    written.append(path)
    return path


def materialize(df: DataFrame, label: str, batch: int | None = None, **watch: Column) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage, so a lost executor costs a read and not the work
    before, and later passes see exactly these rows in any order of tasks.
    ``batch`` is the number of rows that Python workers are given at a time
    meanwhile, for long texts; the session's own setting comes back. What the
    aggregates ``watch`` come to is noted on the way, in the result's ``seen``.
    """
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark, label), spark.conf.get(setting)
    notes = Observation(label) if watch else None
    if notes:
        df = df.observe(notes, *(x.alias(name) for name, x in watch.items()))
    if batch:
        spark.conf.set(setting, str(batch))
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/rows")
    finally:
        if batch:
            spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(f"{path}/rows")
    out.scratch_path, out.seen = path, notes.get if notes else {}
    return out


def groups(df: DataFrame, label: str, held: str = "held") -> DataFrame:
    """:func:`materialize` for the right side of :func:`join_spread`: the sum and the largest of ``held`` are noted."""
    return materialize(df, label, whole=F.sum(held), top=F.max(held))


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", held: str = "held") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, with no frequent key in one task.

    ``right``'s column ``held`` is the number of ``left``'s rows with the key
    (or more). Keys that hold more than one in ``FREQUENT`` of the sum (and
    ``WEIGHTY`` rows) are broadcast: by that there are fewer than ``FREQUENT``
    of them, however large the tables, and their rows stay where they are. All
    others are joined as usual. ``how`` is ``inner`` or ``left``; rows with
    null keys match nothing. The columns are ``left``'s and ``right``'s other
    ones.
    """
    notes = getattr(right, "seen", None) or right.agg(F.sum(held).alias("whole"), F.max(held).alias("top")).first().asDict()
    limit = max((notes["whole"] or 0) // FREQUENT, WEIGHTY)
    if (notes["top"] or 0) <= limit:
        return left.join(right.drop(held), keys, how)
    often = F.col(held) > F.lit(limit)
    few, rest = F.broadcast(right.where(often).drop(held)), right.where(~often).drop(held)
    known = left.dropna(subset=keys)
    out = known.join(few, keys).unionByName(known.join(few.select(*keys), keys, "left_anti").join(rest, keys, how))
    if how == "left":
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rest.schema if f.name not in keys]
        out = out.unionByName(left.where(" or ".join(f"{k} is null" for k in keys)).select("*", *none))
    return out


def with_marks(rows: DataFrame, marks: DataFrame, row: str, mark: str, bits: int = 1) -> DataFrame:
    """``rows`` with the number ``mark`` that ``marks`` has for their number ``row``, or 0.

    ``rows`` are long (texts), so they should stay where they are: the marks,
    whole numbers of ``bits`` bits, become bitmaps of 32,768 rows each, which
    are broadcast if they take up ``BITMAPS`` bytes at most (a bit a row, more
    where numbers have gaps); otherwise rows and marks are joined as usual.
    ``row`` counts from 0, is in ``marks`` once and starts no other column's
    name. Marks of 0 may be left out.
    """
    at, block = F.col(row) + 1, f"{row}_block"  # bitmaps count from 1
    marks = materialize(marks.where(F.col(mark) > 0).select(row, F.col(mark).cast("int").alias(mark)), "marks")
    some = marks.withColumn(block, F.bitmap_bucket_number(at)).repartition(parts_of(rows.sparkSession), block)
    names = [f"{row}_bits{i}" for i in range(bits)]
    # A row number of null is in no bitmap.
    maps = some.groupBy(block).agg(*(F.bitmap_construct_agg(F.when(F.shiftright(mark, i).bitwiseAND(1) == 1, F.bitmap_bit_position(at))).alias(x) for i, x in enumerate(names)))
    maps = materialize(maps, "bitmaps", held=F.sum(sum((F.length(x) for x in names), F.lit(0))))
    if (maps.seen["held"] or 0) > BITMAPS:
        found = rows.join(marks, row, "left").withColumn(mark, F.coalesce(mark, F.lit(0)))
    else:
        spot = f"{row}_spot"
        bit = lambda x: F.expr(f"shiftright(cast(conv(hex(substr({x}, {spot} div 8 + 1, 1)), 16, 10) as int), cast({spot} % 8 as int)) & 1")
        found = rows.withColumns({block: F.bitmap_bucket_number(at), spot: F.bitmap_bit_position(at)}).join(F.broadcast(maps), block, "left")
        found = found.withColumn(mark, sum((F.coalesce(bit(x), F.lit(0)) * (1 << i) for i, x in enumerate(names)), F.lit(0)))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), mark)


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` are in ``wanted``, and a few others.

    For a join of a large table of long rows with keys of few of them: what
    the join would drop is mostly dropped where it lies, by one bit for each
    hash of ``keys`` (:func:`with_marks`). Of the others one in ``SPARSE`` or
    less stays, more if there are so many keys that the bitmaps would outgrow
    ``BITMAPS``; no wanted row goes. ``wanted`` is a small table that can be
    read twice; rows with null keys may go.
    """
    spot, mark = "_likely", "_likely_wanted"
    bits = min(1 << max(15, (SPARSE * wanted.count()).bit_length()), 1 << max(15, (8 * BITMAPS).bit_length() - 1))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = wanted.select(place.alias(spot)).distinct().withColumn(mark, F.lit(1))
    return with_marks(rows.withColumn(spot, place), marks, spot, mark).where(F.col(mark) == 1).select(rows.columns)


def parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _place(value: Column, bounds: list) -> Column:
    """Number of ``bounds`` that are not above ``value``.

    The bounds are literals in chunks: one comparison with each chunk's first
    and each of one chunk, so twice the root of their number by row.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    count = lambda values: F.size(F.filter(values, lambda b: b <= value))
    some = lambda values: F.array(*map(F.lit, values))
    chunk = count(some([c[0] for c in chunks]))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * step + count(F.element_at(F.array(*map(some, chunks)), F.greatest(chunk, F.lit(1)))))


def id_ranges(df: DataFrame, id_col: str, parts: int) -> tuple[list, object]:
    """Ids that split the rows into about equal ranges, and the smallest id.

    Each bound is an id that occurs; a range starts with its bound.
    """
    fractions = [i / parts for i in range(1, parts)] or [0.5]
    low, cuts = df.agg(F.min(id_col), F.percentile_approx(id_col, F.array(*map(F.lit, fractions)), max(10_000, 20 * parts))).first()
    bounds = sorted({x for x in cuts or [] if x != low}) if parts > 1 else []
    return bounds, low


def in_id_order(df: DataFrame, id_col: str, tie_col: str, look_ahead: bool = False, bounds: tuple[list, object] | None = None) -> tuple[DataFrame, int]:
    """``df`` in ranges of ``id_col``, each sorted by id (null last), then ``tie_col``.

    Returns the rows with a column ``_part`` (the range's number, which is the
    partition's) and ``_extra``: 0 for the row itself. With ``look_ahead`` each
    range also holds, after its own rows, the first row of the range that
    follows (``_extra`` 1; after the last range the very first row, 2). One
    shuffle moves each row once. ``bounds`` are those of :func:`id_ranges`,
    where they are known from elsewhere.
    """
    spark = df.sparkSession
    bounds, low = bounds or id_ranges(df, id_col, parts_of(spark))
    n = len(bounds) + 1
    part = F.when(F.col(id_col).isNull(), F.lit(n - 1)).otherwise(_place(F.col(id_col), bounds))
    spot = lambda p, extra: F.struct(p.cast("int").alias("_part"), F.lit(extra).alias("_extra"))
    if look_ahead and n > 1:
        first = F.coalesce(F.get(F.array(*map(F.lit, bounds)), part - 1) == F.col(id_col), F.lit(False))
        ways = F.array(spot(part, 0), F.when(first, spot(part - 1, 1)), F.when(F.col(id_col) == F.lit(low), spot(F.lit(n - 1), 2)))
        df = df.select("*", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("_spot")).select("*", "_spot.*").drop("_spot")
    else:
        df = df.withColumns({"_part": part.cast("int"), "_extra": F.lit(0)})
    dealt = df.repartitionById(n, F.col("_part"))
    return dealt.sortWithinPartitions("_extra", F.col(id_col).asc_nulls_last(), F.col(tie_col).asc_nulls_first()), n


def kept(name: str, make):
    """What ``make()`` gives, kept under ``name`` by this Python worker for later tasks."""
    import sys
    import types

    store = sys.modules.setdefault("_corpus_worker_store", types.ModuleType("_corpus_worker_store")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def column(batch: pa.RecordBatch, name: str) -> list:
    return array(batch, name).to_pylist()


def array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of text each, or one row."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        own = array(batch, text_col).nbytes
        if total and total + own > size:
            yield from _cut(held, text_col, size)
            held, total = [], 0
        held.append(batch)
        total += own
    if held:
        yield from _cut(held, text_col, size)


def _cut(held: list[pa.RecordBatch], text_col: str, size: int) -> Iterator[pa.RecordBatch]:
    batch = pa.concat_batches(held)
    if not batch.num_rows:
        return
    step = max(1, int(size / max(1, array(batch, text_col).nbytes / batch.num_rows)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
        _release()


def _release() -> None:
    """Gives freed memory back: workers share a machine's with the JVM beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
