"""Packing documents into fixed training sequences: concatenate and cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array, blocks, kept, materialize
from .tokens import TextEncoder


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """First pass: each document's ids and its place among its partition's ids.

    ``ids`` holds little-endian unsigned 32-bit integers, ``n`` their number,
    ``before`` the number of ids of the partition's earlier documents.
    """
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = kept(f"{tokenizer} {special}", lambda: TextEncoder(tokenizer, special=special)), TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text"):
            ids, n = encoder.encode(array(batch, "text"), end_id)
            ends = np.cumsum(n)
            raw = ids.astype("<u4").tobytes()
            offsets = np.concatenate([[0], ends]) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(before + ends - n),
                    pa.array(n),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw)]),
                ],
                names=kind.names,
            )
            before += int(ends[-1])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Documents laid end to end and cut each ``length`` ids.

    The first pass tokenizes and writes each document's ids with the number of
    ids before it in its partition. The partitions' totals, one number each,
    are summed on the driver, so the second pass, which is row by row, knows
    each document's place in the whole and cuts it at the windows' bounds.
    Every sequence but the last is full; no id is dropped or repeated, and the
    text is moved once only, by no shuffle.

    Returns a row for each piece: ``id_col``, ``start`` (the document's ids
    before it), ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and
    ``ids`` (binary, little-endian unsigned 32-bit). A null text is an empty
    one, and an empty one is its end id alone; a null id stays null; repeated
    rows are packed as often as they come; no rows give no rows; columns
    other than the two named are not read.
    """
    spark = docs.sparkSession
    done = materialize(tokenized(docs, tokenizer, end_id, id_col, text_col, special), "packing", batch=500)
    totals = dict(done.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = [], 0
    for part in sorted(totals):
        base.append((part, at))
        at += totals[part]
    # One row for each partition of the first pass, so bounded by the number of tasks.
    bases = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in base], pa.int32()), "base": pa.array([b for _, b in base], pa.int64())}))
    place = done.join(bases, "part").withColumn("at", F.col("base") + F.col("before"))
    first, last = F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}")
    pieces = place.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * length - F.col("at"))
    end = F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at"))
    pieces = pieces.withColumns({"start": start, "length": end - start})
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
    )
