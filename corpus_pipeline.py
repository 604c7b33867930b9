"""A training-data pipeline: quality, near-duplicates, mixture, packing.

Each stage takes what its predecessor kept, decides over all of it, and
returns the rows that stay with the columns of ``documents``; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import mixing, near_dedup, packing, quality
from pathloom.llm.common import materialize, with_marks
from pathloom.llm.queries import END_ID, table, tokenizer_path

#: Similarity in percent from which documents are near-duplicates.
NEAR = 80


def _numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows with a number each, written so that every pass sees the same ones, and the new column's name."""
    row = next(x for x in (f"_row{i}" for i in range(10 * len(docs.columns) + 1)) if not any(c.lower().startswith(x) for c in docs.columns))
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), label), row


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what importance resampling towards good labelled documents rejects.

    Each row is judged by its own id and text, so rows that share an id may
    part and repeated rows share their fate; ties at the limit stay. Null and
    empty texts score 0, long ones are read whole. Rows with null ids are
    judged too, and their labels count nowhere. No rows give no rows.
    """
    chosen = quality.resample(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return chosen.where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, of its smallest id.

    Of repeated rows one stays; of rows that share an id, which links them,
    one stays. Rows with null ids, and those with null or empty texts, belong
    to no group and stay all; long texts are read whole. No rows give no rows.
    """
    numbered, row = _numbered(docs, "dedup-documents")
    groups = near_dedup.near_duplicates(numbered, percent=NEAR, row_col=row)
    gone = f"{row}_gone"
    return with_marks(numbered, groups.where(~F.col("kept")).select(row, F.lit(1).alias(gone)), row, gone).where(F.col(gone) == 0).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each row as often as the sources' target weights take it.

    Null sources are one source, the last. Null texts and those without words
    have size 0 and are never taken; long ones count as they are. Repeated
    rows, rows that share an id and rows with null ids count each; ties go by
    the row's place. No rows give no rows.
    """
    numbered, row = _numbered(docs, "mix-documents")
    copies = f"{row}_copies"
    taken = mixing.mix(numbered, row_col=row).select(F.col("row").alias(row), F.col("copies").alias(copies))
    taken = with_marks(numbered, taken, row, copies, bits=2).where(F.col(copies) > 0)  # 0 to 3 copies
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(f"{row}_copy")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, as pieces with their ids.

    A null or empty text is its end id alone; long ones are cut over many
    sequences. Null ids stay null; repeated rows are packed each. No rows give
    no pieces.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 4096, END_ID, special=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", select_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, models and knapsacks are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
