"""The graph over the parquet tables that the queries and the benchmark use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import Graph


def _pairs(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def _values(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of a column as nodes, numbered in order; there are few of them."""
    return df.select(F.col(col).alias(name)).where(F.col(col).isNotNull()).distinct().withColumn("id", (F.row_number().over(Window.orderBy(name)) - 1).cast("long"))


def table_graph(spark: SparkSession, sf_dir: str, keep: bool = False) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users, event types,
    documents, their sources and languages, and market segments.

    A table is opened when a query needs it.
    """
    graph = Graph(spark, keep=keep)
    opened: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    for kind, name, key in (("R", "region", "r_regionkey"), ("N", "nation", "n_nationkey"), ("C", "customer", "c_custkey"), ("S", "supplier", "s_suppkey"), ("P", "part", "p_partkey"), ("O", "orders", "o_orderkey"), ("D", "documents", "doc_id")):
        graph.add_nodes(kind, lambda name=name, key=key: t(name).withColumn("id", F.col(key).cast("long")))
    graph.add_nodes("U", lambda: t("events").select(F.col("user_id").cast("long").alias("id")).distinct())
    codes = {"G": ("customer", "c_mktsegment", "segment"), "E": ("events", "event_type", "event_type"), "K": ("documents", "source", "source"), "L": ("documents", "lang", "lang")}
    for kind, (name, col, own) in codes.items():
        graph.add_nodes(kind, lambda name=name, col=col, own=own: _values(t(name), col, own))
    for pair, name, src, dst, repeats in (("RN", "nation", "n_regionkey", "n_nationkey", "none"), ("NC", "customer", "c_nationkey", "c_custkey", "none"), ("NS", "supplier", "s_nationkey", "s_suppkey", "none"), ("CO", "orders", "o_custkey", "o_orderkey", "none"), ("OP", "lineitem", "l_orderkey", "l_partkey", "few"), ("OS", "lineitem", "l_orderkey", "l_suppkey", "few"), ("PS", "lineitem", "l_partkey", "l_suppkey", "few")):
        graph.add_relation(pair[0], pair[1], lambda name=name, src=src, dst=dst: _pairs(t(name), src, dst), repeats)
    for pair, key, repeats in (("GC", "c_custkey", "none"), ("UE", "user_id", "many"), ("KD", "doc_id", "none"), ("DL", "doc_id", "none")):
        kind = next(x for x in pair if x in codes)
        ends = ("code", key) if pair[0] == kind else (key, "code")
        graph.add_relation(pair[0], pair[1], lambda kind=kind, ends=ends: _pairs(_coded(t(codes[kind][0]), graph.node_table(kind), *codes[kind][1:]), *ends), repeats)
    return graph


def _coded(df: DataFrame, codes: DataFrame, col: str, name: str) -> DataFrame:
    """Rows with the number of a column's value as ``code``."""
    return df.join(codes.select(F.col("id").alias("code"), F.col(name).alias("_value")), F.col(col) == F.col("_value"))
