"""Graphs in folders of tab-separated files, and results written as such."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import Graph

_RELATION = T.StructType([T.StructField(x, T.StringType()) for x in ("src", "dst", "n")])


def _id(name: str, strict: bool):
    return F.col(name).cast("long") if strict else F.col(name).try_cast("long")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A node file with a header; all columns are strings, so ``007`` is not ``7``."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def read_relation(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``src``, ``dst`` and an optional weight in each line, without a header.

    Malformed numbers are errors; with ``strict=False`` such lines are left out.
    """
    rows = spark.read.schema(_RELATION).csv(path, sep="\t")
    out = rows.select(_id("src", strict).alias("src"), _id("dst", strict).alias("dst"), F.coalesce(_id("n", strict), F.lit(1)).alias("n"))
    return out.where("src is not null and dst is not null")


def read_graph(spark: SparkSession, nodes: str, relations: str, types: list[str], pairs: list[tuple[str, str]], strict: bool = True, keep: bool = False) -> Graph:
    """A graph from ``<nodes>/<type>.csv`` and ``<relations>/<pair>.crs``."""
    graph = Graph(spark, strict, keep)
    for kind in types:
        graph.add_nodes(kind, read_nodes(spark, f"{nodes.rstrip('/')}/{kind}.csv"))
    for src, dst in pairs:
        graph.add_relation(src, dst, read_relation(spark, f"{relations.rstrip('/')}/{src}{dst}.crs", strict))
    return graph


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which goes with the driver; a temporary one on one machine without that."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="results-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def write_result(df: DataFrame, path: str) -> None:
    """``src``, ``dst``, ``n`` without a header, sorted by both ids over all files."""
    df.select("src", "dst", "n").orderBy("src", "dst").write.mode("overwrite").csv(path, sep="\t")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src long, dst long, n long").csv(path, sep="\t")
