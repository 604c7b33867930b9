"""Runs a log of queries over a folder of files: ``python -m pathloom -qf log.tsv -indir nodes -idir relations``."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .cache.policies import POLICIES
from .functions.query import MetapathQuery, read_workload
from .session import COST_MODELS, ENGINES, EXPANSIONS, EngineConfig, Session
from .sources.files import read_nodes, read_relation, write_result
from .sources.schema import Graph


def parser() -> argparse.ArgumentParser:
    default = EngineConfig()
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    p.add_argument("-qf", required=True, help="file with a query in each line")
    p.add_argument("-indir", required=True, help="folder of node files, <type>.csv")
    p.add_argument("-idir", required=True, help="folder of relation files, <pair>.crs")
    p.add_argument("-out", help="folder for results, one for each query")
    p.add_argument("-algo", choices=ENGINES, default=default.engine)
    p.add_argument("-exp", choices=EXPANSIONS, default=default.expansion)
    p.add_argument("-dopt", choices=COST_MODELS, default=default.cost_model)
    p.add_argument("-l", type=int, default=default.min_len, help="letters of a stretch worth keeping")
    p.add_argument("-s", type=int, default=default.min_support, help="times it must have come")
    p.add_argument("-cache", type=float, default=default.cache_mb, help="megabytes")
    p.add_argument("-cachep", choices=tuple(POLICIES), default=default.policy)
    p.add_argument("-all", action="store_true", help="a constraint picks all nodes that meet it, not the first alone")
    return p


def graph_for(spark: SparkSession, queries: list[MetapathQuery], nodes: str, relations: str) -> Graph:
    """The files that the queries need; a missing relation file may stand the other way round."""
    graph = Graph(spark, keep=True)
    for kind in sorted({x for q in queries for x in q.path}):
        graph.add_nodes(kind, read_nodes(spark, f"{nodes.rstrip('/')}/{kind}.csv"))
    for src, dst in sorted({r for q in queries for r in q.relations}):
        try:
            graph.add_relation(src, dst, read_relation(spark, f"{relations.rstrip('/')}/{src}{dst}.crs"))
        except AnalysisException:
            graph.add_relation(dst, src, read_relation(spark, f"{relations.rstrip('/')}/{dst}{src}.crs"))
    return graph


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
    queries = read_workload(a.qf)
    config = EngineConfig(engine=a.algo, expansion=a.exp, cost_model=a.dopt, policy=a.cachep, cache_mb=a.cache, min_len=a.l, min_support=a.s, first_match_only=not a.all)
    session = Session(graph_for(spark, queries, a.indir, a.idir), config)
    results, metrics = session.run_workload(queries)
    for row in metrics.orderBy("number").collect():
        print(row.query, row.rows, f"{row.seconds:.3f}", sep="\t")
    if a.out:
        for number, df in enumerate(results):
            write_result(df, f"{a.out.rstrip('/')}/{number:06d}_{''.join(queries[number].path)}_{a.algo}")
    print(f"hits {session.hits}, misses {session.misses}, writes {session.writes}", file=sys.stderr)
    session.close()


if __name__ == "__main__":
    main()
