"""Registered queries over the parquet tables, with the SQL that checks them.

The SQL is written on its own: one flat join over raw rows and a count, where
the engine multiplies summed relations in a planned order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache.policies import POLICIES
from .functions.query import Predicate, parse_query
from .operators.constraint import matches
from .session import EngineConfig, Session, tagged
from .sources import files
from .sources.schema import Graph, degree
from .sources.tables import table_graph

#: Node tables and relations of the graph in SQL.
NODES = {
    "R": "SELECT r_regionkey::BIGINT AS id, * FROM region",
    "N": "SELECT n_nationkey::BIGINT AS id, * FROM nation",
    "C": "SELECT c_custkey::BIGINT AS id, * FROM customer",
    "S": "SELECT s_suppkey::BIGINT AS id, * FROM supplier",
    "P": "SELECT p_partkey::BIGINT AS id, * FROM part",
    "O": "SELECT o_orderkey::BIGINT AS id, * FROM orders",
    "D": "SELECT doc_id AS id, * FROM documents",
    "U": "SELECT DISTINCT user_id::BIGINT AS id FROM events",
    "E": "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)",
    "K": "SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)",
    "L": "SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)",
    "G": "SELECT c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS id FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)",
}
RELATIONS = {
    "RN": "SELECT n_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM nation",
    "NC": "SELECT c_nationkey::BIGINT AS a, c_custkey::BIGINT AS b FROM customer",
    "NS": "SELECT s_nationkey::BIGINT AS a, s_suppkey::BIGINT AS b FROM supplier",
    "CO": "SELECT o_custkey::BIGINT AS a, o_orderkey::BIGINT AS b FROM orders",
    "OP": "SELECT l_orderkey::BIGINT AS a, l_partkey::BIGINT AS b FROM lineitem",
    "OS": "SELECT l_orderkey::BIGINT AS a, l_suppkey::BIGINT AS b FROM lineitem",
    "PS": "SELECT l_partkey::BIGINT AS a, l_suppkey::BIGINT AS b FROM lineitem",
    "GC": f"SELECT g.id AS a, c_custkey::BIGINT AS b FROM customer JOIN ({NODES['G']}) g ON c_mktsegment = g.segment",
    "UE": f"SELECT user_id::BIGINT AS a, e.id AS b FROM events JOIN ({NODES['E']}) e USING (event_type)",
    "KD": f"SELECT k.id AS a, doc_id AS b FROM documents JOIN ({NODES['K']}) k USING (source)",
    "DL": f"SELECT doc_id AS a, l.id AS b FROM documents JOIN ({NODES['L']}) l USING (lang)",
}


def relation_sql(pair: str) -> str:
    return RELATIONS[pair] if pair in RELATIONS else f"SELECT b AS a, a AS b FROM ({RELATIONS[pair[::-1]]})"


def path_sql(line: str, first_match_only: bool = True) -> str:
    """A query as one flat join over raw rows."""
    query = parse_query(line)
    pairs = ["".join(p) for p in query.relations]
    text = f"SELECT r0.a AS src, r{len(pairs) - 1}.b AS dst, CAST(COUNT(*) AS BIGINT) AS n FROM ({relation_sql(pairs[0])}) r0"
    for i, pair in enumerate(pairs[1:], 1):
        text += f" JOIN ({relation_sql(pair)}) r{i} ON r{i - 1}.b = r{i}.a"
    tests = []
    for place in sorted(query.positions):
        c = query.constraint
        equal = " AND ".join(f"{a}::VARCHAR = '{v}'" for a, v in c.equalities)
        ids = f"SELECT {'min(id)' if first_match_only else 'id'} FROM ({NODES[c.type]}) WHERE {equal}"
        tests.append((f"r{place}.a" if place < len(pairs) else f"r{place - 1}.b") + f" IN ({ids})")
    return text + (" WHERE " + " AND ".join(tests) if tests else "") + " GROUP BY 1, 2"


def log_sql(lines: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS query, src, dst, n FROM ({path_sql(x)})" for i, x in enumerate(lines))


#: Query lines by name: what each is about is in its name.
PATHS = {
    "mp_one_hop": 'OP\tO.id="7"',
    "mp_src_constraint": 'NCOP\tN.n_name="NATION_3"',
    "mp_dst_constraint": 'OCNS\tS.id="7"',
    "mp_mid_constraint": 'COPOC\tP.id="7"',
    "mp_weighted_dups": 'SOCOS\tC.id="11"',
    "mp_unconstrained": "NCOPS",
    "mp_constraint_absent_type": 'RNS\tP.id="7"',
    "mp_region_chain": 'RNCOP\tC.id="12"',
    "mp_segment": 'GCN\tN.n_name="NATION_5"',
    "mp_event_user": 'EUE\tE.event_type="click"',
    "mp_doc_source": "KDL",
    "mp_repeated_type": 'SPS\tS.id="3"',
    "mp_no_such_node": 'NCO\tN.n_name="NOWHERE"',
}
#: Several equalities on one type.
BOTH = 'COP\tC.c_mktsegment="BUILDING" AND C.c_nationkey="3"'
PLANNED = 'RNCOP\tC.id="11"'
#: A log in which stretches and whole queries come again.
LOG = ['NCOP\tN.id="3"', 'NCOS\tN.id="3"', 'RNCOP\tC.id="11"', 'NCOP\tN.id="3"', 'RNCOP\tC.id="11"', 'COPS\tC.id="11"', 'NCOS\tN.id="4"', 'NCOP\tN.id="3"']


#: A small graph for the replacement policies: nodes by type, and how many pairs each node has by relation.
POLICY_NODES, POLICY_PAIRS = {"A": 40, "B": 60, "C": 50, "D": 30}, {"AB": 3, "BC": 4, "CD": 2, "DA": 5}
#: A log in which stretches come again, more of them than ``POLICY_MB`` hold.
POLICY_LOG = "ABC ABC BCD BCD ABCD CDA CDA ABC DAB DAB BCDA ABCD CDAB DABC ABC BCD CDA DABC ABCDA BCD ABCB DAB CDAB ABCD".split()
POLICY_MB = 0.0125


#: By policy, for each query of the log, hits, misses and writes so far and the stretches held, next to go
#: first, as first recorded and reviewed.
EXPECTED = {
    "LRU": "0 0 0; 0 1 1 ABC; 0 1 1 ABC; 0 2 2 ABC BCD; 1 2 2 ABC BCD; 1 2 2 ABC BCD; 1 3 3 ABC BCD CDA; 2 3 3 BCD CDA ABC; 2 3 3 BCD CDA ABC; 2 4 4 CDA ABC DAB; 3 4 4 ABC DAB CDA; 4 5 5 CDA ABC ABCD; 5 5 5 ABC ABCD CDA; 6 5 5 ABCD CDA ABC; 7 5 5 ABCD CDA ABC; 7 6 6 CDA ABC BCD; 8 6 6 ABC BCD CDA; 9 7 7 ABC DABC; 10 7 7 DABC ABC; 10 8 8 ABC BCD; 11 8 8 BCD ABC; 11 9 9 BCD ABC DAB; 12 10 10 DAB CDAB; 12 11 11 BCD",
    "GDS": "0 0 0; 0 1 1 ABC; 0 1 1 ABC; 0 2 2 ABC BCD; 1 2 2 ABC BCD; 1 2 2 ABC BCD; 1 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 4 4 ABC BCD DAB; 3 4 4 ABC DAB BCD; 4 5 5 DAB ABCD BCD; 5 5 5 ABCD BCD DAB; 6 5 5 ABCD BCD DAB; 6 6 6 ABC BCD DAB; 7 6 6 ABC DAB BCD; 7 7 7 CDA DAB BCD; 8 8 8 DABC BCD; 9 9 9 ABCD BCD; 10 9 9 ABCD BCD; 10 10 10 ABC ABCD BCD; 10 11 11 DAB ABCD BCD; 11 12 12 CDAB; 11 13 13 BCD",
    "GDS2": "0 0 0; 0 1 1 ABC; 0 1 1 ABC; 0 2 2 ABC BCD; 1 2 2 ABC BCD; 1 2 2 ABC BCD; 1 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 4 4 ABC BCD DAB; 3 4 4 ABC DAB BCD; 4 5 5 DAB ABCD BCD; 5 5 5 ABCD BCD DAB; 6 5 5 ABCD BCD DAB; 6 6 5 ABCD BCD DAB; 7 6 5 ABCD BCD DAB; 7 7 5 ABCD BCD DAB; 8 8 5 ABCD BCD DAB; 9 8 5 BCD DAB ABCD; 10 8 5 BCD DAB ABCD; 10 9 5 BCD DAB ABCD; 11 9 5 BCD DAB ABCD; 12 10 5 BCD DAB ABCD; 13 10 5 BCD DAB ABCD",
    "GDS3": "0 0 0; 0 1 1 ABC; 0 1 1 ABC; 0 2 2 ABC BCD; 1 2 2 ABC BCD; 1 2 2 ABC BCD; 1 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 4 4 DAB ABC BCD; 3 4 4 DAB ABC BCD; 4 5 5 ABC ABCD BCD; 4 6 6 DAB ABCD BCD; 5 6 6 ABCD BCD DAB; 5 7 7 BCD ABC DAB; 6 7 7 ABC DAB BCD; 6 8 8 CDA DAB BCD; 7 9 9 DABC DAB; 7 10 10 BCD DAB; 8 10 10 BCD DAB; 8 11 11 ABC BCD DAB; 9 11 11 DAB ABC BCD; 10 12 12 CDAB; 10 13 13 BCD",
    "GDS4": "0 0 0; 0 1 1 ABC; 0 1 1 ABC; 0 2 2 ABC BCD; 1 2 2 ABC BCD; 1 2 2 ABC BCD; 1 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 4 4 DAB ABC BCD; 3 4 4 DAB ABC BCD; 4 5 5 ABC ABCD BCD; 4 6 6 DAB ABCD BCD; 5 6 6 ABCD BCD DAB; 5 7 7 BCD ABC DAB; 6 7 7 ABC DAB BCD; 6 8 7 ABC DAB BCD; 7 9 7 DAB BCD ABC; 8 9 7 DAB BCD ABC; 9 9 7 DAB BCD ABC; 10 9 7 DAB BCD ABC; 11 9 7 DAB BCD ABC; 12 10 7 DAB BCD ABC; 13 11 7 DAB BCD ABC",
    "PGDSU": "0 0 0; 0 1 1 ABC; 0 1 1 ABC; 0 2 2 ABC BCD; 1 2 2 ABC BCD; 1 2 2 ABC BCD; 1 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 3 3 CDA ABC BCD; 2 4 4 DAB ABC BCD; 3 4 4 DAB ABC BCD; 4 5 5 ABC ABCD BCD; 4 6 6 DAB BCD ABCD; 5 6 6 BCD DAB ABCD; 5 7 7 ABC DAB ABCD; 5 8 8 BCD DAB ABCD; 5 9 9 CDA DAB ABCD; 6 10 10 DABC; 6 11 11 DABC BCD; 7 11 11 DABC BCD; 7 12 12 ABC BCD; 7 13 13 DAB ABC BCD; 8 14 14 CDAB; 8 15 15 BCD",
}


def policy_graph(spark: SparkSession) -> Graph:
    """Node ``i`` of a relation's first type goes to ``7 i + 11 j j`` of its second, for each of its pairs ``j``."""
    graph = Graph(spark)
    for kind, n in POLICY_NODES.items():
        graph.add_nodes(kind, spark.range(n))
    for pair, n in POLICY_PAIRS.items():
        rows = [(i, (7 * i + 11 * j * j) % POLICY_NODES[pair[1]]) for i in range(POLICY_NODES[pair[0]]) for j in range(n)]
        graph.add_relation(pair[0], pair[1], spark.createDataFrame(rows, "src long, dst long"))
    return graph


def _metrics(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    """Hits, misses and writes after each query of the log, and what the cache holds then, next to go first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(policy_graph(spark), EngineConfig(engine="subpath", policy=policy, cache_mb=POLICY_MB, item_share=0.9))
        table = session.run_workload(POLICY_LOG)[1].select("number", "query", "hits", "misses", "writes", "held")
        session.close()
        return table

    return run


def _path(line: str, **config) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(table_graph(spark, sf_dir), EngineConfig(**config)).run(line)


def _log(**config) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tagged(Session(table_graph(spark, sf_dir), EngineConfig(**config)).run_workload(LOG)[0])


def scan_relation_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_graph(spark, sf_dir).relation("O", "P")


def node_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = table_graph(spark, sf_dir)
    return spark.createDataFrame([(k, graph.dimension(k)) for k in sorted(graph.nodes)], "type string, dimension long")


def relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = table_graph(spark, sf_dir)
    rows = [(pair, s.nnz, s.rows, s.cols, round(s.density, 9)) for pair in RELATIONS for s in [graph.stats(*pair)]]
    return spark.createDataFrame(rows, "relation string, nnz long, n_rows long, n_cols long, density double")


def constraint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table_graph(spark, sf_dir), parse_query('NC\tN.n_name="NATION_3"').constraint)


def predicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table_graph(spark, sf_dir), Predicate("P", F.col("p_brand").isin("Brand#1", "Brand#2")))


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as sorted text and read again, under the shared folder."""
    path = files.shared_folder(spark, "result")
    files.write_result(Session(table_graph(spark, sf_dir)).run(PATHS["mp_src_constraint"]), path)
    return files.read_result(spark, path)


def mp_column_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through the suppliers that a condition picks, which is no equality."""
    return Session(table_graph(spark, sf_dir), EngineConfig(first_match_only=False)).run("NSO", where=("S", F.col("s_acctbal") > 5000))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (scan_relation_op, node_dimension, relation_stats, constraint_ids, predicate_ids, sink_roundtrip)}
    found |= {f"degree_sketch_{x}": (lambda spark, sf_dir, end=end: degree(table_graph(spark, sf_dir).relation("P", "S"), end)) for x, end in (("row", "src"), ("col", "dst"))}
    found |= {name: _path(line) for name, line in PATHS.items()}
    found["mp_palindrome_all_matches"] = _path('SPS\tP.p_brand="Brand#1"', first_match_only=False)
    found |= {f"mp_plan_{m}": _path(PLANNED, cost_model=m) for m in ("dense", "sparse", "mnc")}
    found["mp_two_predicates"] = _path(BOTH, first_match_only=False)
    found["mp_column_predicate"] = mp_column_predicate
    found["mp_plan_exp_middle"] = _path(PLANNED, engine="result", expansion="exp", expand_from=2)
    found["mp_plan_sequential"] = _path(PLANNED, engine="seq")
    found |= {f"mp_plan_{x}": _path(PLANNED, engine="result", expansion=x) for x in ("exp", "expsparse")}
    found |= {f"wl_cache_{x}": _log(engine=x) for x in ("result", "intermediate", "subpath")}
    found |= {f"wl_{x.lower()}": _log(engine="subpath", policy=x, cache_mb=0.05) for x in POLICIES}
    found |= {f"wl_metrics_{x.lower()}": _metrics(x) for x in POLICIES}
    return found


def metrics_sql(policy: str) -> str:
    rows = []
    for number, (query, step) in enumerate(zip(POLICY_LOG, EXPECTED[policy].split("; "), strict=True)):
        hits, misses, writes, *held = step.split()
        rows.append(f"({number}, '{query}', {hits}, {misses}, {writes}, '{', '.join(held)}')")
    return f"SELECT number::INT AS number, query, hits::INT AS hits, misses::INT AS misses, writes::INT AS writes, held FROM (VALUES {', '.join(rows)}) t(number, query, hits, misses, writes, held)"


def oracle_sql() -> dict[str, str]:
    top = lambda k: f"SELECT '{k}' AS type, CAST(max(id) + 1 AS BIGINT) AS dimension FROM ({NODES[k]})"
    stats = lambda p: f"SELECT '{p}' AS relation, nnz, r AS n_rows, c AS n_cols, round(nnz / (r::DOUBLE * c), 9) AS density FROM (SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT a, b FROM ({RELATIONS[p]}))) AS nnz, (SELECT CAST(max(id) + 1 AS BIGINT) FROM ({NODES[p[0]]})) AS r, (SELECT CAST(max(id) + 1 AS BIGINT) FROM ({NODES[p[1]]})) AS c)"
    sums = lambda p: f"SELECT a AS src, b AS dst, CAST(count(*) AS BIGINT) AS n FROM ({RELATIONS[p]}) GROUP BY 1, 2"
    found = {
        "scan_relation_op": sums("OP"),
        "node_dimension": " UNION ALL ".join(map(top, sorted(NODES))),
        "relation_stats": " UNION ALL ".join(map(stats, RELATIONS)),
        "constraint_ids": f"SELECT id FROM ({NODES['N']}) WHERE n_name = 'NATION_3'",
        "predicate_ids": f"SELECT id FROM ({NODES['P']}) WHERE p_brand IN ('Brand#1', 'Brand#2')",
        "sink_roundtrip": path_sql(PATHS["mp_src_constraint"]),
        "degree_sketch_row": f"SELECT src AS idx, CAST(count(*) AS BIGINT) AS cnt FROM ({sums('PS')}) GROUP BY 1",
        "degree_sketch_col": f"SELECT dst AS idx, CAST(count(*) AS BIGINT) AS cnt FROM ({sums('PS')}) GROUP BY 1",
        "mp_palindrome_all_matches": path_sql('SPS\tP.p_brand="Brand#1"', first_match_only=False),
    }
    found |= {name: path_sql(line) for name, line in PATHS.items()}
    found |= {f"mp_plan_{x}": path_sql(PLANNED) for x in ("dense", "sparse", "mnc", "sequential", "exp", "expsparse", "exp_middle")}
    found["mp_two_predicates"] = path_sql(BOTH, first_match_only=False)
    picked = "SELECT s_suppkey::BIGINT FROM supplier WHERE s_acctbal > 5000"
    found["mp_column_predicate"] = f"SELECT r0.a AS src, r1.b AS dst, CAST(count(*) AS BIGINT) AS n FROM ({relation_sql('NS')}) r0 JOIN ({relation_sql('SO')}) r1 ON r0.b = r1.a WHERE r0.b IN ({picked}) GROUP BY 1, 2"
    found |= {f"wl_metrics_{x.lower()}": metrics_sql(x) for x in POLICIES}
    found |= {f"wl_{x}": log_sql(LOG) for x in ("cache_result", "cache_intermediate", "cache_subpath", *(p.lower() for p in POLICIES))}
    return found
