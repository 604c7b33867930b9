"""A hand-checked graph, every engine against plain matrices, and files."""

import random
from collections import Counter
from itertools import product as pairs

import pytest
from pyspark.sql import functions as F

from pathloom.cache.policies import POLICIES
from pathloom.functions.query import parse_query, read_workload
from pathloom.operators.constraint import matches
from pathloom.plans.cost import sketch_cost
from pathloom.session import EngineConfig, Session
from pathloom.sources.files import read_graph, read_result, write_result
from pathloom.sources.schema import Graph

AP = [(0, 0), (0, 1), (0, 1), (1, 1), (1, 2), (2, 3)]
PV = [(0, 0), (1, 0), (2, 1), (3, 1)]
PP = [(0, 1), (1, 2), (2, 0), (3, 3)]
#: Query, whether a constraint picks its first node only, and the rows.
CASES = [
    ("APA", True, {(0, 0, 5), (0, 1, 2), (1, 0, 2), (1, 1, 2), (2, 2, 1)}),
    ("APV", True, {(0, 0, 3), (1, 0, 1), (1, 1, 1), (2, 1, 1)}),
    ('APV\tA.id="0"', True, {(0, 0, 3)}),
    ('APV\tP.id="1"', True, {(0, 0, 2), (1, 0, 1)}),
    ('APV\tV.id="1"', True, {(1, 1, 1), (2, 1, 1)}),
    ('APVPA\tV.id="0"', True, {(0, 0, 9), (0, 1, 3), (1, 0, 3), (1, 1, 1)}),
    ('APA\tP.year="2001"', True, {(0, 0, 1)}),
    ('APA\tP.year="2001"', False, {(0, 0, 1), (1, 1, 1)}),
    ('APAPA\tA.id="0"', True, {(0, 0, 29), (0, 1, 14)}),
    ('PP\tP.id="3"', True, {(3, 3, 1)}),
    ('PP\tP.id="0"', True, set()),
    ('APV\tP.id="9"', True, set()),
    ("AP", True, {(0, 0, 1), (0, 1, 2), (1, 1, 1), (1, 2, 1), (2, 3, 1)}),
    ('APV\tX.id="9"', True, {(0, 0, 3), (1, 0, 1), (1, 1, 1), (2, 1, 1)}),
]
ENGINES = [{"engine": "seq"}, {"engine": "dynp", "cost_model": "dense"}, {"engine": "dynp"}, {"engine": "dynp", "cost_model": "mnc"}, {"engine": "intermediate"}, *({"engine": "result", "expansion": x} for x in ("exp", "expsparse"))]


def graph_of(spark, relations, nodes, **settings):
    graph = Graph(spark, **settings)
    for kind, n in nodes.items():
        rows = [(i, {0: "2001", 1: "2002", 2: "2001", 3: "2003"}.get(i)) for i in range(n)]
        graph.add_nodes(kind, spark.createDataFrame(rows, "id long, year string"))
    for pair, rows in relations.items():
        graph.add_relation(pair[0], pair[1], spark.createDataFrame([(*r, 1)[:3] for r in rows], "src long, dst long, n long"))
    return graph


@pytest.fixture(scope="module")
def tiny(spark):
    return graph_of(spark, {"AP": AP, "PV": PV, "PP": PP}, {"A": 3, "P": 4, "V": 2}, keep=True)


def rows_of(df):
    rows = [tuple(r) for r in df.select("src", "dst", "n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("line, first, expected", CASES)
def test_hand_checked(tiny, line, first, expected):
    assert rows_of(Session(tiny, EngineConfig(first_match_only=first)).run(line)) == expected


@pytest.mark.parametrize("settings", [*ENGINES, *({"engine": "subpath", "policy": p, "cache_mb": 0.0002} for p in ("LRU", "PGDSU"))])
def test_engines_agree_over_a_log(tiny, settings):
    session = Session(tiny, EngineConfig(**settings))
    for line, first, expected in [c for c in CASES if c[1]] + [CASES[i] for i in (5, 8, 0, 3)]:
        assert rows_of(session.run(line)) == expected, line
    session.close()


def brute(relations, query):
    """Counts walks one by one."""
    def edges(a, b):
        if a + b in relations:
            return [(*r, 1)[:3] for r in relations[a + b]]
        return [(d, s, n) for s, d, n in ((*r, 1)[:3] for r in relations[b + a])]

    found = None
    bound = {p: int(query.constraint.value) for p in query.positions}
    for at, (a, b) in enumerate(query.relations):
        step = [(s, d, n) for s, d, n in edges(a, b) if bound.get(at, s) == s and bound.get(at + 1, d) == d]
        if found is None:
            found = Counter()
            for s, d, n in step:
                found[s, d] += n
            continue
        new = Counter()
        for ((s, m), n), (x, d, k) in pairs(found.items(), step):
            if m == x:
                new[s, d] += n * k
        found = new
    return {(s, d, n) for (s, d), n in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    relations = {p: [(rng.randrange(6), rng.randrange(6), rng.choice((0, 1, 1, 2))) for _ in range(rng.choice((0, 5, 12)))] for p in ("AB", "BC", "BB")}
    graph = graph_of(spark, relations, {"A": 6, "B": 6, "C": 6}, keep=True)
    settings = [{"engine": "subpath", "policy": rng.choice(list(POLICIES)), "cache_mb": rng.choice((0.0002, 1)), "expansion": rng.choice(("seq", "dynp", "exp", "expsparse"))}, {"engine": "intermediate"}, {"engine": "dynp", "cost_model": "mnc"}]
    sessions = [Session(graph, EngineConfig(**s)) for s in settings]
    step = {"A": "B", "B": "ABC", "C": "B"}
    log = []
    for _ in range(4):
        path = rng.choice("ABC")
        while len(path) < rng.randint(3, 6):
            path += rng.choice(step[path[-1]])
        log.append(f'{path}\t{rng.choice(path)}.id="{rng.randrange(6)}"' if rng.random() < 0.7 else path)
    for line in log + log[:2]:
        expected = brute(relations, parse_query(line))
        for session in sessions:
            assert rows_of(session.run(line)) == expected, (line, session.config)


def test_zero_weight_stays(spark):
    graph = graph_of(spark, {"AP": [*((s, d, 1) for s, d in AP), (2, 0, 0)]}, {"A": 3, "P": 4})
    assert (2, 0, 0) in rows_of(Session(graph).run("AP"))


def test_missing_parts(spark, tiny):
    with pytest.raises(KeyError):
        Session(tiny).run("AV")
    loose = Graph(spark, strict=False)
    assert rows_of(Session(loose).run("APC")) == set()
    with pytest.raises(ValueError, match="attribute"):
        Session(tiny).run('APV\tP.colour="red"')


def test_conditions(spark):
    graph = Graph(spark)
    graph.add_nodes("A", spark.createDataFrame([(0, "x", 1), (1, "x", 2), (2, "y", 2)], "id long, name string, age int")).add_nodes("P", spark.range(4))
    graph.add_relation("A", "P", spark.createDataFrame(AP, "src long, dst long"))
    every = EngineConfig(first_match_only=False)
    both = parse_query('AP\tA.name="x" AND A.age="2"')
    assert both.constraint.equalities == (("name", "x"), ("age", "2")) and parse_query(str(both)) == both
    assert rows_of(Session(graph, every).run(both)) == {(1, 1, 1), (1, 2, 1)}
    assert rows_of(Session(graph, every).run("AP", where=("A", F.col("age") > 1))) == {(1, 1, 1), (1, 2, 1), (2, 3, 1)}
    assert rows_of(Session(graph).run("AP", where=("A", F.col("age") > 1))) == {(1, 1, 1), (1, 2, 1)}
    for line, where in (('AP\tA.id="1"', ("A", F.lit(True))), ('AP\tA.id="1" AND P.id="2"', None)):
        with pytest.raises(ValueError):
            Session(graph).run(line, where)
    session = Session(graph, EngineConfig(engine="result", first_match_only=False))
    for low, hits in ((0, 0), (1, 0), (0, 1)):
        session.run("APA", where=("A", F.col("age") > low)).collect()
        assert session.hits == hits


def test_sketches_in_stretches(spark, monkeypatch):
    from pathloom.sources import schema

    rng = random.Random(1)
    pairs_of = {"AB": [(rng.randrange(90), rng.randrange(70)) for _ in range(300)], "BC": [(rng.randrange(70), rng.randrange(50)) for _ in range(200)]}
    exact = sum(n * m for (a, b), n in Counter(pairs_of["AB"]).items() for (x, c), m in Counter(pairs_of["BC"]).items() if b == x)
    for most, slack in ((1 << 16, 1e-9), (20, 0.2)):
        monkeypatch.setattr(schema, "STRETCHES", most)
        graph = Graph(spark)
        for kind, n in (("A", 90), ("B", 70), ("C", 50)):
            graph.add_nodes(kind, spark.range(n))
        for pair, rows in pairs_of.items():
            graph.add_relation(*pair, spark.createDataFrame(rows, "src long, dst long"), "few")
        first, second = graph.sketches([("A", "B", None), ("B", "C", None)])
        assert len(first.rows) <= most and first.rows.sum() == 300 and second.cols.sum() == 200 and len(first.cols) == len(second.rows)
        assert sketch_cost(first, second) == pytest.approx(exact, rel=slack)
        part = graph.sketches([("A", "B", graph.rows("A", "B").where("src = 5")), ("B", "A", None)])
        assert part[0].rows.sum() == sum(a == 5 for a, _ in pairs_of["AB"]) and part[1].rows.sum() == 300


@pytest.mark.parametrize("policy", list(POLICIES))
def test_policy_log(spark, policy):
    from pathloom import catalogue

    rows = catalogue.queries()[f"wl_metrics_{policy.lower()}"](spark, "").orderBy("number").collect()
    assert "; ".join(f"{r.hits} {r.misses} {r.writes} {r.held.replace(',', '')}".strip() for r in rows) == catalogue.EXPECTED[policy]
    assert len(set(catalogue.EXPECTED.values())) == len(POLICIES)


def test_null_attributes_never_match(tiny):
    assert matches(tiny, parse_query('APV\tP.year="None"').constraint).count() == 0


def test_overflow_is_an_error(spark):
    graph = graph_of(spark, {"AB": [(0, 0, 2**40)], "BC": [(0, 0, 2**40)]}, {"A": 1, "B": 1, "C": 1})
    with pytest.raises(Exception, match="OVERFLOW"):
        Session(graph).run("ABC").collect()


def test_files(spark, tmp_path):
    nodes, rels = tmp_path / "n", tmp_path / "r"
    nodes.mkdir(), rels.mkdir()
    (nodes / "A.csv").write_text("id\tname\n0\t007\n1\t7\n2\tx\n")
    (nodes / "P.csv").write_text("id\tyear\n0\t1\n1\t2\n2\t1\n3\t2\n")
    (rels / "AP.crs").write_text("".join(f"{s}\t{d}\n" for s, d in AP) + "2\t0\t3\n")
    graph = read_graph(spark, str(nodes), str(rels), ["A", "P"], [("A", "P")])
    assert (2, 0, 3) in rows_of(Session(graph).run("AP"))
    assert rows_of(Session(graph).run('AP\tA.name="7"')) == {(1, 1, 1), (1, 2, 1)}
    out = Session(graph).run("APA")
    write_result(out, str(tmp_path / "out"))
    assert rows_of(read_result(spark, str(tmp_path / "out"))) == rows_of(out)
    (rels / "AP.crs").write_text("0\t1\nx\t2\n")
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        read_graph(spark, str(nodes), str(rels), ["A", "P"], [("A", "P")]).relation("A", "P").collect()
    loose = read_graph(spark, str(nodes), str(rels), ["A", "P"], [("A", "P")], strict=False)
    assert rows_of(loose.relation("A", "P")) == {(0, 1, 1)}


def test_parser(tmp_path):
    q = parse_query('OAPCP\tO.id="7922"\n')
    assert q.path == tuple("OAPCP") and str(q.constraint) == 'O.id="7922"' and q.positions == {0}
    assert parse_query('AP\tA.name="x=y.z"').constraint.value == "x=y.z"
    assert parse_query("author-paper").path == ("author", "paper")
    assert parse_query('APP\tP.id="1"').positions == {1} and parse_query('PPA\tP.id="1"').positions == {0, 1}
    for bad in ("A", "AP\tnothing"):
        with pytest.raises(ValueError):
            parse_query(bad)
    (tmp_path / "log").write_text('AP\n\nPA\tA.id="1"\n')
    assert len(read_workload(tmp_path / "log")) == 2


def test_metrics(tiny):
    session = Session(tiny, EngineConfig(engine="result"))
    results, table = session.run_workload(["APA", "APV", "APA"])
    rows = table.orderBy("number").collect()
    assert [r.hits for r in rows] == [0, 0, 1] and [r.rows for r in rows] == [5, 4, 5] and len(results) == 3
    with pytest.raises(ValueError):
        EngineConfig(engine="none")


def test_command_line(spark, tmp_path, capsys):
    from pathloom.__main__ import main

    for kind, n in (("A", 3), ("P", 4)):
        (tmp_path / f"{kind}.csv").write_text("id\n" + "".join(f"{i}\n" for i in range(n)))
    (tmp_path / "AP.crs").write_text("".join(f"{s}\t{d}\n" for s, d in AP))
    (tmp_path / "log").write_text('APA\nAPA\tA.id="0"\nAPA\n')
    main(["-qf", str(tmp_path / "log"), "-indir", str(tmp_path), "-idir", str(tmp_path), "-algo", "result", "-out", str(tmp_path / "out")], spark)
    said = capsys.readouterr()
    assert [x.split("\t")[0] for x in said.out.splitlines()] == ["APA"] * 3 and "hits 1, misses 2" in said.err
    assert rows_of(read_result(spark, str(tmp_path / "out/000000_APA_result"))) == CASES[0][2]
    with pytest.raises(SystemExit):
        main(["-qf", "x", "-cachep", "FIFO"], spark)


@pytest.mark.parametrize("repeats", ["many", "few"])
def test_repeated_pairs_multiply_out(spark, repeats):
    graph = Graph(spark)
    for kind, n in (("A", 3), ("P", 4)):
        graph.add_nodes(kind, spark.range(n))
    graph.add_relation("A", "P", spark.createDataFrame(AP, "src long, dst long"), repeats)
    for line in ("APA", "AP", 'APA\tA.id="0"', "PAP"):
        expected = brute({"AP": AP}, parse_query(line))
        assert rows_of(Session(graph).run(line)) == expected
    assert graph.stats("A", "P").nnz == 5
    with pytest.raises(ValueError):
        graph.add_relation("A", "P", spark.range(1), "some")


def test_constraint_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(AP, "src int, dst int").write.parquet(str(tmp_path / "ap"))
    graph = Graph(spark)
    for kind, n in (("A", 3), ("P", 4)):
        graph.add_nodes(kind, spark.range(n))
    graph.add_relation("A", "P", spark.read.parquet(str(tmp_path / "ap")), "few")
    plan = Session(graph).run('APA\tA.id="1"')._jdf.queryExecution().toString()
    assert "EqualTo(src,1)" in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning(src") <= 1
