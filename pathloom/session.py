"""Running queries and logs of them, with what is kept between queries."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache.policies import POLICIES, Item, SpanKey
from .functions.query import MetapathQuery, Predicate, parse_query, read_workload
from .operators.algebra import evaluate, product
from .operators.constraint import bind, resolve
from .plans import planner as P
from .sources.schema import Graph

ENGINES = ("seq", "dynp", "result", "intermediate", "subpath")
EXPANSIONS = ("seq", "dynp", "exp", "expsparse")
COST_MODELS = ("dense", "sparse", "mnc")


@dataclass
class EngineConfig:
    """All settings of a session."""

    engine: str = "dynp"
    expansion: str = "dynp"  # how caching engines finish a chain
    expand_from: int = 0  # where "exp" begins without a cached stretch
    cost_model: str = "sparse"
    policy: str = "PGDSU"  # for the subpath engine; the other two keep by LRU
    cache_mb: float = 512.0
    item_share: float = 0.8
    min_len: int = 3  # letters of a stretch worth keeping
    min_support: int = 2  # how often it must have come
    first_match_only: bool = True  # a constraint picks its smallest id alone
    measured_cost: bool = False  # seconds instead of planned cost
    readmit: bool = True  # a stretch that had to go may come again

    def __post_init__(self):
        for value, allowed in ((self.engine, ENGINES), (self.expansion, EXPANSIONS), (self.cost_model, COST_MODELS), (self.policy, tuple(POLICIES))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {', '.join(allowed)}")


@dataclass
class Bound:
    """A query over the graph: lazy relations, their planning sizes, keys of stretches."""

    query: MetapathQuery
    factors: list[DataFrame]
    sizes: list[P.Factor]
    by: object

    def key(self, i: int, j: int) -> SpanKey:
        places = frozenset(p - i for p in self.query.positions if i <= p <= j + 1)
        return SpanKey(self.query.path[i : j + 2], places, self.by if places else None)

    def spans(self) -> list[tuple[int, int]]:
        n = len(self.factors)
        return [(i, j) for i in range(n) for j in range(i + 1, n)]


@dataclass
class Session:
    """Answers queries over a graph by one of the engines.

    Every engine returns the rows of the uncached one. State between queries:
    counts of stretches, computed stretches or results, the policy.
    """

    graph: Graph
    config: EngineConfig = field(default_factory=EngineConfig)

    def __post_init__(self):
        kind = self.config.policy if self.config.engine == "subpath" else "LRU"
        self.policy = POLICIES[kind](self.config.cache_mb, self.config.item_share)
        self.seen: Counter[SpanKey] = Counter()
        self.items: dict[object, Item] = {}
        self.loose: list[DataFrame] = []
        self.hits = self.misses = self.writes = 0

    # -- binding and planning

    def bind(self, query: MetapathQuery) -> Bound:
        picked = resolve(self.graph, query, self.config.first_match_only)
        factors, sizes, parts = bind(self.graph, query, picked), [], []
        # Two relations have one order; only what is kept needs their sizes then.
        plans = self.config.engine != "seq" and (self.config.engine != "dynp" or len(factors) > 2)
        known = self.graph.sizes(query.relations) if plans else [None] * len(factors)
        for at, ((src, dst), stats) in enumerate(zip(query.relations, known, strict=True)):
            nnz = float(stats.nnz) if stats else 0.0
            ends = [place in query.positions for place in (at, at + 1)]
            for on, size in zip(ends, (stats.rows, stats.cols) if stats else (), strict=False):
                if on and size:
                    nnz *= picked.count / size
            sizes.append(P.Factor(stats.rows if stats else 0, stats.cols if stats else 0, nnz))
            parts.append((src, dst, factors[at] if any(ends) else None))
        if plans and self.config.cost_model == "mnc":
            for factor, sketch in zip(sizes, self.graph.sketches(parts), strict=True):
                factor.sketch = sketch
        by = (query.constraint, self.config.first_match_only) if query.positions else None
        return Bound(query, factors, sizes, by)

    def plan(self, sizes: list[P.Factor]) -> tuple[P.Plan, float]:
        if len(sizes) == 1:
            return 0, 0.0
        return {"dense": P.dense, "sparse": P.sparse, "mnc": P.mnc}[self.config.cost_model](sizes)

    def _finish(self, factors: list[DataFrame], sizes: list[P.Factor], at: int | None = None) -> DataFrame:
        """The chain in the order that the expansion setting says; ``at`` is the place of a cached stretch."""
        n = len(factors)
        at = min(self.config.expand_from, n - 1) if at is None else at
        plan = {"seq": lambda: P.sequential(n), "dynp": lambda: self.plan(sizes)[0], "exp": lambda: P.expand(n, at), "expsparse": lambda: P.expand_sparse([f.density for f in sizes])}[self.config.expansion]()
        return evaluate(plan, factors)

    # -- engines

    def run(self, query: MetapathQuery | str, where: tuple[str, Column] | None = None) -> DataFrame:
        """``src``, ``dst`` and ``n``: ends of paths and their number.

        ``where`` is a type and a condition on its nodes, in place of the
        query's constraint.
        """
        query = parse_query(query) if isinstance(query, str) else query
        if where is not None:
            if query.constraint is not None:
                raise ValueError("a query has a constraint or a condition, not both")
            query = MetapathQuery(query.path, Predicate(*where))
        if self.config.engine == "result" and (item := self._held(query)):
            self.hits += 1
            self.policy.refer(item)
            return item.value
        bound = self.bind(query)
        out = getattr(self, f"_run_{self.config.engine}")(bound)
        return out if out.columns == ["src", "dst", "n"] else out.select("src", "dst", "n")

    def _run_seq(self, b: Bound) -> DataFrame:
        return evaluate(P.sequential(len(b.factors)), b.factors)

    def _run_dynp(self, b: Bound) -> DataFrame:
        return evaluate(self.plan(b.sizes)[0], b.factors)

    def _held(self, key: object) -> Item | None:
        item = self.items.get(key)
        return item if item is not None and item.valid else None

    def _keep(self, key: object, df: DataFrame, factor: P.Factor, cost: float, freq: int = 1) -> tuple[DataFrame, Item, bool]:
        """Computes a stretch, takes its size, and offers it to the policy."""
        began = time.perf_counter()
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        nnz = df.count()
        if self.config.measured_cost:
            cost = time.perf_counter() - began
        factor.nnz = float(nnz)
        item = Item(key, P.memory_mb(nnz, factor.cols), cost, freq, factor.density, df, df.unpersist)
        self.items[key] = item
        kept = self.policy.refer(item)
        self.writes += kept
        if not kept:  # used for this query, then freed with the session
            item.valid, item.value = False, None
            self.loose.append(df)
        return df, item, kept

    def _run_result(self, b: Bound) -> DataFrame:
        self.misses += 1
        _, cost = self.plan(b.sizes)
        whole = P.Factor(b.sizes[0].rows, b.sizes[-1].cols, 0.0)
        return self._keep(b.query, self._finish(b.factors, b.sizes), whole, cost)[0]

    def _run_intermediate(self, b: Bound) -> DataFrame:
        plan, _ = self.plan(b.sizes)
        found = [s for s in P.spans(plan) if self._held(b.key(*s))]
        use = max(found, key=lambda s: s[1] - s[0], default=None)
        if use:
            self.hits += 1
            self.policy.refer(self.items[b.key(*use)])
            factors, sizes, places, _ = self._splice(b, use)
            plan = self.plan(sizes)[0]
        else:
            self.misses += 1
            factors, sizes, places = b.factors, b.sizes, [(i, i) for i in range(len(b.factors))]

        def walk(p: P.Plan) -> tuple[DataFrame, tuple[int, int]]:
            if isinstance(p, int):
                return factors[p], places[p]
            (left, (i, _)), (right, (_, j)) = walk(p[0]), walk(p[1])
            out = product(left, right)
            if not self._held(b.key(i, j)):
                out = self._keep(b.key(i, j), out, P.Factor(b.sizes[i].rows, b.sizes[j].cols, 0.0), 0.0)[0]
            return out, (i, j)

        return walk(plan)[0]

    def _run_subpath(self, b: Bound) -> DataFrame:
        cfg = self.config
        for s in b.spans():
            self.seen[b.key(*s)] += 1
        if len(b.factors) == 1:
            return b.factors[0]
        worth = [s for s in b.spans() if s[1] - s[0] + 2 >= cfg.min_len and self.seen[b.key(*s)] >= cfg.min_support]
        known = {s: (self.items[b.key(*s)].density, self.items[b.key(*s)].valid) for s in worth if b.key(*s) in self.items}
        plain, with_known = P.sparse(b.sizes), P.sparse(b.sizes, known)
        steps = P.spans(with_known[0] if with_known[1] < plain[1] else plain[0])
        weight = lambda s: (s[1] - s[0], self.seen[b.key(*s)])
        use = max((s for s in worth if s in steps and self._held(b.key(*s))), key=weight, default=None)
        if use:
            self.hits += 1
            self.policy.refer(self.items[b.key(*use)])
        longer = [s for s in worth if s in steps and not self._held(b.key(*s)) and (cfg.readmit or s not in known) and (use is None or s[1] - s[0] > use[1] - use[0])]
        new = max(longer, key=lambda s: weight(s)[::-1], default=None)
        if new is None:
            if use is None:
                return evaluate(self.plan(b.sizes)[0], b.factors)
            factors, sizes, _, at = self._splice(b, use)
            return self._finish(factors, sizes, at)
        self.misses += 1
        i, j = new
        part = Bound(MetapathQuery(b.query.path[i : j + 2]), b.factors[i : j + 1], b.sizes[i : j + 1], b.by)
        inside = use is not None and i <= use[0] and use[1] <= j
        if inside:
            factors, sizes, _, at = self._splice(b, use, i, j)
        else:
            factors, sizes, at = part.factors, part.sizes, 0
        size = P.Factor(b.sizes[i].rows, b.sizes[j].cols, 0.0)
        cost = self.plan(part.sizes)[1]
        df = self._keep(b.key(*new), self._finish(factors, sizes, at), size, cost, self.seen[b.key(*new)])[0]
        factors, sizes, _, at = self._splice(b, new, value=(df, size))
        return self._finish(factors, sizes, at)

    def _splice(self, b: Bound, use: tuple[int, int], low: int = 0, high: int | None = None, value: tuple[DataFrame, P.Factor] | None = None) -> tuple[list[DataFrame], list[P.Factor], list[tuple[int, int]], int]:
        """Factors from ``low`` to ``high`` with each stretch that equals ``use`` as one.

        Stretches may share an end node. Also returns what each new factor
        covers, and the place of the first such stretch.
        """
        key, size = b.key(*use), use[1] - use[0] + 1
        high = len(b.factors) - 1 if high is None else high
        if value is None:
            item = self.items[key]
            nnz = (item.density or 0.0) * b.sizes[use[0]].rows * b.sizes[use[1]].cols
            value = item.value, P.Factor(b.sizes[use[0]].rows, b.sizes[use[1]].cols, nnz)
        factors, sizes, places, at, i = [], [], [], None, low
        while i <= high:
            if i + size - 1 <= high and b.key(i, i + size - 1) == key:
                at = len(factors) if at is None else at
                df, f = value
                factors.append(df)
                sizes.append(P.Factor(f.rows, f.cols, f.nnz))
                places.append((i, i + size - 1))
                i += size
            else:
                factors.append(b.factors[i])
                sizes.append(b.sizes[i])
                places.append((i, i))
                i += 1
        return factors, sizes, places, at or 0

    # -- logs

    def run_workload(self, source: str | Path | Iterable[str | MetapathQuery]) -> tuple[list[DataFrame], DataFrame]:
        """Results of a log's queries in order, each computed, and a table of what they took.

        Results are computed once and held, on disk where memory is short,
        until the session is closed. The table has a row for each query: ``number``, ``query``, ``rows``,
        ``seconds``, the hits, misses and writes of the cache so far, and what it ``held`` then.
        """
        if isinstance(source, (str, Path)):
            queries: list = read_workload(source)
        else:
            queries = [parse_query(x) if isinstance(x, str) else x for x in source]
        results, rows = [], []
        for number, query in enumerate(queries):
            began = time.perf_counter()
            df = self.run(query)
            if not df.is_cached:  # what is counted here is read again by the caller
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                self.loose.append(df)
            n = df.count()
            rows.append((number, str(query), n, time.perf_counter() - began, self.hits, self.misses, self.writes, self.held()))
            results.append(df)
        table = self.graph.spark.createDataFrame(rows, "number int, query string, rows long, seconds double, hits int, misses int, writes int, held string")
        return results, table

    def held(self) -> str:
        """What the cache holds, the next to go first."""
        name = lambda k: "".join(k.letters) + "".join(f"@{p}" for p in sorted(k.bound)) + (f"[{k.by[0]}]" if k.by else "") if isinstance(k, SpanKey) else str(k)
        return ", ".join(name(item.key) for item in self.policy.held)

    def close(self) -> None:
        """Frees what is kept."""
        for item in self.items.values():
            if item.valid and item.drop:
                item.drop()
        for df in self.loose:
            df.unpersist()
        self.items.clear()
        self.loose.clear()
        self.policy.held.clear()


def tagged(results: list[DataFrame]) -> DataFrame:
    """A log's results in one table, with the number of the query."""
    out = None
    for number, df in enumerate(results):
        own = df.select(F.lit(number).alias("query"), "src", "dst", "n")
        out = own if out is None else out.unionByName(own)
    return out
