"""The registry of a typed graph: node tables, relations and their statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cost import Sketch

COUNTED = "src long, dst long, n long"
#: Stretches of ids that a degree sketch tells apart at most.
STRETCHES = 1 << 16


@dataclass(frozen=True)
class Stats:
    """A relation's pairs and the sizes of its two node types."""

    nnz: int
    rows: int
    cols: int

    @property
    def density(self) -> float:
        return self.nnz / (self.rows * self.cols) if self.rows and self.cols else 0.0


REPEATS = ("many", "few", "none")


def weighted(df: DataFrame) -> DataFrame:
    """A relation's rows as ``src``, ``dst`` and ``n``.

    A missing or null weight is 1; a weight of 0 stays, as a pair without paths.
    """
    weight = F.coalesce(F.col("n").cast("long"), F.lit(1)) if "n" in df.columns else F.lit(1)
    return df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.cast("long").alias("n"))


def counted(df: DataFrame) -> DataFrame:
    """A relation in normal form: repeated pairs are summed."""
    return weighted(df).groupBy("src", "dst").agg(F.sum("n").alias("n"))


class Graph:
    """Node tables by type and relations by pair of types.

    A relation that is given in one direction serves in both. Unknown types
    and relations are errors; with ``strict=False`` they are empty. Relations
    in normal form are kept in memory and on disk between queries if ``keep``.
    """

    def __init__(self, spark: SparkSession, strict: bool = True, keep: bool = False):
        self.spark, self.strict, self.keep = spark, strict, keep
        self.nodes: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self._given: dict[tuple[str, str], DataFrame | Callable[[], DataFrame]] = {}
        self._repeats: dict[tuple[str, str], str] = {}
        self._relations: dict[tuple[str, str], DataFrame] = {}
        self.picked: dict = {}  # what constraints were found to pick
        self._dims: dict[str, int] = {}
        self._nnz: dict[tuple[str, str], int] = {}
        self._lines: dict[tuple[str, str], int] = {}
        self._degrees: dict[tuple[str, str, str], np.ndarray] = {}

    def add_nodes(self, kind: str, df: DataFrame | Callable[[], DataFrame]) -> Graph:
        """A node table; its column ``id`` is a number, the others are compared as strings.

        A function that gives the table is called when the table is needed.
        """
        self.nodes[kind] = df
        return self

    def add_relation(self, src: str, dst: str, df: DataFrame | Callable[[], DataFrame], repeats: str = "many") -> Graph:
        """Pairs ``src``, ``dst`` and maybe weights ``n``, or a function that gives them.

        ``repeats`` says how often pairs come again. ``many``: they are summed
        before anything else. ``few``: in a product they are not, since rows
        that repeat multiply out to the same sums, and a shuffle is saved.
        ``none`` is a promise that none does, as with a key of a table.
        """
        if repeats not in REPEATS:
            raise ValueError(f"repeats is one of {', '.join(REPEATS)}")
        self._given[src, dst], self._repeats[src, dst] = df, repeats
        return self

    def given(self, src: str, dst: str) -> DataFrame:
        """The relation's rows as they were given."""
        df = self._given[src, dst]
        if not isinstance(df, DataFrame):
            df = self._given[src, dst] = df()
        return df

    def relation(self, src: str, dst: str) -> DataFrame:
        if (src, dst) not in self._relations:
            if (src, dst) in self._given:
                df = (weighted if self._repeats[src, dst] == "none" else counted)(self.given(src, dst))
            elif (dst, src) in self._given:
                df = self.relation(dst, src).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
            elif self.strict:
                raise KeyError(f"no relation between {src} and {dst}")
            else:
                df = self.spark.createDataFrame([], COUNTED)
            if self.keep and (src, dst) in self._given:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._relations[src, dst] = df
        return self._relations[src, dst]

    def rows(self, src: str, dst: str) -> DataFrame:
        """The relation as a factor of a product: pairs may repeat if few do."""
        given, turned = (src, dst) in self._given, (dst, src)
        if self.keep or self._repeats.get((src, dst) if given else turned, "many") != "few":
            return self.relation(src, dst)
        if given:
            return weighted(self.given(src, dst))
        return self.rows(*turned).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")

    def node_table(self, kind: str) -> DataFrame:
        if kind in self.nodes:
            df = self.nodes[kind]
            if not isinstance(df, DataFrame):
                df = self.nodes[kind] = df()
            if "id" not in df.columns:
                raise ValueError(f"nodes of type {kind} have no column id")
            return df
        if self.strict:
            raise KeyError(f"no nodes of type {kind}")
        return self.spark.createDataFrame([], "id long")

    def dimension(self, kind: str) -> int:
        """The largest id and one; 0 without nodes."""
        if kind not in self._dims:
            top = self.node_table(kind).agg(F.max(F.col("id").cast("long"))).first()[0]
            self._dims[kind] = 0 if top is None else top + 1
        return self._dims[kind]

    def _key(self, src: str, dst: str) -> tuple[str, str]:
        """The pair as it was given."""
        return (src, dst) if (src, dst) in self._given or (dst, src) not in self._given else (dst, src)

    def stats(self, src: str, dst: str) -> Stats:
        """Exact numbers: of distinct pairs, and of both types' ids."""
        key = self._key(src, dst)
        if key not in self._nnz:
            self._nnz[key] = self.relation(*key).count()
        return Stats(self._nnz[key], self.dimension(src), self.dimension(dst))

    def sizes(self, pairs: list[tuple[str, str]]) -> list[Stats]:
        """Numbers good enough for planning, all found by one job.

        Pairs are counted as they are given, repeated ones too, which reads no
        column and shuffles nothing; where a relation is kept anyway, its
        distinct pairs are counted, which also fills the store.
        """
        keys = list(dict.fromkeys(self._key(*p) for p in pairs))
        counts = [k for k in keys if k not in self._nnz and k not in self._lines]
        for k in counts:
            self.relation(*k)  # an unknown one is an error
        own = lambda k: self.relation(*k) if self.keep or k not in self._given else self.given(*k)
        jobs = [own(k).agg(F.count("*").alias("x")).select(F.lit(i).alias("i"), "x") for i, k in enumerate(counts)]
        kinds = [k for k in dict.fromkeys(x for p in pairs for x in p) if k not in self._dims]
        jobs += [self.node_table(k).agg(F.max(F.col("id").cast("long")).alias("x")).select(F.lit(i).alias("i"), "x") for i, k in enumerate(kinds, len(counts))]
        if jobs:
            every = jobs[0]
            for job in jobs[1:]:
                every = every.union(job)
            found = dict(every.collect())
            for i, k in enumerate(counts):
                (self._nnz if self.keep else self._lines)[k] = found[i]
            for i, k in enumerate(kinds, len(counts)):
                self._dims[k] = 0 if found[i] is None else found[i] + 1
        pick = lambda k: self._nnz.get(k, self._lines.get(k))
        return [Stats(pick(self._key(*p)), self._dims[p[0]], self._dims[p[1]]) for p in pairs]

    def sketches(self, factors: list[tuple[str, str, DataFrame | None]]) -> list[Sketch]:
        """Degree sketches of relations for planning, all found by one job.

        A factor names its relation and is that (None) or part of it. Spark
        counts pairs by source and by target, in stretches of ids of which a
        type has ``STRETCHES`` at most, so what reaches the driver is bounded
        for types of any size.
        """
        width = lambda kind: max(1, -(-self.dimension(kind) // STRETCHES))
        jobs, places = [], []
        for at, (src, dst, df) in enumerate(factors):
            for end, kind in (("src", src), ("dst", dst)):
                if df is None and ((src, dst, end) in self._degrees or any(x[:4] == (src, dst, end, True) for x in places)):
                    continue
                rel = self.rows(src, dst) if df is None else df
                spot = F.expr(f"{end} div {width(kind)}")
                jobs.append(rel.where(F.col(end).between(0, self.dimension(kind) - 1)).groupBy(spot.alias("spot")).agg(F.count("*").alias("n")).select(F.lit(len(jobs)).alias("job"), "spot", "n"))
                places.append((src, dst, end, df is None, at))
        found = {}
        if jobs:
            every = jobs[0]
            for job in jobs[1:]:
                every = every.unionByName(job)
            rows = every.toArrow()
            job, spot, n = (rows[c].to_numpy() for c in ("job", "spot", "n"))
            for i, (src, dst, end, whole, at) in enumerate(places):
                kind = src if end == "src" else dst
                v = np.zeros(-(-self.dimension(kind) // width(kind)), np.int64)
                v[spot[job == i]] = n[job == i]
                if whole:
                    self._degrees[src, dst, end] = v
                else:
                    found[at, end] = v
        ends = lambda at, src, dst, end: self._degrees[src, dst, end] if factors[at][2] is None else found[at, end]
        return [Sketch(ends(at, src, dst, "src"), ends(at, src, dst, "dst"), width(dst)) for at, (src, dst, _) in enumerate(factors)]

    def close(self) -> None:
        for df in self._relations.values():
            df.unpersist()


def degree(relation: DataFrame, end: str) -> DataFrame:
    """``idx`` and ``cnt``: pairs by source (``end="src"``) or target."""
    return relation.groupBy(F.col(end).alias("idx")).agg(F.count("*").alias("cnt"))
