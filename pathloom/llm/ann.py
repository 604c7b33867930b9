"""Nearest neighbours by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import array, groups, join_spread, materialize, parts_of

#: Vectors that a task holds at a time, about, and queries that it then asks.
BLOCK, ASK = 2048, 256
#: Vectors in a leaf, about, while the sample can tell so many leaves apart; and sampled vectors in a leaf at least.
LEAF, FEWEST = 16, 4
#: Queries whose best so far a task holds at most.
HELD = 20_000


class KMeansTree:
    """Nested k-means of a sample; leaves are numbered from 0, neighbours in the tree one after the other.

    Inner products are searched as distances: with one more component that
    brings every vector to the length ``top``, and that is 0 for a query, the
    vector with the largest inner product is the nearest one. ``rows`` is the
    number of vectors that the sample stands for: leaves are made for about
    ``LEAF`` of those, so their number grows with it as far as the sample goes.
    """

    def __init__(self, sample: np.ndarray, top: float, rows: int | None = None, branch: int = 64, rounds: int = 6, seed: int = 3):
        self.top, self.n_leaves = top, 0
        self.centres: list[np.ndarray] = []  # by inner node
        self.children: list[list[int]] = []  # by inner node: an inner node's number, or -1 - a leaf's
        self.rng = np.random.default_rng(seed)
        leaf = max(FEWEST, round(LEAF * len(sample) / max(1, rows or len(sample))))
        self.root = self._grow(self.lifted(sample), branch, leaf, rounds)

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], 1)

    def _grow(self, x: np.ndarray, branch: int, leaf: int, rounds: int) -> int:
        if len(x) > 2 * leaf:
            centre = x[np.sort(self.rng.choice(len(x), min(branch, -(-len(x) // leaf)), replace=False))]
            for _ in range(rounds):
                own = self._nearest(x, centre)
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                centre = np.add.reduceat(x[order], first) / np.diff(first, append=len(x))[:, None]
            own = self._nearest(x, centre)
            if np.bincount(own).max() < len(x):
                node = len(self.centres)
                self.centres.append(centre)
                self.children.append([])
                self.children[node] = [self._grow(x[own == i], branch, leaf, rounds) for i in range(len(centre))]
                return node
        self.n_leaves += 1
        return -self.n_leaves

    @staticmethod
    def _far(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return (centre * centre).sum(1) - 2 * x @ centre.T

    def _nearest(self, x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return self._far(x, centre).argmin(1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each vector is kept."""
        x, out = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                own = self._nearest(x[rows], self.centres[node])
                todo += [(child, rows[own == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, rows: np.ndarray, need: int) -> list[int]:
        """Leaves for a query until they hold ``need`` of the ``rows`` in each: always the nearest node yet unseen is opened."""
        q, out, seen = self.lifted(query[None], True), [], 0
        queue: list[tuple] = []

        def open_node(node: int) -> None:
            far = self._far(q, self.centres[node])[0]
            push(far.tolist(), np.argsort(far, kind="stable").tolist(), 0, self.children[node])

        def push(far: list, order: list, at: int, children: list) -> None:
            """A node's nearest child; the next one comes when this one is taken."""
            nonlocal turn
            turn += 1
            heapq.heappush(queue, (far[order[at]], turn, children[order[at]], far, order, at, children))

        turn = 0
        if self.root < 0:
            return [0]
        open_node(self.root)
        while queue and seen < need:
            _, _, node, far, order, at, children = heapq.heappop(queue)
            if at + 1 < len(order):
                push(far, order, at + 1, children)
            if node < 0:
                out.append(-1 - node)
                seen += int(rows[-1 - node])
            else:
                open_node(node)
        return out


def scores(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in order of components."""
    return np.cumsum(query[None] * x, 1)[:, -1] if x.shape[1] else np.zeros(len(x))


def nearest(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all queries their ``k`` best rows: the query's number, id and exact score.

    ``rough`` scores, minus infinity for rows that a query does not see,
    choose with slack, exact ones order; ties go to smaller ids.
    """
    seen = np.isfinite(rough)
    if len(x) > k:
        least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(seen, rough, 0)).max(1))
        seen &= rough >= (least - slack)[:, None]
    row, col = np.nonzero(seen)
    exact = np.cumsum(queries[row] * x[col], 1)[:, -1] if len(row) else np.zeros(0)
    return best(row, ids[col], exact, k)


def best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row."""
    order = np.lexsort([ids, -score, row])
    row, ids, score = row[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    rank = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    return row[rank < k], ids[rank < k], score[rank < k]


def _valid(vec: Column, dim: int | None = None) -> Column:
    fine = vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(vec, lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    return fine if dim is None else fine & (F.size(vec) == dim)


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one block, vectors before queries, these ``ASK`` at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([array(batch, k).to_numpy() for k in ("block", "asks")])
        cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(own[:, a].tolist())
            if held and (now != last or now[1] and sum(x.num_rows for x in held) >= ASK):
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_batches(held)


def blocks_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf, by its number of rows: its first block and its number of blocks.

    A block holds neighbouring leaves of ``BLOCK`` rows together, or a part
    of a leaf that has more.
    """
    first, count = np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // BLOCK))
    at, used = -1, BLOCK + 1
    for i, n in enumerate(rows.tolist()):
        if count[i] > 1 or used + n > BLOCK:
            at, used = at + 1, 0
        first[i] = at
        used += n
        if count[i] > 1:
            at, used = at + int(count[i]) - 1, BLOCK
    return first, count


def search(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.97, most_sample: int = 50_000, most_tests: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", counts: list[int] | None = None) -> DataFrame:
    """For each row that ``queries`` picks, its ``k`` nearest others found.

    Nearness is the largest inner product. A tree is fitted on a sample of
    ``most_sample`` distinct vectors (those with the smallest hashes), with
    leaves for about ``LEAF`` vectors of the table each, or ``FEWEST`` of the
    sample; every row is then put in its leaf. A query opens leaves best bin
    first until they hold a number of vectors that is calibrated: for
    ``most_tests`` queries the exact neighbours among all rows are found by
    brute force, and the number is raised until the mean share of neighbours
    in opened leaves reaches ``recall``; it is ``k`` + 1 at least, so no query
    is left with fewer neighbours than there are. Neighbouring leaves make
    blocks of about ``BLOCK`` vectors, and large ones are cut into several, so
    no leaf lands in one task; a query goes to a block once, with the leaves
    that it opens there. Equal vectors are kept once with their ``k`` + 1
    smallest ids, and equal queries are asked once.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the
    exact inner product); ties go to smaller ids; with fewer candidates than
    ``k`` all of them. Vectors that are null, zero, hold null or non-finite
    components, or are not as long as most are (ties: the longer), and rows
    with null ids take no part. Repeated rows count once. No rows give no
    rows; other columns are not read. To ``counts`` are added, if given, the
    number of vectors that a query opens and that of all.
    """
    spark = vectors.sparkSession
    number = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(f"array<{number}>").alias("vec"), queries.alias("asks")).where(F.col("id").isNotNull() & _valid(F.col("vec")))
    size = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = size.dim if size else 1
    plain = F.transform("vec", lambda x: x + F.lit(0.0).cast(number))  # no negative zeros
    rows = rows.where(F.size("vec") == dim).withColumn("vec", plain).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    rows = materialize(rows, "vectors")
    same = rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("held"), F.any_value("vec").alias("vec"))
    same = groups(same, "same-vectors")
    # Each task cuts a group to its smallest ids before they are dealt out, so one very common vector loads none.
    few = join_spread(rows.select("k1", "k2", "id"), same.where("held > 1").select("k1", "k2", "held"), ["k1", "k2"]).distinct()
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("nth") <= k + 1)
    few = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = materialize(same.join(few, ["k1", "k2"], "left").withColumn("ids", F.coalesce("ids", F.array("rep"))), "distinct-vectors")
    ordered = lambda df, n: df.orderBy(F.xxhash64("rep"), "rep").limit(n)
    sample = _matrix(ordered(distinct.select("rep", "vec"), most_sample).toArrow()["vec"].combine_chunks(), dim)
    total, top = distinct.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    tree = KMeansTree(sample, float(np.sqrt(top or 0.0)), total)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(tree))  # centres of the sample, so bounded by it

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(shared.value)
        for batch in batches:
            leaf = own.leaves(_matrix(array(batch, "vec"), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([array(batch, "rep"), array(batch, "vec"), pa.array(leaf)], names=["rep", "vec", "leaf"])

    placed = materialize(distinct.select("rep", "vec").mapInArrow(place, f"rep long, vec array<{number}>, leaf long"), "leaves", batch=2000)
    reps = distinct.select("k1", "k2", "rep", "held")
    asked = materialize(join_spread(rows.where("asks").select(F.col("id").alias("query_id"), "k1", "k2").distinct(), reps, ["k1", "k2"]).select("query_id", "rep"), "queries")
    questions = asked.select("rep").distinct().join(distinct.select("rep", "vec"), "rep")
    held = np.zeros(tree.n_leaves, np.int64)  # a number for each leaf of the tree
    for r in placed.groupBy("leaf").count().collect():
        held[r.leaf] = r["count"]
    need = max(k + 1, _rows_needed(placed, tree, held, ordered(questions, most_tests).collect(), dim, k, recall))
    if counts is not None:
        counts += [need, total]
    table = spark.sparkContext.broadcast((held, *blocks_of(held)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (held, first, count) = cloudpickle.loads(shared.value), table.value
        for batch in batches:
            x = _matrix(array(batch, "vec"), dim)
            picks, to, opened = [], [], []
            for i in range(batch.num_rows):
                leaves = np.sort(tree.visits(x[i], held, need))
                leaves = leaves[held[leaves] > 0]
                at, begin = np.unique(first[leaves], return_index=True)
                for block, own in zip(at.tolist(), np.split(leaves, begin[1:]), strict=True):
                    n = int(count[own[0]])  # a leaf of several blocks has them for itself
                    picks += [i] * n
                    to += range(block, block + n)
                    opened += [own.astype(np.int32).tobytes()] * n
            take = pa.array(picks, pa.int64())
            yield pa.RecordBatch.from_arrays([array(batch, "rep").take(take), array(batch, "vec").take(take), pa.array(to, pa.int64()), pa.array(opened, pa.binary()), pa.array([-1] * len(to), pa.int64())], names=names)

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, count = table.value
        for batch in batches:
            leaf, rep = array(batch, "leaf").to_numpy(), array(batch, "rep").to_numpy()
            own = first[leaf] + (rep * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) % count[leaf]
            yield pa.RecordBatch.from_arrays([array(batch, "rep"), array(batch, "vec"), pa.array(own), pa.nulls(len(own), pa.binary()), pa.array(leaf)], names=names)

    names = ["rep", "vec", "block", "opened", "leaf"]
    kind = f"rep long, vec array<{number}>, block long, opened binary, leaf long"
    kept = placed.mapInArrow(spot, kind).withColumn("asks", F.lit(0))
    wanted = questions.repartition(parts_of(spark)).mapInArrow(visit, kind).withColumn("asks", F.lit(1))
    dealt = kept.unionByName(wanted).repartition(parts_of(spark), "block").sortWithinPartitions("block", "asks", "leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, ids, begin = None, np.zeros((0, dim)), np.zeros(0, np.int64), {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            return [best(*map(np.concatenate, zip(*held, strict=True)), k + 1)]

        for group in _groups(batches):
            now = array(group, "block")[0].as_py()
            if not array(group, "asks")[0].as_py():
                at, x, ids, leaf = now, _matrix(array(group, "vec"), dim), array(group, "rep").to_numpy(), array(group, "leaf").to_numpy()
                first = np.flatnonzero(np.diff(leaf, prepend=-2))
                begin = {int(leaf[a]): slice(a, b) for a, b in zip(first, [*first[1:], len(leaf)], strict=True)}
            elif now == at:
                query, rep = _matrix(array(group, "vec"), dim), array(group, "rep").to_numpy()
                lists = [np.frombuffer(o.as_buffer(), np.int32) for o in array(group, "opened")]
                leaf, who = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(o) for o in lists])
                order = np.argsort(leaf, kind="stable")
                rough = np.full((len(query), len(x)), -np.inf)
                for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                    if (rows := begin.get(int(leaf[own[0]]))) is not None:  # a part of a large leaf may be empty
                        rough[who[own], rows] = query[who[own]] @ x[rows].T
                row, near, score = nearest(query, x, ids, k + 1, rough)
                held.append((rep[row], near, score))
                if sum(len(h[0]) for h in held) > 4 * HELD * (k + 1):
                    held = merged()
                    if len(held[0][0]) > HELD * (k + 1):  # many queries: what is found so far goes on
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in held.pop()], names=["rep", "near", "score"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in merged()[0]], names=["rep", "near", "score"])

    found = dealt.mapInArrow(compare, "rep long, near long, score double")
    top_of = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "near")
    found = materialize(found.withColumn("rank", F.row_number().over(top_of("rep"))).where(F.col("rank") <= k + 1).drop("rank"), "nearest", batch=2000)
    ids = distinct.select(F.col("rep").alias("near"), "ids").join(found.groupBy("near").agg(F.count("*").alias("held")), "near")
    found = join_spread(found, ids, ["near"]).select("rep", "score", F.explode("ids").alias("near"))
    found = found.withColumn("rank", F.row_number().over(top_of("rep"))).where(F.col("rank") <= k + 1)
    listed = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("near").alias("vec_id"), "score"))).alias("list"))
    listed = listed.join(asked.groupBy("rep").agg(F.count("*").alias("held")), "rep")
    out = join_spread(asked, listed, ["rep"]).select("query_id", F.filter("list", lambda x: x["vec_id"] != F.col("query_id")).alias("list"))
    return out.select("query_id", F.posexplode(F.slice("list", 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _rows_needed(placed: DataFrame, tree: KMeansTree, held: np.ndarray, tests: list, dim: int, k: int, recall: float) -> int:
    """Vectors to open so that the tests' exact neighbours lie among them often enough."""
    if not tests:
        return 1
    spark = placed.sparkSession
    asked = spark.sparkContext.broadcast((np.array([r.rep for r in tests]), np.array([r.vec for r in tests], np.float64)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = asked.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, leaf = _matrix(array(batch, "vec"), dim), array(batch, "rep").to_numpy(), array(batch, "leaf").to_numpy()
            rough = queries @ x.T
            n = min(k + 1, len(ids))
            top = np.argpartition(rough, -n, axis=1)[:, -n:]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(ids[top].reshape(-1)), pa.array(leaf[top].reshape(-1)), pa.array(np.take_along_axis(rough, top, 1).reshape(-1))], names=["rep", "near", "leaf", "score"])

    near = placed.mapInArrow(exact, "rep long, near long, leaf long, score double").where("rep <> near")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "near"))
    rows = near.withColumn("rank", rank).where(F.col("rank") <= k).select("rep", "leaf").collect()  # k rows for each test
    whole, opened = int(held.sum()), {}
    for r in tests:  # vectors opened before each leaf
        order = np.array(tree.visits(np.array(r.vec, np.float64), held, whole))
        before = np.zeros(len(held), np.int64)
        before[order] = np.cumsum(held[order]) - held[order]
        opened[r.rep] = before
    places = np.sort([opened[r.rep][r.leaf] for r in rows])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1
