"""Near-duplicates by HyperMinHash: banded registers, estimates, then full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array, blocks, column, groups, join_spread, likely, materialize, parts_of, release
from .components import components
from .shingles import shingle_sets

#: A hash's first bits choose one of 2 ** ``BUCKET_BITS`` registers; the rest is kept as the number
#: of its leading zeros (6 bits) and the ``MANTISSA_BITS`` after the first one.
BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
REST_BITS = 64 - BUCKET_BITS
#: Registers in a band. With 32 bands two sets of similarity 0.8 share none with a chance of 5e-8.
ROWS = 4
BANDS = REGISTERS // ROWS
#: An estimate this far below the threshold (4.5 standard deviations at 0.8) spares the full check.
MARGIN = 0.16
#: Members of a bucket that one comparison holds, about.
BLOCK = 128


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted distinct hashes: 16 bits a register, 0 where it is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest of each bucket
    rest = hashes[first] & np.uint64((1 << REST_BITS) - 1)
    high = rest >> np.uint64(5)  # exact as a double
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 5, np.frexp((rest & np.uint64(31)).astype(np.float64))[1]).astype(np.int64)
    zeros = REST_BITS - bits
    shift = bits - 1 - MANTISSA_BITS
    tail = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out[bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA_BITS) | tail).astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two disjoint sets of these sizes share by chance (Yu and Weber, HyperMinHash)."""
    big, small = np.maximum(n, m).astype(np.float64), np.maximum(np.minimum(n, m), 1).astype(np.float64)
    ratio = big / small
    return 0.169919487159739093975315012348 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches along the last axis, less what chance would give."""
    same = ((a == b) & (a != 0)).sum(-1)
    used = ((a != 0) | (b != 0)).sum(-1)
    # Sets smaller than the sketch collide less: only registers that both use can.
    chance = expected_collisions(n, m) * used / REGISTERS
    return np.maximum(same - chance, 0) / np.maximum(used - chance, 1)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``row`` and ``text_hash`` as given, ``n`` (size of the shingle set), ``key`` (the set's hash; null if empty), ``sketch``."""
    given = ["id", "row", "text_hash"]
    kind = T.StructType([*(docs.schema[c] for c in given), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sets = shingle_sets(array(batch, "text"), width)
            yield pa.RecordBatch.from_arrays([*(array(batch, c) for c in given), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=kind.names)

    return docs.mapInArrow(run, kind)


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = column(batch, name)
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), REGISTERS)


def promising(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with sizes and sketches, those whose sizes and estimate allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = array(batch, "n_u").to_numpy(), array(batch, "n_v").to_numpy()
            good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (estimate(_matrix(batch, "s_u"), _matrix(batch, "s_v"), n, m) >= percent / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([array(batch, "u"), array(batch, "v")], names=["u", "v"]).filter(pa.array(good))

    return pairs.mapInArrow(run, T.StructType([pairs.schema["u"], pairs.schema["v"]]))


class _Union:
    """Components of one task's rows, joined as links are found."""

    def __init__(self, labels: list):
        number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.of = np.array([number[x] for x in labels], np.int64)

    def join(self, i: int, j: int) -> bool:
        """Whether the link of two rows joined two components."""
        if self.of[i] == self.of[j]:
            return False
        self.of[self.of == self.of[j]] = self.of[i]
        return True


def linked(sets: list[np.ndarray], labels: list, asks: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the rows' components, found by full sets.

    Rows in ``asks`` are compared with all rows of other components; of the
    links found, those that join none are left out.
    """
    size = np.array([len(x) for x in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    mark = np.zeros(int(word.max()) + 1 if len(word) else 1, np.int64)
    union = _Union(labels)
    for i in np.flatnonzero(asks).tolist():
        other = (union.of != union.of[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if not other.any():
            continue
        own = word[ends[i] - size[i] : ends[i]]
        mark[own] = 1
        if other.sum() <= len(sets) // 8:
            near = np.flatnonzero(other)
            shared = np.array([int(mark[word[ends[j] - size[j] : ends[j]]].sum()) for j in near.tolist()])
        else:
            near = np.arange(len(sets))
            shared = np.bincount(owner, mark[word], len(sets)).astype(np.int64)
        mark[own] = 0
        for j in near[other[near] & (100 * shared >= percent * (size[i] + size[near] - shared))].tolist():
            if union.join(i, j):
                yield i, j


def cluster_sets(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles``: the full sets of clustered classes, as sorted hashes in bytes.

    ``nodes`` names for each class the id and text hash of one document that
    has the set; the documents' texts are read once, those of other documents
    are dropped where they lie (:func:`likely`), and each set is made once.
    """
    found = join_spread(likely(docs, nodes, ["id", "text_hash"]), nodes, ["id", "text_hash"]).select("text", F.explode("own").alias("own")).select("text", "own.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in blocks(batches, "text"):
            node = column(batch, "node")
            batch = batch.filter(pa.array([x not in done for x in node], pa.bool_()))  # repeated rows share a task
            sets = shingle_sets(array(batch, "text"), width)
            right = pa.array([_key(s) == k for s, k in zip(sets, column(batch, "key"), strict=True)], pa.bool_())
            batch = pa.RecordBatch.from_arrays([array(batch, "node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]).filter(right)
            done.update(column(batch, "node"))
            yield batch

    # Repeated rows of a frequent document may lie in several tasks.
    return found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def in_blocks(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links within groups of rows with equal ``keys``, by full sets.

    ``rows`` has ``node``, ``shingles``, ``component`` and ``asks`` (see
    :func:`linked`); a group has a bounded number of rows. Groups that differ
    in the last key only, which numbers them, go to one partition after the
    other, so that those of a large cluster do not meet in a few.
    """
    parts = parts_of(rows.sparkSession)
    place = F.pmod(F.pmod(F.xxhash64(*keys[:-1]), F.lit(parts)) + F.col(keys[-1]), F.lit(parts)).cast("int")
    dealt = rows.withColumn("place", place).repartitionById(parts, F.col("place")).drop("place").sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if group.num_rows > 1:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in array(group, "shingles")]
                pairs = list(linked(sets, column(group, "component"), array(group, "asks").to_numpy(zero_copy_only=False).astype(bool), percent))
                if pairs:
                    left, right = (array(group, "node").take(pa.array(x)) for x in zip(*pairs, strict=True))
                    yield pa.RecordBatch.from_arrays([left, right], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs with both sides' sizes and sketches; a class may be ``u`` of any number of pairs."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    first = groups(side("u").join(pairs.groupBy("u").agg(F.count("*").alias("held")), "u"), "leads")
    return join_spread(pairs, first, ["u"]).join(side("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([array(batch, k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(own[:, a].tolist())
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_batches(held)


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs that join components within a bucket, as far as sizes and estimates allow.

    ``members`` has ``bucket``, ``held`` (the bucket's members), ``node``,
    ``component``, ``n`` and ``sketch``. A bucket is cut into blocks of about
    ``BLOCK`` members, and each two blocks are compared in one go; of the
    pairs that could be links a task returns those that join components.
    """
    spark = members.sparkSession
    block = members.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = block.select("bucket", "node", "component", "n", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    keys = ["bucket", "low", "high"]
    dealt = dealt.repartition(parts_of(spark), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            sketch, n, node = _matrix(group, "sketch"), array(group, "n").to_numpy(), array(group, "node")
            union = _Union(column(group, "component"))
            pairs = []
            for i in range(len(n)):
                j = np.flatnonzero((union.of != union.of[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                if len(j):
                    j = j[estimate(sketch[i], sketch[j], np.full(len(j), n[i]), n[j]) >= percent / 100 - MARGIN]
                    pairs += [(i, x) for x in j.tolist() if union.join(i, x)]
            if pairs:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(x)) for x in zip(*pairs, strict=True)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def clusters_of(classes: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``component``: classes that estimates may join, directly or through others.

    Each member of a bucket is compared with the bucket's smallest; where
    several components are left in a bucket, all of its members are. Buckets
    that very many classes share are joined where their rows are
    (:func:`join_spread`).
    """
    part = F.col("sketch").substr(F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    bands = classes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).withColumn("part", part)
    bands = bands.where(F.col("part") != F.lit(bytes(2 * ROWS))).select("node", F.xxhash64("band", "part").alias("bucket"))
    buckets = groups(bands.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("held"), F.count("*").alias("size")).where("held > 1"), "buckets")
    members = materialize(join_spread(bands, buckets, ["bucket"]), "members")
    pairs = materialize(members.where("node > lead").select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), "lead-pairs")
    found = materialize(components(promising(_with_sketches(pairs, classes), percent)), "near-smallest")
    # The smallest member has met all others; of the rest some may be in different components.
    rest = members.where("node > lead and size > 2").select("bucket", "node").join(found, "node", "left")
    rest = materialize(rest.select("bucket", "node", F.coalesce("component", "node").alias("component")), "unsettled")
    unsettled = rest.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("held")).where("a <> b")
    unsettled = groups(unsettled.select("bucket", "held", F.col("held").alias("size")), "unsettled-buckets")
    release(buckets, members, pairs)
    if not unsettled.seen["whole"]:
        return found
    more = across(join_spread(rest, unsettled, ["bucket"]).withColumnRenamed("size", "held").join(classes.select("node", "n", "sketch"), "node"), percent)
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))


def links_in(clusters: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join all linked classes of each cluster, from full sets.

    Clusters are cut into blocks of about ``BLOCK``; each block is compared
    with itself and the cluster's smallest. Members of a larger cluster which
    that leaves apart from the smallest are then compared with all blocks.
    """
    held = clusters.groupBy("component").agg(F.count("*").alias("held")).withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    placed = join_spread(clusters, groups(held, "cluster-sizes"), ["component"])
    placed = placed.select("node", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = materialize(placed, "clusters", large=F.max("blocks"))
    nodes = classes.join(placed.select("node"), "node", "left_semi").select("node", "key", "id", "text_hash", "held")
    # Of classes that share an id and a text hash (another text, then) the sets' own hash tells the right one.
    nodes = nodes.groupBy("id", "text_hash").agg(F.max("held").alias("held"), F.collect_set(F.struct("node", "key")).alias("own"))
    nodes, docs = groups(nodes, "cluster-texts"), docs.select("id", "text_hash", "text")
    sets = materialize(cluster_sets(nodes, docs, width), "cluster-sets")
    rows = sets.join(placed, "node")
    everywhere = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = rows.select("node", "shingles", "cluster", F.explode(everywhere).alias("block"), F.col("node").alias("component"), F.lit(True).alias("asks"))
    links = materialize(in_blocks(first, ["cluster", "block"], percent), "links-in-blocks")
    if (placed.seen["large"] or 0) < 2:
        return links
    found = components(links)
    large = placed.where("blocks > 1").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    large = materialize(large, "large-clusters")
    apart = large.groupBy("cluster").agg(F.count("*").alias("held"), F.ceil(F.sum((F.col("component") != F.col("cluster")).cast("long")) / BLOCK).cast("int").alias("ask_blocks")).where("ask_blocks > 0")
    large = join_spread(large, apart, ["cluster"])
    answer = large.select("node", "cluster", "component", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask"), "block", F.lit(False).alias("asks"))
    ask = large.where("component <> cluster").select("node", "cluster", "component", F.pmod(F.xxhash64("node"), F.col("ask_blocks")).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"))
    return links.union(in_blocks(sets.join(answer.unionByName(ask), "node"), ["cluster", "ask", "block"], percent))


def _of(classes: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """Rows with the ``cols`` of the class that they name by ``key``."""
    right = classes.select(*dict.fromkeys(("key", *cols)), "held")
    right.seen = classes.seen
    return join_spread(rows, right, ["key"])


def shared_ids(base: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between classes that one id has documents in; None if no id has several."""
    known = base.where("key is not null and id is not null")
    mark = F.xxhash64("key")
    ids = groups(known.groupBy("id").agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.count("*").alias("held")).where("a <> b").select("id", "held"), "shared-ids")
    if not ids.seen["whole"]:
        return None
    both = join_spread(known.select("id", "key"), ids, ["id"]).distinct()
    both = materialize(_of(classes, both, "key", "node").select("id", "node"), "shared-classes")
    lead = both.groupBy("id").agg(F.min("node").alias("u"), F.count("*").alias("held"))
    return join_spread(both, lead, ["id"]).where("node > u").select("u", F.col("node").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Each document's group of near-duplicates.

    A document's set holds the distinct shingles of ``width`` words, A-Z
    lower-cased; two are linked if 100 times the shared shingles are at least
    ``percent`` times all of both. Documents with equal sets form a class.
    Classes whose compressed registers agree in a band share a bucket. Sizes
    and estimates corrected for collisions say which of them could be linked;
    components of those are clusters. Within a cluster links are confirmed on
    full sets, each made once from its text, in blocks of bounded size, until
    no two members in different components are left unchecked. Pairs are never
    listed: a task returns only links that join two components. A link between
    different sets that share a band is lost only where the estimate is more
    than ``MARGIN`` too low: by the binomial tail of 128 registers about 9e-6
    of links of similarity 0.8 at 80 percent, 3e-6 of 0.85 at 85, unless
    others join the two.

    Returns ``id_col``, ``n_shingles``, ``component_id`` (the smallest id
    reachable) and ``kept`` (it is the row's own). Texts of any length are
    read whole. Null and empty texts are linked with nothing. Rows that share
    an id are linked by it, whatever their texts, unless these are empty. A
    row with a null id is linked with nothing and kept, with a null component.
    With ``row_col``, which numbers the rows, that column is returned too, and
    of the rows that would be kept for one component only the one with the
    smallest number is; rows of empty texts or null ids stay all. No rows give
    no rows; other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.lit(0).cast("long")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    base = materialize(sketches(docs, width), "sketches", batch=200)
    first = F.min(F.struct("id", "text_hash"))
    classes = base.where("key is not null and id is not null").groupBy("key").agg(first.alias("one"), F.count("*").alias("held"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = groups(classes.select(F.monotonically_increasing_id().alias("node"), "key", "one.id", "one.text_hash", "held", "n", "sketch"), "classes")
    clusters = clusters_of(classes, percent)
    links = links_in(clusters, classes, docs, width, percent)
    shared = shared_ids(base, classes)
    found = components(links if shared is None else links.union(shared))
    named = classes.select("node", "key", "id", "held").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "components")
    low = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    named = groups(join_spread(named, groups(low, "component-ids", "members"), ["component"], held="members").select("key", "component_id", "held"), "named")
    own = base.select("id", "row", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
    out = join_spread(own, named, ["key"], how="left").withColumn("component_id", F.coalesce("component_id", "id"))
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))
    if row_col:
        out = materialize(out, "near-rows")
        least = out.where("key is not null and component_id = id").groupBy("id").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("least"))
        out, kept = out.join(least, "row", "left"), kept & (F.col("key").isNull() | F.coalesce("least", F.lit(False)))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id"), kept.alias("kept"), *([F.col("row").alias(row_col)] if row_col else []))
