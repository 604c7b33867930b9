"""Quality selection by importance resampling: hashed n-gram models, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array, blocks, materialize, mix64
from .shingles import words

#: Hash buckets of the n-gram models, as a power of two.
BITS = 18
BUCKETS = 1 << BITS
#: Lengths of the n-grams of characters, and of those of word shapes.
CHARACTERS, SHAPES = (3, 5), (1, 2)
#: Letters of a word that its shape tells apart at most.
LONGEST = 12
_P = np.uint64(0x9E3779B97F4A7C15)


def _grams(tokens: np.ndarray, size: np.ndarray, lengths: tuple[int, ...], salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams of tokens that lie in one of the stretches of these sizes, and the stretch's number."""
    owner, place, end = np.repeat(np.arange(len(size)), size), np.arange(len(tokens)), np.repeat(np.cumsum(size), size)
    h = tokens
    for k in range(1, max(lengths) + 1):
        if k > 1:
            h = h[:-1] * _P + tokens[k - 1 :]
        if k in lengths:
            inside = place[: len(h)] + k <= end[: len(h)]
            yield (mix64(h + np.uint64(salt + k)) >> np.uint64(64 - BITS)).astype(np.int64)[inside], owner[: len(h)][inside]


def shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shape of each word of all texts in a row, and the number of words by text.

    A shape says how long the word is, whether it is letters only, whether it
    ends in a letter, and whether it is the word before once more. So a model
    of shapes knows how words are strung together but no word.
    """
    names, index, bounds = words(texts)
    length = np.minimum(pc.utf8_length(names).to_numpy(), LONGEST)
    plain, tail = (pc.match_substring_regex(names, x).to_numpy(zero_copy_only=False) for x in (r"^\pL+$", r"\pL$"))
    same = np.concatenate([[False], index[1:] == index[:-1]]) if len(index) else np.zeros(0, bool)
    same[bounds[:-1][bounds[:-1] < len(same)]] = False  # a text's first word follows none
    return (1 + same + 2 * (tail + 2 * (plain + 2 * length))[index]).astype(np.uint64), np.diff(bounds)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of characters and of word shapes, each with the number of the text it lies in."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    whole = texts.to_pylist()
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    yield from _grams(codes, np.fromiter(map(len, whole), np.int64, len(whole)), CHARACTERS, 0)
    yield from _grams(*shapes(texts), SHAPES, 200)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``bucket``, ``raw`` and ``target``: n-grams of all texts, and of those with ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in blocks(batches, "text", 1 << 20):
            fit = array(batch, "fit").to_numpy(zero_copy_only=False).astype(bool)
            for bucket, owner in features(array(batch, "text")):
                raw += np.bincount(bucket, minlength=BUCKETS)
                if fit.any():
                    target += np.bincount(bucket[fit[owner]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, raw[seen], target[seen])], names=["bucket", "raw", "target"])

    counted = docs.select("text", "fit").mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Log of target over raw probability by bucket; as many numbers as buckets."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rows = counts.toArrow()  # BUCKETS rows at most
    bucket = rows["bucket"].to_numpy()
    raw[bucket], target[bucket] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return np.log((target + smooth) / (target.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1024) -> float | None:
    """The ``k``-th largest value, found by counting in narrower and narrower bins."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None or k <= 0:
        return None
    while low < high:
        width = (high - low) / bins
        spot = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        rows = df.where(F.col(col).between(low, high)).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect()
        before = (low, high)
        for r in sorted(rows, key=lambda r: -r.bin):
            if k <= r.n:
                low, high = r.low, r.high
                break
            k -= r.n
        if (low, high) == before and len(rows) == 1:
            break  # floats too near each other to part
    return low


def cut(good: np.ndarray, bad: np.ndarray, keep: float = 0.001, miss: float = 0.01) -> float:
    """The score from which a document counts as like the target.

    Between the ``keep`` quantile of good held-out documents and the score
    above which only ``miss`` of the bad ones lie; if these overlap, the
    former: good documents stay.
    """
    if not len(good):
        return -np.inf
    low = float(np.quantile(good, keep))
    high = float(np.quantile(bad, 1 - miss)) if len(bad) else low
    return (low + high) / 2 if high < low else low


def resample(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, prior: int = 64, temperature: float = 0.04, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1 and coalesce(toxic, 0) = 0", bad: str = "quality = 0", carry: list[str] | None = None) -> DataFrame:
    """Importance resampling: a draw of documents, without replacement, by their weights.

    Two models of hashed n-grams (3 and 5 characters, 1 and 2 word shapes, see
    :func:`shapes`) are counted: the target's from labelled ``good``
    documents, the raw text's from all documents. Labelled rows are a
    sample of ``most_labels`` at most, those with the smallest hashes of ids;
    half of them fit the target, the other half calibrate. A document's score
    is its summed log ratio of target to raw by its number of n-grams plus
    ``prior``, so that long and short documents compare; its importance weight
    is the exponential of the score by ``temperature``. ``k``, the size of the
    draw, is the number of documents that reach the calibrated score (see
    :func:`cut`). The draw is Gumbel top-k: the ``k`` documents with the
    largest log weight plus Gumbel noise seeded by id and text, which chooses
    as drawing one after the other in proportion to the weights left does.
    Runs with one seed agree; with another seed, documents whose scores are
    within a few temperatures of the limit change places.

    Returns ``id_col``, ``n_grams``, ``score``, ``key`` and ``kept``, or the
    columns of ``docs`` named in ``carry`` and ``kept`` (which none of them
    may be named). Null and empty texts score 0; texts of any length are read
    whole. Repeated rows have equal keys and share their fate (ties at the
    k-th key stay). Without labels of good documents all are kept. No rows
    give no rows. Labels with null ids count nowhere; of several labels of one
    id the lowest quality and highest toxicity count.
    """
    spark = docs.sparkSession
    found = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = found.withColumn("draw", F.xxhash64("label_id", F.lit(seed))).orderBy("draw", "label_id").limit(most_labels)
    sample = sample.select("label_id", F.expr(good).alias("good"), F.expr(bad).alias("bad"), (F.pmod("draw", F.lit(2)) == 0).alias("half"))
    sample = materialize(sample, "label-sample")
    unit = (F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    more = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), unit.alias("unit"), *more)
    # The sample has ``most_labels`` rows at most.
    flags = [F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "bad", "half")]
    rows = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id"), "left").select(*rows.columns, *flags)
    ratio = log_ratios(bucket_counts(rows.select("text", (F.col("good") & F.col("half")).alias("fit"))))
    shared = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers
    kept = ["id", "unit", "good", "bad", "half", *(["carried"] if carry else [])]
    kind = T.StructType([rows.schema[c] for c in kept] + [T.StructField("n_grams", T.LongType()), T.StructField("sum", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for bucket, owner in features(array(batch, "text")):
                n = n + np.bincount(owner, minlength=batch.num_rows)
                total = total + np.bincount(owner, shared.value[bucket], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(array(batch, c) for c in kept), pa.array(n.astype(np.int64)), pa.array(total.astype(np.float64))], names=[*kept, "n_grams", "sum"])

    scored = rows.mapInArrow(run, kind).withColumn("score", F.col("sum") / (F.col("n_grams") + prior))
    scored = materialize(scored.withColumn("key", F.col("score") / temperature - F.log(-F.log("unit"))), "scores", batch=500)
    held = scored.where("(good or bad) and not half").groupBy("id").agg(F.first("good").alias("good"), F.min("score").alias("score")).toPandas()  # most_labels rows at most
    limit = cut(held["score"][held["good"].astype(bool)].to_numpy(), held["score"][~held["good"].astype(bool)].to_numpy())
    k = scored.where(F.col("score") >= F.lit(limit)).count()
    least = kth_largest(scored, "key", k)
    chosen = (F.lit(False) if least is None else F.col("key") >= F.lit(least)).alias("kept")
    return scored.select("carried.*", chosen) if carry else scored.select(F.col("id").alias(id_col), "n_grams", "score", "key", chosen)
