"""Order MinHash: fingerprints of whole texts that follow their edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, column, in_id_order, mix64

_P = 0x9E3779B97F4A7C15
_M = 0xFFFFFFFFFFFFFFFF
#: Bits of a k-mer's hash that name it, and of its place, in the sort of one array.
_PLACE = 24


class OrderMinHash:
    """``slots`` signatures of a text's k-mers of ``k`` code points.

    Each k-mer is told from its equals by its number of occurrence. For each
    slot the two occurrence-numbered k-mers with the smallest hashes are
    chosen, put in the order in which they stand in the text, and the pair is
    hashed into 32 bits. Two texts have a slot alike if they share both
    k-mers in that order, so moved and edited passages both count. A text
    shorter than ``k`` is one k-mer; an empty text has the value 0 in all slots.
    """

    def __init__(self, k: int = 8, slots: int = 64, seed: int = 1):
        self.k, self.slots = k, slots
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 32, slots, np.uint64).astype(np.uint32)
        self.mul = rng.integers(0, 1 << 32, slots, np.uint64).astype(np.uint32) | np.uint32(1)
        self.salt = mix64(rng.integers(0, 1 << 63, slots, np.uint64))

    def kmers(self, codes: np.ndarray) -> np.ndarray:
        """64-bit hashes of all k-mers, by doubling the length hashed."""
        k = min(self.k, len(codes))
        h, done, bit = codes.astype(np.uint64) + np.uint64(1), 1, k.bit_length() - 2
        base = h
        while bit >= 0:
            h = h[: len(h) - done] * np.uint64(pow(_P, done, 1 << 64)) + h[done:]
            done *= 2
            if k >> bit & 1:
                h = h[: len(h) - 1] * np.uint64(_P) + base[done:]
                done += 1
            bit -= 1
        return mix64(h)

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of the occurrence-numbered k-mers, and their places."""
        h = self.kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        n = len(h)
        name = h >> np.uint64(_PLACE)
        if n < 1 << _PLACE:
            key = name << np.uint64(_PLACE) | np.arange(n, dtype=np.uint64)
            key.sort()
            name, place = key >> np.uint64(_PLACE), (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        else:
            place = np.argsort(name, kind="stable")
            name = name[place]
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(name[1:], name[:-1], out=first[1:])
        row = np.arange(n)
        number = row - np.maximum.accumulate(np.where(first, row, 0))
        x = mix64(name + number.astype(np.uint64) * np.uint64(_P))
        return (x >> np.uint64(32)).astype(np.uint32), place

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(self.slots, np.uint32)
        x, place = self.numbered(text)
        a, b = np.empty(self.slots, np.int64), np.empty(self.slots, np.int64)
        step = max(1, (1 << 17) // len(x))
        for i in range(0, self.slots, step):
            own = (x ^ self.xor[i : i + step, None]) * self.mul[i : i + step, None]
            rows = np.arange(len(own))
            a[i : i + step] = best = own.argmin(1)
            own[rows, best] = 0xFFFFFFFF
            b[i : i + step] = own.argmin(1)
        swap = place[a] > place[b]
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        pair = x[first].astype(np.uint64) << np.uint64(32) | x[second]
        if len(x) == 1:
            pair = x[first].astype(np.uint64)
        return (mix64(pair ^ self.salt) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    @staticmethod
    def likeness(a: np.ndarray, b: np.ndarray) -> float:
        """Share of slots that agree: 1 for equal texts, near 0 for unrelated ones."""
        return float(np.count_nonzero(a == b)) / len(a)


def as_hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text_col: str = "text", to: str = "fingerprint", k: int = 8, slots: int = 64) -> DataFrame:
    """``docs`` with the fingerprint of each whole text in column ``to``, as hex.

    All columns are kept (one named ``to`` is replaced). Null and empty texts
    have the fingerprint of zeros; equal texts have equal ones; rows neither
    come nor go. One pass without a shuffle.
    """
    kept = [c for c in docs.columns if c != to]
    kind = T.StructType([docs.schema[c] for c in kept] + [T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, slots)
        for batch in blocks(batches, text_col, 2 << 20):
            hashes = pa.array([as_hex(sketch(x)) for x in column(batch, text_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=[*kept, to])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, kind)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4, k: int = 8, slots: int = 64) -> DataFrame:
    """Each text beside its edited text and the next document, by fingerprint.

    The edited text is the text with its last ``n // part`` code points
    replaced by the first as many (or all) of the next document's text, next
    in ascending order of ``id_col``, and the first after the last. Texts are
    dealt into ranges of ids by one shuffle, and each range also gets the row
    that follows it. Returns ``id_col``, ``n_chars``, ``edited`` (the text),
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    Null text: empty. Null ids come last, equal ids in order of text. A table
    of one row is its own next. No rows give no rows.
    """
    rows, parts = in_id_order(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text", look_ahead=True)
    kind = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, slots)
        begin = last = None

        def told(row: tuple, after: tuple) -> tuple:
            doc, text, own = row
            cut = len(text) // part
            edited = text[: len(text) - cut] + after[1][:cut]
            other = sketch(edited) if edited != text else own
            return doc, len(text), edited, as_hex(own), as_hex(other), sketch.likeness(own, other), sketch.likeness(own, after[2])

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], names=kind.names)

        fields: list = []
        for batch in blocks(batches, "text"):
            fields = [pa.field("id", batch.schema.field("id").type), *map(lambda t: pa.field("", t), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            out = []
            for doc, text, extra in zip(column(batch, "id"), column(batch, "text"), column(batch, "_extra"), strict=True):
                if extra and (last is None or last[3]):
                    continue  # the row after the range is known, or the range has no row
                row = (doc, text or "", sketch(text), extra)
                if last is not None:
                    out.append(told(last[:3], row[:3]))
                begin, last = begin or row, row
            if out:
                yield batch_of(out)
        if last is not None and not last[3]:  # no row follows: there is one range, which ends where it began
            yield batch_of([told(last[:3], begin[:3])])

    return rows.mapInArrow(run, kind)
