"""Files of token ids: frequency ranks in byte-aligned variable-length coding.

A folder holds ``ranks`` (a table of the ids in order of their ranks) and
``tokens`` (the files), so it can be read with nothing else at hand. A file
holds a head (``HEAD``), its documents' ids (8 bytes each), flags (1 byte each,
1 where the id is null), numbers of tokens (8 bytes each), the control bytes of
all documents, their data bytes, and at last a line end, which does not count.
Both are written and read by Spark, so on any store that it knows, and a task
that runs again leaves no second file. A
control byte has two bits for each of four tokens, lowest first: the number of
the token's data bytes less one. Data bytes are the token's rank by frequency,
lowest byte first, so the 256 most frequent ids take one byte and two bits. A
document starts on a control byte; up to three zero ranks fill its last one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import array, blocks, column, id_ranges, in_id_order, kept, materialize, parts_of, release, scratch
from .tokens import TextEncoder

MAGIC = b"TKRANK2\0"
#: After the magic, 8 bytes each, highest first. ``before``: tokens of the part's earlier files; ``order``: CRC-32 of the ids by rank, 4 bytes each.
FIELDS = ("part", "number", "before", "docs", "tokens", "controls", "size", "order")
HEAD = f">8s{len(FIELDS)}Q"
#: By control byte: the lengths of its four tokens.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
#: By control byte: where its tokens' bytes start, and how many there are.
STARTS = np.cumsum(LENGTHS, 1, np.int64) - LENGTHS
TOTALS = LENGTHS.sum(1, dtype=np.int64)


def put(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and each rank's number of data bytes; a multiple of four ranks."""
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    code = (size - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    data[start] = ranks
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        data[start[longer] + k] = ranks[longer] >> np.uint32(8 * k)
    return control.astype(np.uint8), data, size


def get(control: np.ndarray, data: np.ndarray, step: int = 1 << 14) -> Iterator[np.ndarray]:
    """The ranks, four for each control byte, in blocks of ``step`` control bytes."""
    at = 0
    for first in range(0, len(control), step):
        codes = control[first : first + step]
        size, total = LENGTHS[codes].reshape(-1), TOTALS[codes]
        ends = np.cumsum(total)
        own = data[at : at + int(ends[-1])]
        start = ((ends - total)[:, None] + STARTS[codes]).reshape(-1)
        rank = own[start].astype(np.uint32)
        for k in range(1, int(size.max())):
            longer = np.flatnonzero(size > k)
            rank[longer] |= own[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        yield rank
        at += int(ends[-1])


def _binary(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of bytes cut at bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(parts).view(np.uint8).tobytes())])


def encoded(docs: DataFrame, tokenizer: str, end_id: int, special: bool = False) -> DataFrame:
    """``id``, ``n`` and ``ids`` of each document; a task's last row has ``counts`` of all its ids.

    ``ids`` are 16-bit numbers if the vocabulary allows, else 32-bit;
    ``counts`` are 64-bit, by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"{tokenizer} {special}", lambda: TextEncoder(tokenizer, special=special))
        kind = np.dtype(_kind(encoder.n_ids))
        total = np.zeros(encoder.n_ids, np.int64)
        names = ["id", "n", "ids", "counts"]
        for batch in blocks(batches, "text"):
            ids, n = encoder.encode(array(batch, "text"), end_id)
            total += np.bincount(ids, minlength=len(total))
            bounds = np.concatenate([[0], np.cumsum(n)]) * kind.itemsize
            yield pa.RecordBatch.from_arrays([array(batch, "id"), pa.array(n.astype(np.int64)), _binary(ids.astype(kind), bounds), pa.nulls(len(n), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return docs.mapInArrow(run, "id long, n long, ids binary, counts binary")


def _kind(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def frequency_order(coded: DataFrame) -> np.ndarray:
    """Ids from the most frequent on, ties by id; as many as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in array(batch, "counts"):
                n = np.frombuffer(counts.as_buffer(), np.int64)
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["token", "n"])

    counted = coded.where("counts is not null").select("counts").mapInArrow(run, "token long, n long")
    rows = sorted(counted.groupBy("token").agg(F.sum("n").alias("n")).collect(), key=lambda r: (-r.n, r.token))
    return np.array([r.token for r in rows], np.uint32)


def ranked(coded: DataFrame, order: Broadcast, n_ids: int) -> DataFrame:
    """Documents with their ``control`` and ``data`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(n_ids, np.uint32)
        rank[order.value] = np.arange(len(order.value))
        for batch in blocks(batches, "ids", 1 << 20):
            n = array(batch, "n").to_numpy()
            ids = np.frombuffer(b"".join(column(batch, "ids")), _kind(n_ids))
            full = -(-n // 4) * 4
            ranks = np.zeros(int(full.sum()), np.uint32)
            ranks[np.arange(len(ids)) + np.repeat(np.cumsum(full - n) - (full - n), n)] = rank[ids]
            control, data, size = put(ranks)
            ends = np.concatenate([[0], np.cumsum(full)])
            bytes_to = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([array(batch, "id"), array(batch, "n"), _binary(control, ends // 4), _binary(data, bytes_to[ends])], names=["id", "n", "control", "data"])

    return coded.where("counts is null").select("id", "n", "ids").mapInArrow(run, "id long, n long, control binary, data binary")


def _checksum(order: np.ndarray) -> int:
    return zlib.crc32(order.astype("<u4").tobytes())


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1_000_000, special: bool = False) -> str:
    """Writes all documents' ids, in ascending order of ``id_col``, into ``folder`` and returns that.

    ``folder`` is a new one that all executors reach, by default in the shared
    checkpoint folder, from where it goes with the driver. The texts are
    encoded once, into a table of ids, and the ids counted on the way. Coded
    by rank, documents are dealt into ranges of ``id_col`` by one shuffle,
    sorted and written, a range's files being closed at ``file_tokens`` tokens
    (a document stays whole, however long).

    Ids of documents are whole numbers (others are an error). A null text is
    an empty one; null ids come last; documents with equal ids are ordered by
    their bytes; no rows give no files; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    coded = encoded(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), tokenizer, end_id, special)
    coded = materialize(coded, "token-ids", batch=500)
    order = frequency_order(coded)
    crc = _checksum(order)
    shared = spark.sparkContext.broadcast(order)  # no longer than the vocabulary
    sorted_docs, _ = in_id_order(ranked(coded, shared, TextEncoder(tokenizer).n_ids), "id", "data", bounds=id_ranges(coded.where("counts is null"), "id", parts_of(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held = 0, 0, 0, 0
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal rows, held, number, before
            ids, n, control, data = zip(*rows, strict=True)
            head = struct.pack(HEAD, MAGIC, part, number, before, len(rows), held, sum(map(len, control)), sum(map(len, data)), crc)
            lists = np.array([x if x is not None else 0 for x in ids], "<i8").tobytes() + bytes(x is None for x in ids) + np.array(n, "<i8").tobytes()
            file = pa.array([b"".join((head, lists, *control, *data))], pa.binary())
            rows, number, before, held = [], number + 1, before + held, 0
            return pa.RecordBatch.from_arrays([file], names=["file"])

        for batch in batches:
            for part, *row in zip(*(column(batch, c) for c in ("_part", "id", "n", "control", "data")), strict=True):
                rows.append(tuple(row))
                held += row[1]
                if held >= file_tokens:
                    yield close()
        if rows:
            yield close()

    # The text writer puts bytes as they are, a row to a file here, and a line end after it.
    files = sorted_docs.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(f"{folder}/tokens")
    ranks = pa.table({"rank": pa.array(np.arange(len(order))), "token": pa.array(order.astype(np.int64))})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{folder}/ranks")
    release(coded)
    return folder


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder: what their heads say (``FIELDS``), and their ``content``."""
    files = spark.read.format("binaryFile").load(f"{folder}/tokens").where(F.col("length") > struct.calcsize(HEAD)).select("path", "content")
    number = lambda i: F.conv(F.hex(F.substring("content", 9 + 8 * i, 8)), 16, 10).cast("long")
    return files.select("path", *(number(i).alias(f) for i, f in enumerate(FIELDS)), "content")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the files of :func:`write_token_files` hold them.

    ``doc_id``, ``start`` (ids of all documents before it, over all files),
    ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit). Files that
    were written with other ranks than the folder's, or are none, are an error.
    """
    ranks = spark.read.parquet(f"{folder}/ranks").toArrow().sort_by("rank")  # no longer than the vocabulary
    order = ranks["token"].to_numpy().astype(np.uint32)
    crc = _checksum(order)
    files = token_files(spark, folder)
    # A row for each range of the writer, so bounded by its number of tasks.
    base, at = [], 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("tokens")).collect()):
        base.append((part, at))
        at += n
    starts = spark.createDataFrame(pa.table({"part": pa.array([p for p, _ in base], pa.int64()), "base": pa.array([b for _, b in base], pa.int64())}))
    files = files.join(starts, "part").select("path", "content", (F.col("base") + F.col("before")).alias("base"))
    shared = spark.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, first in zip(column(batch, "path"), array(batch, "content"), column(batch, "base"), strict=True):
                raw = content.as_buffer()
                magic, *head = struct.unpack_from(HEAD, raw)
                _, _, _, docs, _, controls, size, own = head
                if magic != MAGIC or own != crc:
                    raise ValueError(f"{path} is not a file of token ids with these ranks")
                at = struct.calcsize(HEAD)
                ids = np.frombuffer(raw, "<i8", docs, at)
                null = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs).astype(bool)
                n = np.frombuffer(raw, "<i8", docs, at := at + docs)
                control = np.frombuffer(raw, np.uint8, controls, at := at + 8 * docs)
                data = np.frombuffer(raw, np.uint8, size, at + controls)
                out = np.empty(4 * controls, "<u4")
                done = 0
                for block in get(control, data):
                    out[done : done + len(block)] = shared.value[block]
                    done += len(block)
                full = -(-n // 4) * 4
                if (full != n).any():  # take out what fills the control bytes
                    out = out[np.arange(int(n.sum())) + np.repeat(np.cumsum(full - n) - (full - n), n)]
                ends = np.cumsum(n)
                # Arrow's binary offsets are 32-bit: some rows at a time.
                step = max(1, int(docs * (4 << 20) / max(1, len(out))))
                for i in range(0, docs, step):
                    j = min(docs, i + step)
                    low = int(ends[i] - n[i])
                    offsets = np.concatenate([[0], ends[i:j] - low]) * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[i:j], pa.int64(), mask=null[i:j]),
                            pa.array(first + ends[i:j] - n[i:j]),
                            pa.array(n[i:j].astype(np.int64)),
                            pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out[low : int(ends[j - 1])].tobytes())]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
