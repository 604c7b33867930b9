"""Fingerprints, token files, token counts, sharding and packing."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pathloom.llm")
from pathloom.llm import fingerprints, packing, queries, sharding, token_counts, token_files  # noqa: E402
from pathloom.llm.tokens import TextEncoder  # noqa: E402

LONG = "lorem ipsum dolor " * 4000 + "x" * 5000
TEXTS = ["", None, "a", "one two", "One  two,\nthree . ", LONG, "same text here", "same text here", " é ́x <|endoftext|> 'S don't", "日本語 テキスト。", "\t \n", "w" * 3000, "a b　c \x1c d"]


def documents(spark, texts=TEXTS, ids=None):
    """Texts with repeated and null ids, and columns whose names the operators use themselves."""
    ids = ids or [*range(len(texts))]
    rows = [(i, t, "en", s, 1, "x", 2, 3) for i, t, s in zip(ids, texts, ["b", "a", None, "b"] * len(texts), strict=False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part int, ids string, n long, _part long").repartition(3)


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    encoder, library = TextEncoder(queries.tokenizer_path(name), max_words=40), tokenizer(name)
    for texts in (TEXTS, TEXTS[::-1], [], [None], ["a  b", " ", "x, y. z! (q) 12,3"], TEXTS):  # the store overflows and is thinned
        ids, n = encoder.encode(pa.array(texts, pa.string()), 2)
        expected = [library.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
        assert n.tolist() == [len(x) for x in expected] and ids.tolist() == [y for x in expected for y in x]
        assert encoder.count(pa.array(texts, pa.string()), 2).tolist() == np.bincount(ids, minlength=encoder.n_ids).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_untouched_library(name):
    from tokenizers import Tokenizer

    encoder, library = TextEncoder(queries.tokenizer_path(name), special=True), Tokenizer.from_file(queries.tokenizer_path(name))
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>y  z", "a <|ENDOFTEXT|> b", None]
    expected = [library.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts, pa.string()), 2)
        assert n.tolist() == [len(x) for x in expected] and ids.tolist() == [y for x in expected for y in x]
    assert encoder.count(pa.array(texts, pa.string()), 2).tolist() == np.bincount(ids, minlength=encoder.n_ids).tolist()
    assert library.token_to_id("<|endoftext|>") in ids


@pytest.mark.parametrize("query", ["op3_token_files", "op10_packing"])
def test_queries_keep_added_tokens(spark, tmp_path, query):
    from tokenizers import Tokenizer

    documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json" if query == "op3_token_files" else "word_bpe_49k.json"))
    got = {r[0]: r[1] for r in queries.queries()[query](spark, str(tmp_path)).select("doc_id", "n_tokens" if query == "op3_token_files" else "doc_tokens").collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 4, 8, 1000):
        ranks = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        control, data, size = token_files.put(ranks)
        assert [x for b in token_files.get(control, data, 2) for x in b.tolist()] == ranks.tolist() and len(control) == n // 4
        size = size.astype(int)
        assert size.tolist() == [max(1, -(-int(x).bit_length() // 8)) for x in ranks] and len(data) == size.sum()
        at = 0
        for i, x in enumerate(ranks.tolist()):
            assert (control[i // 4] >> (2 * (i % 4)) & 3) + 1 == size[i] and int.from_bytes(data[at : at + int(size[i])].tobytes(), "little") == x
            at += int(size[i])


def test_token_files(spark):
    docs = documents(spark, ids=[None if i == 3 else i * 7 % 11 for i in range(len(TEXTS))])
    folder = token_files.write_token_files(docs, queries.tokenizer_path("byte_bpe_50k.json"), 2, file_tokens=50)
    # Another session reads the folder with nothing else at hand.
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_token_files(spark.newSession(), folder).collect()))
    library = tokenizer("byte_bpe_50k.json")
    whole = sorted((r.doc_id is None, r.doc_id or 0, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in docs.collect())
    assert [(d is None, d or 0) for _, d, _, _ in got] == [r[:2] for r in whole]
    assert sorted((d is None, d or 0, ids) for _, d, _, ids in got) == whole
    assert [(s, 4 * n) for s, _, n, _ in got] == [(sum(len(x[3]) for x in got[:i]) // 4, len(r[3])) for i, r in enumerate(got)]
    files = token_files.token_files(spark, folder)
    assert files.count() > 1 and files.agg(F.sum("tokens")).first()[0] == sum(n for _, _, n, _ in got)
    empty = token_files.write_token_files(docs.limit(0), queries.tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_know_their_ranks(spark):
    folders = [token_files.write_token_files(documents(spark, texts), queries.tokenizer_path("byte_bpe_50k.json")) for texts in (["a b"], ["c d e"])]
    spark.read.parquet(f"{folders[0]}/ranks").write.mode("overwrite").parquet(f"{folders[1]}/ranks")
    with pytest.raises(Exception, match="with these ranks"):
        token_files.read_token_files(spark, folders[1]).collect()


@pytest.mark.parametrize("query", ["op1_fingerprints", "op3_token_files", "op10_packing"])
def test_queries_return_what_they_promise(spark, tmp_path, query):
    """The columns that the queries themselves make, from the texts alone."""
    from tokenizers import Tokenizer

    documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()[query](spark, str(tmp_path)).collect()
    if query == "op1_fingerprints":
        for r in got:
            text, after = TEXTS[r.doc_id] or "", TEXTS[(r.doc_id + 1) % len(TEXTS)] or ""
            cut = len(text) // 4
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
        assert len(got) == len(TEXTS)
        return
    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json" if query == "op3_token_files" else "word_bpe_49k.json"))
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in TEXTS]
    if query == "op3_token_files":
        starts = np.cumsum([0, *map(len, ids)]).tolist()
        assert sorted(tuple(r) for r in got) == [(i, starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    else:
        assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in got)
        assert sum(r.length for r in got) == sum(map(len, ids))


def test_packing_of_null_and_repeated_ids(spark):
    texts = ["one two", None, "three four five", "one two", ""]
    docs = documents(spark, texts, [None, 3, 3, None, 3])
    library = tokenizer("word_bpe_49k.json")
    expected = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    pieces = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), 4096).collect()
    assert sorted(r.length for r in pieces) == expected and sum(r.doc_id is None for r in pieces) == 2
    assert sorted((r.offset, r.length) for r in pieces)[-1][0] + sorted((r.offset, r.length) for r in pieces)[-1][1] == sum(expected)


def test_packing(spark):
    docs = documents(spark)
    library = tokenizer("word_bpe_49k.json")
    pieces = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), 64).withColumn("crc", F.crc32("ids")).collect()
    whole = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    found, sequences = {k: [] for k in whole}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.doc_tokens == len(whole[p.doc_id]) and p.crc == zlib.crc32(p.ids)
        found[p.doc_id].append((p.start, ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {k: [x for _, v in sorted(s) for x in v] for k, s in found.items()} == whole
    filled = []
    for _, s in sorted(sequences.items()):
        assert [o for o, _ in sorted(s)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(s)])[:-1]]).tolist()
        filled.append(sum(n for _, n in s))
    assert sorted(sequences) == [*range(len(sequences))] and {*filled[:-1]} == {64} and 0 < filled[-1] <= 64
    assert packing.pack(docs.limit(0), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("pieces", [None, [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("c▁", -9.0), *((f"<0x{i:02X}>", -5.0) for i in range(256))]])
def test_token_counts_equal_the_library(spark, pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocab = pieces or token_counts.vocabulary(path)
    library = Tokenizer(models.Unigram(vocab, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    rng = np.random.default_rng(0)
    texts = [t for t in TEXTS if t != ""] + ["".join(rng.choice(list("abc ▁é漢"), 30)) for _ in range(60)] + [""]
    docs = documents(spark, texts)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, pieces or path).collect()}
    for i, text in enumerate(texts):
        assert got[i] == (len(library.encode(text, add_special_tokens=False).ids) if text else 0), text
    assert token_counts.count_tokens(docs, pieces or path).columns[: len(docs.columns)] == docs.columns


def test_control_pieces_are_no_text(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    pieces = dict(token_counts.text_pieces(path))
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & set(pieces) and len(pieces) > 31_000
    counter = token_counts.UnigramCounter(token_counts.text_pieces(path))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, ["a <s> b", "<0x41>"]), path).collect()}
    assert got == {0: counter.text("a <s> b"), 1: counter.text("<0x41>")} and got[1] > 2
    assert token_counts.count_tokens(documents(spark).limit(0), path).count() == 0


def test_sharding(spark):
    shards, size = [f"s{i}" for i in range(5)], 101
    docs = documents(spark, ids=[None, *range(len(TEXTS) - 1)])
    table = sharding.lookup_table(shards, size)
    assert max(table.count(i) for i in range(5)) - min(table.count(i) for i in range(5)) <= 1
    for r in sharding.shard(docs, "doc_id", shards, size).collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % size
        assert (r.slot, r.shard) == (slot, shards[table[slot]]) and r.part == 1
    # The table by plain turns over whole orders of preference.
    orders = [[(sharding.hashed(f"{s}/offset") + j * (sharding.hashed(f"{s}/step") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    taken, turn = {}, 0
    while len(taken) < size:
        taken[next(x for x in orders[turn % 5] if x not in taken)] = turn % 5
        turn += 1
    assert [taken[i] for i in range(size)] == table
    fewer = sharding.lookup_table(shards[:-1], size)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 4) < size // 3
    assert sharding.shard(docs.limit(0), "doc_id", shards, size).count() == 0
    for bad in ((shards, 100), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def plain_order_minhash(sketch, text):
    """The definition, k-mer by k-mer."""
    if not text:
        return [0] * sketch.slots
    names = sketch.kmers(np.array([ord(c) for c in text], np.uint32)) >> np.uint64(24)
    times, rows = {}, []
    for place, name in enumerate(names.tolist()):
        times[name] = number = times.get(name, -1) + 1
        x = fingerprints.mix64(np.array([(name + number * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]
        rows.append((name, place, int(x) >> 32))
    out = []
    for s in range(sketch.slots):
        low = sorted(rows, key=lambda r: (((r[2] ^ int(sketch.xor[s])) * int(sketch.mul[s])) % (1 << 32), r[0], r[1]))[:2]
        low.sort(key=lambda r: r[1])
        pair = low[0][2] << 32 | low[1][2] if len(low) > 1 else low[0][2]
        out.append(int(fingerprints.mix64(np.array([pair ^ int(sketch.salt[s])], np.uint64))[0]) >> 32 | 1)
    return out


def test_order_minhash():
    sketch = fingerprints.OrderMinHash(k=4, slots=16)
    for text in ["", "a", "abc", "abcd", "abcde", "aaaaaaaaaaaa", "the cat sat on the mat and the cat slept", "日本語テキスト日本語", "x" * 300]:
        assert sketch(text).tolist() == plain_order_minhash(sketch, text)
    wide = fingerprints.OrderMinHash(k=6, slots=256)
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefgh "), 2000))
    small, large = text[:1900] + "z" * 100, text[:1000] + "".join(rng.choice(list("abcdefgh "), 1000))
    swapped = text[1000:] + text[:1000]
    near = lambda x: wide.likeness(wide(text), wide(x))
    assert near(text) == 1 and near(small) > near(large) > near("".join(rng.choice(list("ijkl"), 2000))) == 0
    assert near(swapped) < 0.7  # the same k-mers but few, in another order


@pytest.mark.parametrize("ids", [None, "null", "one"])
def test_edited_neighbours(spark, ids):
    texts = TEXTS + [f"document number {i} " * (i + 1) for i in range(20)] if ids != "one" else ["abcdefgh"]
    numbers = [None if ids == "null" and i in (2, 5) else (i * 17) % 101 for i in range(len(texts))]
    docs = documents(spark, texts, numbers)
    rows = sorted(zip(numbers, texts, strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    sketch = fingerprints.OrderMinHash()
    expected = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        expected.append((doc, len(text), edited, fingerprints.as_hex(a), fingerprints.as_hex(b), sketch.likeness(a, b), sketch.likeness(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = [tuple(r) for r in fingerprints.edited_neighbours(docs).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()} == {r[0]: r[3] for r in expected} or ids == "null"
    assert fingerprints.edited_neighbours(docs.limit(0)).count() == 0


def test_scratch_tables_can_go(spark):
    import os

    from pathloom.llm import common

    table = common.materialize(spark.range(3), "some")
    path = common.written[-1].removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(path)
    common.release(common.materialize(spark.range(2), "other"))
    assert common.written[-1].removeprefix("file://") == path
    common.discard(spark)
    assert not os.path.exists(path) and not common.written


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from pathloom.llm import common

    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://far:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(far, "x")


def test_batches_leave_the_session_as_it_was(spark):
    from pathloom.llm import common

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = common.materialize(spark.range(0, 50, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long"), "sizes", batch=7)
    assert max(r.n for r in sizes.collect()) == 7 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_spread(spark, how, monkeypatch):
    from collections import Counter

    from pathloom.llm import common

    monkeypatch.setattr(common, "FREQUENT", 4)
    monkeypatch.setattr(common, "WEIGHTY", 0)
    left = [(1, i) for i in range(90)] + [(2, i) for i in range(10)] + [(3, 0), (None, 1), (9, 9)]
    right = [(k, f"v{k}", n) for k, n in Counter(k for k, _ in left if k not in (None, 9)).items()]
    got = common.join_spread(spark.createDataFrame(left, "k long, x long"), spark.createDataFrame(right, "k long, v string, held long"), ["k"], how)
    assert got.columns == ["k", "x", "v"]
    assert Counter(map(tuple, got.collect())) == Counter((k, x, f"v{k}" if k not in (None, 9) else None) for k, x in left if how == "left" or k not in (None, 9))


@pytest.mark.parametrize("n", [0, 1, 2, 10, 101])
def test_place_among_bounds(spark, n):
    from bisect import bisect_right

    from pathloom.llm import common

    bounds = [3 * i + 1 for i in range(n)]
    assert all(r.at == bisect_right(bounds, r.id) for r in spark.range(-2, 3 * n + 5).select("id", common._place(F.col("id"), bounds).alias("at")).collect())
