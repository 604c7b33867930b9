"""Near-duplicates, mixing, quality, URL filters, nearest neighbours, the pipeline."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pathloom.llm")
from pathloom.llm import ann, mixing, near_dedup, quality, shingles, url_filter  # noqa: E402
from pathloom.llm import components as linking  # noqa: E402
from pathloom.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, source), with columns named as the operators name theirs."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 9, "k", 1, 2.0) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, size long, key string, n long, component double").repartition(3)


def word_set(text, width=5):
    words = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def grouped(rows, percent):
    """Groups by comparing all pairs."""
    sets, own = [word_set(t) for _, t in rows], {d: d for d, _ in rows if d is not None}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((find(rows[i][0]), find(rows[j][0])))
                own[high] = low
    name = lambda d, s: find(d) if s else d  # an empty text is linked with nothing
    return sorted((d if d is not None else -1, len(s), name(d, s) if d is not None else -1, d is None or name(d, s) == d) for (d, _), s in zip(rows, sets, strict=True))


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent, block", [(80, 256), (85, 8)])
def test_near_duplicates(spark, percent, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(percent)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = ["", None, " \t\n", "one two", "One\vTWO", "one two three", "ÀB c d e f", "àb c d e f", "a b c d e", "A B C D E"]
    for n, size, edits in ((40, 120, 4), (25, 60, 3), (12, 30, 1), (10, 400, 12), (6, 8, 1)):
        texts += copies(rng, text(size), n, edits)
    passage = text(60)
    texts += [text(5) + " " + passage + " " + text(rng.randint(3, 12)) for _ in range(25)] + [text(40) for _ in range(30)]
    texts += ["same words over and over again here"] * 5 + [" ".join(f"v{i}" for i in range(20_000))] * 2
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, texts[12]), (None, "x y z x y z")]
    got = near_dedup.near_duplicates(documents(spark, rows), percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[0] is not None else -1, r[3]) for r in got.collect())
    assert found == grouped(rows, percent)


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_marks_of_rows(spark, most, monkeypatch):
    from pathloom.llm import common

    monkeypatch.setattr(common, "BITMAPS", most)
    rows = spark.range(0, 100_000, 1, 3).select(F.monotonically_increasing_id().alias("r"), F.lit("t").alias("block"), F.col("id").alias("spot"))
    value = F.when(F.col("spot") % 7 == 0, 3).when(F.col("spot") >= 99_990, 2).otherwise((F.col("spot") % 32_768 == 5).cast("int"))
    marks = rows.select("r", value.alias("m"))
    got = common.with_marks(rows, marks, "r", "m", 2)
    assert got.columns == ["r", "block", "spot", "m"]
    assert got.count() == 100_000 and got.where(F.col("m") != value).count() == 0
    assert got.where("m > 0").count() > 14_000
    assert common.with_marks(rows, marks.limit(0), "r", "m").agg(F.max("m"), F.count("*")).first() == (0, 100_000)
    assert common.with_marks(rows.limit(0), marks, "r", "m", 2).count() == 0


@pytest.mark.parametrize("most", [64 << 20, 4096, 1])
def test_likely_rows(spark, most, monkeypatch):
    from pathloom.llm import common

    monkeypatch.setattr(common, "BITMAPS", most)
    rows = spark.range(0, 40_000, 1, 3).select((F.col("id") % 20_000).alias("a"), F.when(F.col("id") % 100 > 0, F.col("id") % 7).alias("b"), F.col("id").alias("n"))
    wanted = rows.where("n % 50 = 1").select("a", "b").distinct()
    got = common.likely(rows, wanted, ["a", "b"])
    assert got.columns == ["a", "b", "n"]
    right = rows.join(wanted, ["a", "b"], "left_semi")
    assert right.exceptAll(got).count() == 0 and got.exceptAll(rows).count() == 0
    # One in 32 of the others at most stays, if there are bits enough; here 50 in 32,768 keys for 800 of them.
    assert right.count() <= got.count() < right.count() + 40_000 / (30 if most > 1 else 20)
    assert common.likely(rows, wanted.limit(0), ["a", "b"]).count() == 0
    assert common.likely(rows.limit(0), wanted, ["a", "b"]).count() == 0


def test_near_duplicates_move_texts_of_clusters_only(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [text(40) for _ in range(600)] + [x for n in (40, 60) for x in copies(rng, text(n), 8, 2)]
    texts += texts[600:608] * 3 + texts[:1] * 50
    rows = list(enumerate(rng.sample(texts, len(texts))))
    moved, join = [], near_dedup.join_spread

    def counted(left, right, *more, **named):
        if "text" in left.columns:
            moved.append(left.count())
        return join(left, right, *more, **named)

    monkeypatch.setattr(near_dedup, "join_spread", counted)
    got = near_dedup.near_duplicates(documents(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == grouped(rows, 80)
    assert len(moved) == 1 and moved[0] < 60  # 16 texts are clustered at most, of 690


def test_blocks_of_a_cluster_are_dealt_evenly(spark):
    shingle = lambda n: np.array([n], np.uint64).tobytes()
    rows = [(i, bytearray(shingle(i // 2)), 1 << 60, i // 2, i, True) for i in range(32)]
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "16")
    try:
        dealt = spark.createDataFrame(rows, "node long, shingles binary, cluster long, block int, component long, asks boolean")
        found = near_dedup.in_blocks(dealt, ["cluster", "block"], 80).select("u", "v", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted((r.u, r.v) for r in found) == [(i, i + 1) for i in range(0, 32, 2)]
    assert len({r.part for r in found}) == 16


def test_components_of_a_million_links():
    rng = np.random.default_rng(2)
    order = rng.permutation(400_000) * 7
    chain = np.stack([order[:-1], order[1:]])[:, rng.permutation(399_999)]
    spokes = np.stack([np.full(600_000, 4 << 30), (4 << 30) + 1 + np.arange(600_000)])
    nodes, found = linking.smallest(*np.concatenate([chain, spokes], 1))
    assert len(nodes) == 1_000_001
    assert np.array_equal(found, np.where(nodes < 4 << 30, 0, 4 << 30))


@pytest.mark.parametrize("frequent", [1000, 5])
def test_near_duplicates_with_repeated_ids(spark, frequent, monkeypatch):
    from pathloom.llm import common, components

    monkeypatch.setattr(common, "FREQUENT", frequent)
    if frequent == 5:  # some keys count as frequent in tables as small as these
        monkeypatch.setattr(common, "WEIGHTY", 0)
        monkeypatch.setattr(components, "WEIGHTY", 0)
        monkeypatch.setattr(components, "FEW", -1)
    rng = random.Random(frequent)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    a, c, d = text(40), text(50), text(30)
    rows = [(5, a), (9, a), (9, c), (3, c), (1, None), (1, d), (20, d), (20, ""), (7, a), (7, a), (None, a), (None, None)]
    texts = [x for n in range(6) for x in copies(rng, text(60), 6, 4)]
    rows += [(rng.randrange(100, 125), t) for t in texts] + [(200, text(20)) for _ in range(15)]
    got = near_dedup.near_duplicates(documents(spark, rows))
    found = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[0] is not None else -1, r[3]) for r in got.collect())
    assert found == grouped(rows, 80)
    assert {r.component_id for r in got.where("doc_id in (3, 5, 7, 9)").collect()} == {3}
    # With numbered rows one row stays of each component, and all of empty texts or null ids.
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string")
    kept = [rows[r.n] for r in near_dedup.near_duplicates(numbered, row_col="n").where("kept").collect()]
    named = [x for x in kept if x[0] is not None and word_set(x[1])]
    assert sorted(x for x, _ in named) == sorted({c for i, n, c, _ in grouped(rows, 80) if n and i >= 0})
    assert Counter(x for x in kept if x not in named) == Counter(x for x in rows if x[0] is None or not word_set(x[1]))


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(documents(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for shared in (0, 300, 800, 950):
        errors = []
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, 2000, np.uint64) * np.uint64(2))
            a, b = np.sort(x[rng.permutation(len(x))])[:1000], None
            b = np.sort(np.concatenate([a[rng.permutation(1000)[:shared]], rng.integers(0, 1 << 63, 1000 - shared, np.uint64)]))
            a = a * np.uint64(1)
            a, b = (np.sort(shingles.mix64(v)) for v in (a, b))
            e = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([1000]), np.array([1000]))[0]
            errors.append(e - shared / (2000 - shared))
        assert abs(np.mean(errors)) < 0.03
    assert not near_dedup.registers(np.zeros(0, np.uint64)).any()
    small = np.sort(np.array([1, 31, 32, 1 << 57, (1 << 57) + 1, (1 << 64) - 1], np.uint64))
    for bucket, value in {int(v) >> 57: int(v) & ((1 << 57) - 1) for v in small[::-1].tolist()}.items():
        zeros = 57 - value.bit_length()
        tail = (value << 10 >> (value.bit_length() - 1)) & 1023 if value else 0
        assert near_dedup.registers(small)[bucket] == ((zeros + 1) << 10 | tail)


@pytest.mark.parametrize("few", [linking.FEW, 60, -1])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(linking, "FEW", few)
    rng = random.Random(4)
    for n, m in ((30, 25), (200, 180), (50, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)] * (m > 0)
        own = {x: x for e in links for x in e}
        for _ in range(len(own)):
            for a, b in links:
                own[a] = own[b] = min(own[a], own[b])
        expected = {x: c for x, c in own.items() if any(a != b and x in (a, b) for a, b in links)}
        df = spark.createDataFrame([*links, *links[:3], (None, 1)] if links else [], "u long, v long")
        assert {r.node: r.component for r in components(df).collect()} == expected


def test_targets_share_everything():
    sizes = {"b": 100, "a": 10, None: 50, "é": 1000, "z": 0}
    got = mixing.targets(sizes, (5, 2, 1), 3)
    assert list(got) == ["a", "b", "z", "é", None]
    assert sum(got.values()) == pytest.approx(1160) and got["a"] == 30 and got["z"] == 0 and got[None] == 150
    weight = dict(zip(got, (5, 2, 1, 5, 2), strict=True))
    free = [s for s in got if got[s] < 3 * sizes[s]]
    assert len({round(got[s] / weight[s], 9) for s in free}) == 1
    assert mixing.targets({}, (5, 2, 1), 3) == {} and mixing.targets({"a": 0}, (1,), 3) == {"a": 0.0}


def test_fit_finds_the_nearest_sum():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.choice(np.arange(0, 40), rng.integers(1, 6), replace=False)
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        reach = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {x + size * k for x in reach for k in range(n + 1)}
        assert abs(int((lengths * take).sum()) - budget) == min(abs(x - budget) for x in reach)
    lengths, counts = np.arange(1, 3000), rng.integers(1, 10**6, 2999)
    budget = int((lengths * counts).sum() * 0.37)
    assert (lengths * mixing.fit(lengths, counts, budget)).sum() == budget


@pytest.mark.parametrize("n", [500, 50_000])
def test_fit_takes_alike_at_every_length(n):
    rng = np.random.default_rng(n)
    lengths, counts = np.unique(np.clip(np.exp(rng.normal(5.2, 1.2, n)), 1, 20_000).astype(np.int64), return_counts=True)
    budget = int((lengths * counts).sum() * 0.3)
    long = np.cumsum(counts) > n / 2
    takes = [mixing.fit(lengths, counts, budget, seed=s) for s in (7, 8, 9)]
    for take in takes:
        assert (take <= counts).all() and (lengths * take).sum() == budget
        assert abs(take[long].sum() / counts[long].sum() - take[~long].sum() / counts[~long].sum()) < 0.06
        single = counts == 1
        assert 0.15 < take[single].sum() / single.sum() < 0.45
    assert (takes[0] != takes[1]).any()


def test_fit_of_many_lengths_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    lengths, counts = rng.permutation(np.arange(1, 60_001)), np.ones(60_000, np.int64)
    budget = int(lengths.sum() * 0.4)
    tracemalloc.start()
    take = mixing.fit(lengths, counts, budget)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (lengths * take).sum() == budget and peak < 100 << 20


def test_mix_takes_alike_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    off = (rows.groupby("source").taken.sum() - rows.groupby("source").target.first()).abs()
    assert off.max() <= 1
    for _, own in rows[rows["size"] > 0].groupby("source"):
        rest = own["copies"] - own["copies"].min()  # beyond what all of them are taken
        quarter = (own["size"].rank(method="first") * 4 / (len(own) + 1)).astype(int)
        shares = rest.groupby(quarter).mean()
        assert shares.max() - shares.min() < 0.05 + 3 / len(own) ** 0.5 / 4, own.source.iloc[0]


def test_fit_of_few_long_documents():
    assert (np.array([120_000, 100_000, 100_001]) * mixing.fit(np.array([120_000, 100_000, 100_001]), np.ones(3, int), 200_001)).sum() == 200_001
    rng = np.random.default_rng(6)
    for _ in range(10):
        lengths = np.unique(rng.integers(60_000, 300_000, 10))
        budget, sums = int(lengths.sum() * rng.uniform(0.1, 0.9)), np.zeros(1, np.int64)
        for size in lengths:
            sums = np.concatenate([sums, sums + size])
        take = mixing.fit(lengths, np.ones(len(lengths), int), budget)
        assert take.max() <= 1 and abs((lengths * take).sum() - budget) == abs(sums - budget).min()
    lengths, counts = np.array([100_000, 100_001]), np.array([40, 40])  # more than are first given back
    for over in range(25, 40):
        assert (lengths * mixing.fit(lengths, counts, 40 * 100_000 + over)).sum() == 40 * 100_000 + over


def test_mix(spark):
    rng = random.Random(1)
    sources = ["b", "a", None, "é", "big"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 1, 3, 7, 50)))), rng.choice(sources)) for i in range(400)]
    rows += [(1000 + i, "five words in this text", "big") for i in range(500)] + [(None, "x y", "a"), (7, None, "a"), (8, "w\x0bw\x1cw", None), (8, "w\x0bw\x1cw", None), (9, "x " * 20_000, "big")]
    got = mixing.mix(documents(spark, rows)).collect()
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    plain = lambda rs: Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in rs)
    assert plain(got) == plain(again)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, s in rows)
    sizes = Counter()
    for d, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = mixing.targets(dict(sizes), (5, 2, 1), 3)
    for s in sources:
        own = [r for r in got if r.source == s]
        assert {(r.source_size, r.target) for r in own} == {(sizes[s], target[s])}
        reach = 1  # all sums that up to three copies of each document give
        for size in [r.size for r in own for _ in range(3)]:
            reach |= reach << size
        nearest = min(abs(x - target[s]) for x in range(reach.bit_length()) if reach >> x & 1)
        assert abs(sum(r.taken for r in own) - target[s]) <= nearest + 0.5
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in got)
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(documents(spark, rows), most_sources=2)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [None, "", "no scheme", "http://", "://x.org/", "HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://notexample.org/es/", "http://a.b.com/fr/x", "http://com/de/", "http://x.com/de", "http://x.org", "http://x.org?a=http://y.com/fr/", "http://ÀB.com/fr/é\nü", "http://x.net/a#b?c", "http://x://y.org/z", "a" * 5000 + "://long.org/p"] + [f"http://{h}.example.{t}/{p}/{i}" for i, h in enumerate(("spam", "good", "x")) for t in ("net", "com", "org") for p in ("de", "fr", "es", "en")]


def pages(spark, urls=URLS):
    rows = [(i if i != 3 else None, u, "<p>", "h", "r", 1) for i, u in enumerate(urls)]
    return spark.createDataFrame([*rows, *rows[:4]], "page_id long, url string, html string, host string, rule string, n int").repartition(2)


def parts(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0] if "://" in (url or "") else ""


def test_url_rules(spark):
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(pages(spark), RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        fits = [(t, v) for v, t in RULES for h, p in [url_filter.split_rule(t)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        found = got[i if i != 3 else None, host, path]
        assert found[0] == rule and found[1] == (verdict or found[1]) and found[1] in ("allow", "block"), url
    assert url_filter.judge(pages(spark).limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages(spark), []).collect()} == {"allow"}


def gram_model(texts, order):
    """Witten-Bell by plain counting."""
    count = Counter()
    for t in texts:
        for i in range(order, len(t)):
            for k in range(order + 1):
                count[t[i - k : i + 1]] += 1

    def p(gram):
        lower = 1 / url_filter.SYMBOLS if len(gram) == 1 else p(gram[1:])
        after = [n for g, n in count.items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        return (count[gram] + len(after) * lower) / (sum(after) + len(after)) if after else lower

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_url_scores_by_hand(spark, order):
    urls = [u for u in URLS if u and len(u) < 100] + [f"http://{h}.example.org/{p}/{i}" for i, (h, p) in enumerate((h, p) for h in ("a", "bad", "", "7") for p in ("es", "en/1", "fr", "É"))]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES, order=order)
    judged = {r.page_id: r for r in got.collect()}
    text = {i: "\x02" * order + u.translate(FOLD) + "\x03" for i, u in enumerate(urls)}
    told = {i: dict((t, v) for v, t in RULES).get(r.rule) for i, r in judged.items()}
    teaches = {i: hashlib.md5(u.encode()).hexdigest()[0] < "c" for i, u in enumerate(urls)}
    assert len({(told[i], teaches[i]) for i in told if told[i]}) == 4
    good, bad = (gram_model([text[i] for i in text if told[i] == v and teaches[i]], order) for v in ("allow", "block"))
    by_score = {}
    for i, t in text.items():
        places = range(len(t) - order)
        total = sum(round(float(np.log(good(t[j : j + order + 1])) - np.log(bad(t[j : j + order + 1]))) * url_filter.UNIT) for j in places)
        assert judged[i].score == total // (len(places) * url_filter.BIN), urls[i]
        if told[i] and not teaches[i]:
            a, c = by_score.get(judged[i].score, (0, 0))
            by_score[judged[i].score] = (a + (told[i] == "allow"), c + (told[i] == "block"))
    limit = url_filter.threshold(by_score)
    for i, r in judged.items():
        assert r.verdict == (told[i] or ("allow" if r.score >= limit else "block")), urls[i]


def test_url_models_tell_held_out_urls_apart(spark):
    rng = random.Random(5)
    name = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    urls = [f"https://{name(('lib', 'edu', 'news', 'wiki'), 2)}.org/{name(('art', 'icle', 'page'), 3)}/{i}" for i in range(300)]
    urls += [f"http://{name(('win', 'cash', 'x', '88'), 3)}.com/de/{name(('bonus', 'free', '-'), 3)}{i}" for i in range(150)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    held = [(r.verdict, r.score) for r in got if hashlib.md5(urls[r.page_id].encode()).hexdigest()[0] >= "c"]
    good, bad = ([s for v, s in held if v == x] for x in ("allow", "block"))
    assert len(good) > 40 and len(bad) > 20
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_url_sql_agrees(spark):
    import duckdb

    rows = [tuple(r) for r in pages(spark).select("page_id", "url").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert Counter(con.execute(url_filter.judge_sql("pages", RULES)).fetchall()) == Counter(tuple(r) for r in url_filter.judge(pages(spark), RULES).collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rep string, leaf int").repartition(3)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 16))
    x = (centre[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:1200] = x[3]  # a third alike, one vector
    x[1200:1210] *= 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [1.0] * 3), (None, [1.0] * 16), (3100, [float("inf")] * 16), (3120, [])]
    got = {}
    for r in ann.search(vectors(spark, rows + odd + rows[:5]), F.col("vec_id") % 20 == 0, k=20, most_sample=1500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        score = ann.scores(wide[q], wide)
        exact = [i for i in np.lexsort([np.arange(3000), -score]) if i != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == [*range(1, 21)] and all(s == score[i] for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found) and q not in [i for _, i, _ in found]
        hits += len({i for _, i, _ in found} & set(exact))
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_of_few(spark):
    asks = F.col("vec_id") % 20 == 0
    assert ann.search(vectors(spark, [(0, [1.0, 0.0])]).limit(0), asks).count() == 0
    assert ann.search(vectors(spark, [(0, [1.0, 0.0])]), asks).count() == 0
    rows = [tuple(r) for r in ann.search(vectors(spark, [(0, [1.0, 0.0]), (2, [1.0, 1.0]), (1, [1.0, 1.0]), (20, [-1.0, 0.0])]), asks).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0)]


@pytest.mark.parametrize("n", [400, 3000])
def test_nearest_is_complete(spark, n):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n // 25, 24))[rng.integers(0, n // 25, n)] + 0.2 * rng.normal(size=(n, 24))).astype(np.float32)
    counts, asks, hits = [], F.col("vec_id") % 20 == 0, 0
    found = Counter((r.query_id, r.vec_id) for r in ann.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), asks, counts=counts).collect())
    assert Counter(q for q, _ in found) == {q: 20 for q in range(0, n, 20)}
    for q in range(0, n, 20):
        score = x.astype(np.float64) @ x[q].astype(np.float64)
        score[q] = -np.inf
        hits += sum((q, i) in found for i in np.argsort(-score)[:20].tolist())
    assert hits >= 0.9 * 20 * len(range(0, n, 20))
    assert 21 <= counts[0] <= counts[1] == n and (n < 3000 or counts[0] < n / 3)  # clustered vectors: most leaves stay closed


def test_nearest_opens_every_leaf_if_asked():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    tree = ann.KMeansTree(x, float(np.sqrt((x * x).sum(1).max())))
    leaf = tree.leaves(x)
    held = np.bincount(leaf, minlength=tree.n_leaves)
    assert held.max() <= 4 * ann.LEAF and tree.n_leaves > 3000 / (3 * ann.LEAF)
    for q in x[:20]:
        every = tree.visits(q, held, 3000)
        assert len(set(every)) == len(every) and held[every].sum() == 3000
        for need in (1, 50, 700):
            some = tree.visits(q, held, need)
            assert some == every[: len(some)] and held[some].sum() >= need > held[some[:-1]].sum()
    first, count = ann.blocks_of(np.array([0, 10, 3 * ann.BLOCK, 0, ann.BLOCK - 5, 6, 2]))
    assert first.tolist() == [0, 0, 1, 3, 4, 5, 5] and count.tolist() == [1, 1, 3, 1, 1, 1, 1]


def test_nearest_meets_its_recall(spark):
    x = np.random.default_rng(1).normal(size=(2000, 16))
    found = Counter((r.query_id, r.vec_id) for r in ann.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]), F.col("vec_id") % 20 == 0).collect())
    hits = 0
    for q in range(0, 2000, 20):  # all of them are among those that visits are calibrated on
        score = x @ x[q]
        score[q] = -np.inf
        hits += sum((q, i) in found for i in np.argsort(-score)[:20].tolist())
    assert hits >= 0.97 * 20 * 100


def prose(rng, n):
    return " ".join("".join(rng.choice(("the", "an", "er", "in", "on", "st", "re")) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        text = prose(rng, rng.randint(20, 200))
        text = re.sub(r"(\w+)", r"\1%%%", text) if bad and i % 12 else " ".join(w for w in text.split() for _ in range(5)) if bad else text
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0, "x"))
    rows += [(400, None), (401, ""), (None, prose(rng, 50)), (0, rows[0][1])]
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 0, 0, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, text string"), rows


def n_grams(text):
    """The n-grams that the quality models count, as what they consist of."""
    found, words, text = [], WORD.findall((text or "").translate(FOLD)), text or ""
    for k in (3, 5):
        found += [("c", text[i : i + k]) for i in range(len(text) - k + 1)]
    shapes = [(min(len(w), 12), w.isalpha(), w[-1].isalpha(), i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
    for k in (1, 2):
        found += [("s", tuple(shapes[i : i + k])) for i in range(len(words) - k + 1)]
    return found


def n_gram_buckets(texts):
    """By n-gram its bucket, read off what the features of single texts say, in order."""
    out = {}
    for t in texts:
        buckets = [b for own, _ in quality.features(pa.array([t], pa.string())) for b in own.tolist()]
        for g, b in zip(n_grams(t), buckets, strict=True):
            assert out.setdefault(g, b) == b
    return out


def plain_selection(rows, labels, keys, prior=64, temperature=0.04):
    """The scores and the draw by plain counting; ``keys`` give the noise, which hashes of Spark make."""
    bucket = n_gram_buckets([t for _, t in rows])
    grams = [[bucket[g] for g in n_grams(t)] for _, t in rows]
    half, good, bad = labels
    raw, target = Counter(b for g in grams for b in g), Counter(b for (d, _), g in zip(rows, grams, strict=True) for b in g if d in good and d in half)
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = {b: np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in raw}
    score = [sum(ratio[b] for b in g) / (len(g) + prior) for g in grams]
    lows = {}
    for (d, _), s in zip(rows, score, strict=True):
        if d is not None and d not in half and (d in good or d in bad):
            lows[d] = min(s, lows.get(d, np.inf))
    limit = quality.cut(np.array([s for d, s in lows.items() if d in good]), np.array([s for d, s in lows.items() if d in bad]))
    k = sum(s >= limit - 1e-12 for s in score)
    drawn = [s / temperature + keys[r] for r, s in zip(rows, score, strict=True)]
    least = sorted(drawn)[-k]
    return score, [x >= least - 1e-9 for x in drawn], k


def halves(spark, labels, seed=11):
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0).collect()
    return {r.doc_id for r in rows if r.half}, {r.doc_id for r in rows if r.quality == 1 and not r.toxic}, {r.doc_id for r in rows if r.quality == 0}


def test_quality(spark):
    docs, labels, rows = labelled(spark)
    got = quality.resample(docs, labels)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert got.count() == len(rows)
    good = [kept[i] for i in range(300) if i % 6]
    bad = [kept[i] for i in range(300) if i % 6 == 0]
    assert np.mean(good) > 0.99 and sum(bad) <= 3
    assert Counter(map(tuple, quality.resample(docs.repartition(1), labels).collect())) == Counter(map(tuple, got.collect()))
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in quality.resample(docs, labels.limit(0)).collect())
    carried = quality.resample(docs, labels, carry=["text", "source", "key"])
    assert carried.columns == ["text", "source", "key", "kept"]
    by_text = {t: kept[d] for d, t in rows}
    assert Counter((r.text, r.kept) for r in carried.collect()) == Counter((t, by_text[t]) for _, t in rows)


def test_quality_draw_by_brute_force(spark):
    docs, labels, rows = labelled(spark)
    rng = random.Random(8)
    rows = rows + [(500 + i, " ".join(w for w in prose(rng, 40).split() for _ in range(1 + (rng.random() < i / 100)))) for i in range(100)] + [(700, "x " * 20_000)]
    docs, marks, chosen = documents(spark, rows), halves(spark, labels), []
    for seed in (11, 12, 13):
        marks = halves(spark, labels, seed)
        got = quality.resample(docs, labels, seed=seed).withColumn("noise", F.col("key") - F.col("score") / 0.04)
        found = {}
        for r, (d, t) in [(r, x) for r in got.join(docs.select("doc_id", "text").distinct(), "doc_id").collect() for x in [(r.doc_id, r.text)]]:
            found[d, t] = r
        some = [x for x in rows if x[0] is not None and x[0] != 0]
        rest = got.where("doc_id is null or doc_id = 0").collect()
        keys = {x: found[x].noise for x in some}
        for x in rows:
            if x not in keys:
                keys[x] = next(r.noise for r in rest if r.doc_id == x[0])
        score, draw, k = plain_selection(rows, marks, keys)
        assert sum(r.kept for r in got.collect()) == sum(draw) >= k
        for x, s, d in zip(rows, score, draw, strict=True):
            if x in found:
                assert found[x].score == pytest.approx(s) and found[x].kept == d
        top = sorted(score)[-k]
        chosen.append(({x for x, d in zip(rows, draw, strict=True) if d}, {x for x, s in zip(rows, score, strict=True) if s >= top}))
        assert all(abs(s - top) < 0.5 for x, s, d in zip(rows, score, draw, strict=True) if d != (s >= top))
    assert any(draw != plain for draw, plain in chosen) and len({frozenset(draw) for draw, _ in chosen}) > 1


def test_quality_noise_follows_the_weights():
    """Gumbel top-k takes each of few documents as often as drawing one after the other by weight does."""
    rng, weight, n = np.random.default_rng(4), np.array([0.5, 0.3, 0.15, 0.05]), 40_000
    unit = rng.random((n, 4))
    top = np.argsort(-(np.log(weight) - np.log(-np.log(unit))), 1)[:, :2]
    second = [weight[i] + sum(weight[j] * weight[i] / (1 - weight[j]) for j in range(4) if j != i) for i in range(4)]
    assert np.bincount(top.reshape(-1)) / n == pytest.approx(second, abs=0.01)


def test_quality_features_and_ratios(spark):
    texts = ["abc ABC the the the", "", None, "ab", "é漢字 x\x0bx q1 1q a,", "a" * 40]
    bucket = n_gram_buckets(texts)
    assert len(set(bucket.values())) > 0.9 * len(bucket)
    whole = Counter((b, i) for own, owner in quality.features(pa.array(texts, pa.string())) for b, i in zip(own.tolist(), owner.tolist(), strict=True))
    assert whole == Counter((bucket[g], i) for i, t in enumerate(texts) for g in n_grams(t))
    docs = spark.createDataFrame([(t, i < 2) for i, t in enumerate(texts)], "text string, fit boolean")
    raw, target = (Counter(bucket[g] for t in some for g in n_grams(t)) for some in (texts, texts[:2]))
    ratio = quality.log_ratios(quality.bucket_counts(docs))
    for b in [*raw, 0, 5]:
        expected = np.log((target[b] + 1) / (sum(target.values()) + quality.BUCKETS)) - np.log((raw[b] + 1) / (sum(raw.values()) + quality.BUCKETS))
        assert ratio[b] == pytest.approx(expected)


def test_kth_largest(spark):
    rng = random.Random(0)
    for values in ([1.0], [2.0] * 9, [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 7, [1e-300, 1e300, -1e300]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for k in {1, len(values) // 2 or 1, len(values)}:
            assert quality.kth_largest(df, "x", k, 16) == sorted(values)[-k]
    assert quality.kth_largest(df.limit(0), "x", 3) is None


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, rows = labelled(spark)
    rng = random.Random(9)
    base = prose(rng, 120)
    more = documents(spark, [(1000 + i, t, f"s{i % 4}") for i, t in enumerate(copies(rng, base, 12, 2))] + [(2000 + i, prose(rng, 60), f"s{i % 4}") for i in range(60)])
    docs.union(more).withColumn("_row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns, before = now.columns, {(r.doc_id, r.text) for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append(now)
        if name != "packing":
            assert now.columns == columns
            after = {(r.doc_id, r.text) for r in now.collect()}
            assert after <= before
            before = after
    first, second, mixed, packed = seen
    clean = {i for i in range(300) if i % 6} | {*range(1000, 1012)} | {*range(2000, 2060)}
    assert clean <= {r.doc_id for r in first.collect()}
    texts = [(r.doc_id, r.text) for r in first.collect()]
    drop = {d for d, _, _, kept in grouped(texts, 80) if not kept}
    assert {r.doc_id for r in second.collect()} == {d for d, _ in texts} - drop and len(drop) >= 10
    plan = {(r.doc_id, r.size): r.copies for r in mixing.mix(second).collect()}
    assert Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in mixed.collect()) == Counter({k: n for k, n in plan.items() if n})
    whole = sum(1 for _ in mixed.collect())
    assert packed.where("start = 0").count() == whole
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == packed.count()


def test_pipeline_works_by_row(spark, tmp_path):
    """Ids shared by good and bad rows, repeated rows, null ids and sources, long and empty texts."""
    import corpus_pipeline

    docs, labels, rows = labelled(spark)
    bad = re.sub(r"(\w+)", r"\1%%%", prose(random.Random(2), 120))
    odd = [(1, bad), (2, bad), (None, bad), (None, ""), (None, None), (900, "x y z " * 9000), (901, prose(random.Random(4), 90)), (901, prose(random.Random(4), 90)), (902, prose(random.Random(5), 90))]
    every = docs.drop("source").withColumn("source", F.lit(None).cast("string")).select(docs.columns).union(documents(spark, odd)).withColumn("_row0", F.lit("x"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = every
    count = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    first = corpus_pipeline.select_quality(spark, now, str(tmp_path))
    kept = count(first)
    assert first.columns == now.columns and not any(t == bad for _, t, _ in kept)
    assert {(i, rows[i][1]) for i in (1, 2)} <= {(d, t) for d, t, _ in kept}  # the good rows of shared ids
    assert kept[901, odd[6][1], "s"] == 2 and (None, rows[302][1], None) in kept
    second = corpus_pipeline.drop_near_duplicates(spark, first, str(tmp_path))
    left = count(second)
    assert second.columns == now.columns and left[901, odd[6][1], "s"] == 1 and left[902, odd[8][1], "s"] == 1
    assert sum(n for (d, t, _), n in left.items() if d is None or not t) == sum(n for (d, t, _), n in kept.items() if d is None or not t)
    third = corpus_pipeline.mix_sources(spark, second, str(tmp_path))
    mixed = count(third)
    assert third.columns == now.columns and not any(not t for _, t, _ in mixed) and {s for _, _, s in mixed} == {None, "s"}
    assert sum(r.length for r in corpus_pipeline.pack_sequences(spark, third, str(tmp_path)).collect() if r.start == 0) > 0


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shares_are_fractions_of_all():
    assert Fraction(5, 8) * 8 == 5  # weights 5, 2, 1 of three sources
    assert mixing.targets({"a": 80, "b": 80, "c": 80}, (5, 2, 1), 3) == {"a": 150.0, "b": 60.0, "c": 30.0}
