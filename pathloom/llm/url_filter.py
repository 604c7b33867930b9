"""URL filters by rules and character models, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, join_spread, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks before the start of a URL and after its end.
START, END = "\x02", "\x03"
#: Characters that a model without any knowledge gives equal shares: all code points.
SYMBOLS = 0x110000
#: Log-likelihoods are summed as whole millionths, so sums are exact in any order.
UNIT = 1_000_000
#: A score's bin is this many millionths wide.
BIN = 10_000
#: URLs whose MD5 starts with a hex digit below this teach the models; the others calibrate.
TEACH = "c"

_HOST = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 2)


def split_rule(rule: str) -> tuple[str, str]:
    at = rule.index("/")
    return rule[:at], rule[at:]


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, start = split_rule(text)
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def marked(url: Column, order: int) -> Column:
    """The URL, A-Z lower-cased, with marks for its start and its end."""
    return F.concat(F.lit(START * order), F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), F.lit(END))


def grams(text: Column, order: int) -> Column:
    """Each character with the ``order`` before it."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - order), lambda i: F.substring(text, i, F.lit(order + 1)))


def _natural(n: Column, kinds: Column, total: Column, lower: Column) -> Column:
    """Witten-Bell: the order's own share, and the lower order's by the number of kinds seen."""
    return F.when(total > 0, (n + kinds * lower) / (total + kinds)).otherwise(lower)


def ratios(counts: DataFrame, order: int) -> DataFrame:
    """Log ratio in millionths, accepted over rejected, of each character after its context.

    ``counts`` has ``gram`` (``order`` + 1 characters), ``allow`` and
    ``block``. Each class has a model of orders 0 to ``order``: a context seen
    in the class gives its own frequencies mixed with the shorter context's,
    one not seen leaves it to the shorter, so contexts are as long as the
    corpus supports. Counts of an order are sums of the next one's; all tables
    are joined by context or by shorter gram, which have no more rows each
    than there are characters.
    """
    levels = {order: counts.select("gram", "allow", "block")}
    for k in range(order - 1, -1, -1):
        up = levels[k + 1].select(F.expr("substring(gram, 2)").alias("gram"), "allow", "block")
        levels[k] = materialize(up.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), f"url-order-{k}")
    classes = ("allow", "block")
    sums = [x for c in classes for x in (F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"n_{c}"), F.coalesce(F.sum((F.col(c) > 0).cast("long")), F.lit(0)).cast("double").alias(f"t_{c}"))]
    whole = levels[0].agg(*sums).first()
    lower = {c: F.lit(1.0 / SYMBOLS) for c in classes}
    model = levels[0].select("gram", *(_natural(F.col(c).cast("double"), F.lit(whole[f"t_{c}"]), F.lit(whole[f"n_{c}"]), lower[c]).alias(f"p_{c}") for c in classes))
    for k in range(1, order + 1):
        own = levels[k].withColumns({"context": F.substring("gram", 1, k), "shorter": F.expr("substring(gram, 2)")})
        contexts = own.groupBy("context").agg(*sums)
        own = own.join(contexts, "context").join(model.withColumnRenamed("gram", "shorter"), "shorter")
        model = own.select("gram", *(_natural(F.col(c).cast("double"), F.col(f"t_{c}"), F.col(f"n_{c}"), F.col(f"p_{c}")).alias(f"p_{c}") for c in classes))
    return model.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = 4) -> DataFrame:
    """Each URL's host, path, rule and verdict (``allow`` or ``block``), and its score.

    A rule decides where one fits. Of the URLs that rules decide, three
    quarters (by MD5) teach: the allowed and the blocked ones each give a
    smoothed variable-order model of code points, A-Z lower-cased, with up to
    ``order`` of them as context, all of them counted. A URL's score is the
    difference of its log-likelihoods by its number of characters, in whole
    hundredths rounded down. The other quarter calibrates: the threshold is
    the score with the largest sum of the shares of allowed URLs at or above
    it and of blocked URLs below it (the smallest such). URLs without a rule
    are allowed from the threshold on; without calibrating URLs of both
    classes it is 0. What is counted grows with the URLs and stays
    distributed; grams that very many URLs share are joined where they are.

    A null URL, or one without ``://``, has an empty host and path and is
    judged as the text it is (null: empty). URLs of any length are read whole.
    Repeated rows are judged alike; no rows give no rows; other columns are
    not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    teaches = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 1) < TEACH
    rows = rows.withColumns({"rule": rule, "told": verdict, "teaches": teaches, "row": F.monotonically_increasing_id(), "text": marked(F.col("url"), order)}).drop("url")
    rows = materialize(rows, "urls")
    each = lambda *cols: rows.select(*cols, F.explode(grams(F.col("text"), order)).alias("gram"))
    taught = lambda c: F.sum(F.coalesce((F.col("told") == c) & F.col("teaches"), F.lit(False)).cast("long")).alias(c)
    counts = materialize(each("told", "teaches").groupBy("gram").agg(taught("allow"), taught("block"), F.count("*").alias("held")), "url-grams")
    model = groups(ratios(counts, order).join(counts.select("gram", "held"), "gram"), "url-model")
    sums = join_spread(each("row"), model, ["gram"]).groupBy("row").agg(F.sum("ratio").alias("sum"), F.count("*").alias("n"))
    width = F.col("n") * BIN
    scored = sums.withColumn("score", ((F.col("sum") - F.pmod("sum", width)) / width).cast("long")).select("row", "score")
    judged = materialize(rows.drop("text").join(scored, "row"), "url-scores")
    # A score is a mean log ratio: its hundredths are few, whatever the number of URLs.
    held = judged.where("told is not null and not teaches").groupBy("score").agg(F.sum((F.col("told") == "allow").cast("long")).alias("allow"), F.sum((F.col("told") == "block").cast("long")).alias("block"))
    limit = threshold({r.score: (r.allow, r.block) for r in held.collect()})
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"), "score")


def threshold(bins: dict[int, tuple[int, int]]) -> int:
    """The score from which to allow, given the numbers of allowed and blocked by score."""
    allowed, blocked = sum(a for a, _ in bins.values()), sum(b for _, b in bins.values())
    if not allowed or not blocked:
        return 0
    best, limit, above, below = -1, 0, allowed, 0
    for t in sorted(bins):
        if (gain := above * blocked + below * allowed) > best:
            best, limit = gain, t
        above, below = above - bins[t][0], below + bins[t][1]
    return limit


def judge_sql(table: str, rules: list[tuple[str, str]], order: int = 4) -> str:
    """The same in SQL."""
    cases = {"rule": "", "told": ""}
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, start = split_rule(text)
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"
        cases["rule"] += f" WHEN {fits} THEN '{text}'"
        cases["told"] += f" WHEN {fits} THEN '{what}'"
    sums = "sum(a)::DOUBLE AS na, sum((a > 0)::INT)::DOUBLE AS ta, sum(b)::DOUBLE AS nb, sum((b > 0)::INT)::DOUBLE AS tb"
    mixed = lambda x, low: f"CASE WHEN n{x} > 0 THEN ({x}::DOUBLE + t{x} * {low}) / (n{x} + t{x}) ELSE {low} END AS p{x}"
    base = f"(1.0::DOUBLE / {SYMBOLS})"
    levels = "".join(f"g{k} AS MATERIALIZED (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM g{k + 1} GROUP BY 1),\n" for k in range(order - 1, -1, -1))
    models = f"m0 AS (SELECT gram, {mixed('a', base)}, {mixed('b', base)} FROM g0, (SELECT {sums} FROM g0)),\n"
    for k in range(1, order + 1):
        models += f"c{k} AS (SELECT substr(gram, 1, {k}) AS context, {sums} FROM g{k} GROUP BY 1),\n"
        models += f"m{k} AS (SELECT g.gram, {mixed('a', 'm.pa')}, {mixed('b', 'm.pb')} FROM g{k} g JOIN c{k} c ON c.context = substr(g.gram, 1, {k}) JOIN m{k - 1} m ON m.gram = substr(g.gram, 2)),\n"
    return f"""
WITH split AS (
  SELECT page_id, row_number() OVER () AS row, url, translate(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_HOST}', 2) AS path FROM {table}
), ruled AS MATERIALIZED (
  SELECT page_id, row, host, path, CASE{cases["rule"]} END AS rule, CASE{cases["told"]} END AS told, substr(md5(coalesce(url, '')), 1, 1) < '{TEACH}' AS teaches,
    repeat(chr({ord(START)}), {order}) || translate(coalesce(url, ''), '{UPPER}', '{LOWER}') || chr({ord(END)}) AS text FROM split
), each AS MATERIALIZED (SELECT row, told, teaches, substr(text, i, {order + 1}) AS gram FROM (SELECT row, told, teaches, text, unnest(range(1, length(text) - {order} + 1)) AS i FROM ruled)),
g{order} AS MATERIALIZED (SELECT gram, count(*) FILTER (told = 'allow' AND teaches) AS a, count(*) FILTER (told = 'block' AND teaches) AS b FROM each GROUP BY gram),
{levels}{models}model AS (SELECT gram, round((ln(pa) - ln(pb)) * {UNIT})::BIGINT AS ratio FROM m{order}),
sums AS (SELECT row, sum(ratio)::BIGINT AS s, count(*) * {BIN} AS w FROM each JOIN model USING (gram) GROUP BY row),
scored AS (SELECT row, ((s - ((s % w) + w) % w)::DOUBLE / w)::BIGINT AS score FROM sums),
judged AS (SELECT * FROM ruled JOIN scored USING (row)),
bins AS (SELECT score, count(*) FILTER (told = 'allow') AS a, count(*) FILTER (told = 'block') AS b FROM judged WHERE told IS NOT NULL AND NOT teaches GROUP BY 1),
gains AS (SELECT score, (sum(a) OVER (ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) * (sum(b) OVER ()) + coalesce(sum(b) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (sum(a) OVER ()) AS gain, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b FROM bins),
chosen AS (SELECT coalesce((SELECT score FROM gains WHERE all_a > 0 AND all_b > 0 ORDER BY gain DESC, score LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN score >= (SELECT t FROM chosen) THEN 'allow' ELSE 'block' END) AS verdict, score FROM judged
"""
