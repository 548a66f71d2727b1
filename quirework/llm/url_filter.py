"""URL filter: rules by host and path, and for the other URLs a character language-model ratio. DataFrame operations only.

Two variable-order Markov models over characters, one of URLs that a rule accepts and one of URLs that a rule rejects,
with contexts of up to three characters. Each order is smoothed by the next lower one (Witten-Bell: a context gives the
lower order as much weight as it has different followers), the lowest by a uniform distribution. A URL's score is the
mean over its characters of log P_accepted - log P_rejected. The threshold is calibrated on rule-decided URLs held out
of training. Probabilities are computed once for each different window of four characters, not for each URL.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, settings, table

#: (verdict, host, path) in the order of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER = 3
PAD, END = "\u0002", "\u0003"
#: Characters that the uniform distribution spreads over.
ALPHABET = 256
#: Log-ratios are summed as integers of this unit, so that sums don't depend on the order of rows.
UNIT = 1 << 20
#: The scores' histogram that sets the threshold: buckets of 1/64 between -32 and 32.
BUCKETS, PER = 2048, 64
#: Windows of four characters whose table is broadcast: at most so many (under 40 MB); beyond it the join is shuffled.
BROADCAST_WINDOWS = 500_000
#: URLs whose scores are broadcast: at most so many and, all together, bytes.
BROADCAST_URLS, BROADCAST_URL_BYTES = 200_000, 32 << 20
#: Partitions of different URLs are kept small.
SMALL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.length(host) == F.octet_length(host), F.lower(host)).otherwise(F.translate(host, string.ascii_uppercase, string.ascii_lowercase))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def windows(url: Column) -> Column:
    """Each character with the ORDER before it; none for an empty or null URL. The URL is cut into characters once, and
    the array is put beside itself, shifted: the work is linear in its length."""
    chars = F.split(F.concat(F.lit(PAD * ORDER), url, F.lit(END)), "")
    grams = F.slice(chars, F.lit(1), F.length(url) + 1)
    for k in range(1, ORDER + 1):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.length(url) + 1), lambda a, b: F.concat(a, b))
    return F.when(F.length(url) > 0, grams)


def train(labelled: DataFrame, ws: Workspace) -> DataFrame:
    """(gram, acc, rej): counts of four-character windows in URLs (url, verdict, and n, how often each occurs) with
    verdict allow and block."""
    grams = labelled.select("verdict", "n", F.explode(windows(F.col("url"))).alias("gram"))
    count = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    return ws.put("counts", grams.groupBy("gram").agg(count("allow").alias("acc"), count("block").alias("rej")))


def ratios(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, delta) for every window in ``seen``: log P_accepted - log P_rejected of its last character, in units."""
    rows = seen.select("gram")
    p = {"acc": F.lit(1.0 / ALPHABET), "rej": F.lit(1.0 / ALPHABET)}
    for k in range(ORDER + 1):
        suffix = lambda g, n=k + 1: F.substring(g, ORDER + 2 - n, n)
        grams = counts.groupBy(suffix(F.col("gram")).alias(f"g{k}")).agg(F.sum("acc").alias(f"acc{k}"), F.sum("rej").alias(f"rej{k}"))
        context = F.substring(F.col(f"g{k}"), 1, k)
        sums = [f(c).alias(f"{n}_{c[:3]}{k}") for c in (f"acc{k}", f"rej{k}") for n, f in (("n", F.sum), ("t", lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))))]
        rows = rows.withColumn(f"g{k}", suffix(F.col("gram"))).join(grams, f"g{k}", "left")
        if k:
            rows = rows.withColumn(f"c{k}", F.substring(F.col(f"g{k}"), 1, k)).join(grams.groupBy(context.alias(f"c{k}")).agg(*sums), f"c{k}", "left")
        else:  # one context, the empty one: four numbers
            whole = grams.agg(*sums).first().asDict()
            rows = rows.select("*", *[F.lit(v or 0).cast("long").alias(c) for c, v in whole.items()])
        for c in p:
            n, t = (F.coalesce(F.col(f"{x}_{c}{k}"), F.lit(0)) for x in "nt")
            p[c] = F.when(n + t > 0, (F.coalesce(F.col(f"{c}{k}"), F.lit(0)) + t * p[c]) / (n + t)).otherwise(p[c])
        rows = rows.select("gram", *[v.alias(f"p_{c}") for c, v in p.items()])
        p = {c: F.col(f"p_{c}") for c in p}
    return rows.select("gram", F.round((F.log(p["acc"]) - F.log(p["rej"])) * UNIT).cast("long").alias("delta"))


def threshold(scored: DataFrame) -> float:
    """From (score, verdict, n): the score with the best mean of the shares of accepted URLs at or above it and of rejected ones below it, halfway
    between two buckets that have URLs; of equals, the one nearest to 0. 0 where one side has no held-out URL. Only the histogram (at most BUCKETS * 2
    rows) is ordered."""
    bucket = F.least(F.greatest(F.floor(F.col("score") * PER), F.lit(-BUCKETS)), F.lit(BUCKETS))
    rows = scored.groupBy(bucket.alias("b")).agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
    hist = sorted(rows.collect())
    allow, block = sum(r.allow for r in hist), sum(r.block for r in hist)
    if not allow or not block:
        return 0.0
    best, above, below, last = None, allow, 0, hist[0].b - 1
    for r in hist:
        edge = (last + 1 + r.b) / 2 / PER
        found = (above / allow + below / block, -abs(edge), edge)
        best = max(best or found, found)
        above, below, last = above - r.allow, below + r.block, r.b
    return best[2]


def filter_urls(pages: DataFrame, ws: Workspace, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, score (null where a rule decides) and verdict.

    Null URLs and such without ``://`` have empty host and path; a null or empty URL scores 0. Long URLs are scored
    whole, in time linear in their length. Repeated rows are judged alike. An empty table stays empty; without rules that
    fit, no model can be learned, every ratio is 0 and the verdict is allow. Columns named as the results are replaced,
    others pass unchanged, whatever their names. URLs are counted map-side first, so models and scores are made once for
    each different URL, and no other column of ``pages`` takes part. Scores go back to the rows by a broadcast of the
    URLs that no rule decides, or, where these are too many or too long, by a plain shuffled join, whose skewed partitions
    Spark splits at run time."""
    kept = pages.drop("host", "path", "rule", "score", "verdict")
    url = F.coalesce(F.col("url"), F.lit(""))
    with settings(pages.sparkSession, SMALL):  # a URL becomes a row for each of its characters
        counted = ws.put("urls", pages.groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    _, said = match_rules(host_of(F.col("url")), path_of(F.col("url")), rules)
    counted = counted.select("id", "url", "n", said.alias("verdict"), (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0).alias("held"))
    decided, free = counted.where("verdict IS NOT NULL"), counted.where("verdict IS NULL")
    counts = train(decided.where("NOT held"), ws)
    seen = counted.where("verdict IS NULL OR held").select(F.explode(windows(F.col("url"))).alias("gram")).distinct()
    model = ws.put("ratios", ratios(ws.put("windows", seen), counts))
    few = model.count() <= BROADCAST_WINDOWS

    def score(urls: DataFrame) -> DataFrame:
        """(id, verdict, n, score); a window's row has no more than these of its URL."""
        rows = urls.select("id", "verdict", "n", F.explode_outer(windows(F.col("url"))).alias("gram"))
        summed = rows.join(F.broadcast(model) if few else model, "gram", "left").groupBy("id", "verdict", "n").agg(F.sum("delta").alias("sum"), F.count("gram").alias("size"))
        return summed.select("id", "verdict", "n", F.when(F.col("size") > 0, F.coalesce("sum", F.lit(0)) / F.col("size") / UNIT).otherwise(0.0).alias("score"))

    least = threshold(score(decided.where("held")))
    scores = ws.put("scores", free.select("id", "url").join(score(free).select("id", "score"), "id").select("url", "score"))
    rule, said = match_rules(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), url.alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("row", "url", "host", "path", rule.alias("rule"), said.alias("verdict"))
    n, size = scores.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    joined = rows.join(F.broadcast(scores) if n <= BROADCAST_URLS and size <= BROADCAST_URL_BYTES else scores, "url", "left")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return joined.select("row.*", "host", "path", "rule", "score", verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), Workspace(spark, "op6"))
