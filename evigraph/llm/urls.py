"""URL filters (operator 9), with DataFrame operations only.

Method: character language-model ratio. URLs that the rules allow and block train two smoothed variable-order Markov
models over characters; any other URL is judged by the difference of its log-likelihoods per character, against a
threshold calibrated on URLs that the rules decide too, and that training has not seen: those whose hash modulo 5 is 0.

Characters are folded to a fixed alphabet (SIGNS, everything else as ~, a start sign), so a model has at most
(len(SIGNS) + 2) ** ORDER n-grams whatever the input. It is broadcast up to MOST_BROADCAST of them; a larger one is joined
by a shuffle, in which every n-gram's characters are dealt to SALTS tasks.

Null URLs and those without :// have an empty host and path, no rule, and are judged like others (null: as an empty
URL). Very long URLs cost in proportion to their length. Repeated rows give repeated results; a URL of many pages is
judged once. A score equal to the threshold is allowed; of rules of equal length none fit together. If the rules allow or
block nothing, all other URLs are allowed; if calibration lacks a class, training URLs calibrate. An empty table gives
no rows; other columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hubs, written

SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789./:?=&_-#%"
ORDER = 4
MOST_BROADCAST, SALTS = 1_000_000, 16
#: The share of each class that may lie on the wrong side of its edge.
EDGE = 0.02
#: The rules of the contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """The URL's characters after start signs, in the fixed alphabet."""
    lower = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(lower, r"(?s)[^a-z0-9./:?=&_\-#%]", "~"))


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each character: the ORDER-gram that ends with it."""
    signs = urls.select(*keep, F.regexp_extract_all("folded", F.lit("(?s)."), F.lit(0)).alias("signs"))
    at = F.when(F.size("signs") >= ORDER, F.sequence(F.lit(1), F.size("signs") - (ORDER - 1))).otherwise(F.array().cast("array<int>"))
    # each character by its place in the array, and no array beside the exploded rows: linear in the length
    grams = F.transform(at, lambda i: F.concat(*[F.element_at("signs", i + k) for k in range(ORDER)]))
    return signs.select(*keep, F.explode(grams).alias("gram"))


def model(labelled: DataFrame, strength: float = 2.0) -> DataFrame:
    """gram, ratio: log of the accepted over the rejected model's probability of the last character.

    labelled: folded, verdict. Each model backs off through all shorter contexts: p_k = (n_k + strength * p_(k-1)) /
    (N_k + strength), with p_0 uniform. Grams are those that either class has.
    """
    counts = _grams(labelled, "verdict").groupBy("verdict", "gram").agg(F.count("*").alias("n"))
    wide = counts.groupBy("gram").pivot("verdict", ["allow", "block"]).agg(F.sum("n")).na.fill(0)
    ratio: list[Column] = []
    out = wide
    for k in range(ORDER):  # contexts of k characters
        own = F.substring("gram", ORDER - k, k + 1)
        context = F.substring("gram", ORDER - k, k) if k else F.lit("")
        for keys, name in ((own, "n"), (context, "all")):
            sums = wide.groupBy(keys.alias("key")).agg(F.sum("allow").alias(f"allow_{name}{k}"), F.sum("block").alias(f"block_{name}{k}"))
            out = out.join(sums, keys == sums["key"]).drop("key")  # Spark broadcasts those that are small
    for c in ("allow", "block"):
        p: Column = F.lit(1.0 / (len(SIGNS) + 1))
        for k in range(ORDER):
            p = (F.col(f"{c}_n{k}") + strength * p) / (F.col(f"{c}_all{k}") + strength)
        ratio.append(F.log(p))
    return out.select("gram", (ratio[0] - ratio[1]).alias("ratio"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (per character; null where a rule decides)."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = written(split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), folded(F.col("url")).alias("folded")).withColumn("key", F.md5(F.col("folded").cast("binary"))), "urls-ruled")
    known = judged.where("ruled is not null").withColumn("calibrates", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(5)) == 0)
    # equal URLs train as often as they come; the counts are of characters, whatever the number of rows
    ratios = written(model(known.where("not calibrates").select("folded", F.col("ruled").alias("verdict"))), "urls-model")
    # from here on a URL is its digest, so that its characters don't carry it along
    distinct = judged.groupBy("key").agg(F.max("ruled").alias("ruled"), F.max("folded").alias("folded"))
    grams = _grams(distinct, "key", "ruled")
    if ratios.count() <= MOST_BROADCAST:
        scored = grams.join(F.broadcast(ratios), "gram", "left")
    else:
        salts = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        scored = grams.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salts, ["gram", "salt"], "left")
    # characters that neither model has seen in any context say nothing
    scored = scored.groupBy("key", "ruled").agg((F.sum(F.coalesce("ratio", F.lit(0.0))) / F.count("*")).alias("score"))
    scored = written(scored, "urls-scores")
    discard(ratios)
    decided = scored.where("ruled is not null").withColumn("calibrates", F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(5)) == 0)
    edge = F.when(F.col("ruled") == "allow", F.percentile_approx("score", EDGE, 10_000)).otherwise(F.percentile_approx("score", 1 - EDGE, 10_000))
    sides = {(r["calibrates"], r["ruled"]): r["edge"] for r in decided.groupBy("calibrates", "ruled").agg(edge.alias("edge")).collect()}  # four rows
    by = [[sides[c, v] for v in ("allow", "block") if (c, v) in sides] for c in (True, False)]
    # midway between the lowest scores of accepted URLs and the highest of rejected ones, but for EDGE of each
    threshold = next((sum(x) / 2 for x in by if len(x) == 2), float("-inf"))
    open_score = F.when(F.col("ruled").isNull(), F.coalesce("score", F.lit(0.0)))
    out = join_hubs(judged, scored.groupBy("key").agg(F.max("score").alias("score")), "key", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(open_score >= F.lit(threshold), "allow").otherwise("block")).alias("verdict"),
        open_score.alias("score"),
    )


def digest(filtered: DataFrame) -> DataFrame:
    return filtered.drop("score")
