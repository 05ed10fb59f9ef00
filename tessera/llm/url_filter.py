"""Judging URLs by listed rules, and by association rules that FP-growth mines from labelled URLs. DataFrame code only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
#: By how many standard errors a rule's confidence must pass the verdict's own share, so that chance makes no rules.
DEVIATION = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"\A(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, null where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens(url: Column) -> Column:
    """A URL's distinct tokens, sorted: scheme, host and its parent domains (of at most 127 labels, as names have no more),
    path words by place, last extension, keys of the query, and whether there is a fragment. Numbers count as one token,
    so that they don't set URLs apart."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(u), path_of(u)
    labels = F.split(host, r"\.")
    depth = F.size(labels)
    domains = F.transform(F.sequence(F.greatest(F.lit(1), depth - 126), depth), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, depth), ".")))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    shown = F.transform(steps, lambda s: F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z]+\z", ""), "[0-9]+", "0"))
    placed = F.transform(shown, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), s))
    end = F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1)
    query = F.regexp_extract(u, r"\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1)))
    flags = F.array(F.concat(F.lit("scheme="), F.substring_index(u, "://", 1)), F.when(end != "", F.concat(F.lit("ext="), end)), F.when(F.instr(u, "#") > 0, F.lit("fragment")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(F.concat(flags, F.array(F.concat(F.lit("host="), host)), domains, placed, keys)))))


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules under one of their tokens each, the one in the fewest rules (of equals the first)."""
    parts = rules.withColumn("key", F.explode("items"))
    rare = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    columns = rules.columns
    return parts.join(rare, "key").groupBy(*columns).agg(F.min(F.struct("n", "key"))["key"].alias("key"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, deviation: float = 0.0) -> DataFrame:
    """(items, verdict, confidence, support) from (url, verdict): combinations of URL tokens that tell the verdict.

    FP-growth finds the frequent combinations over all labelled rows (partition by partition, on Spark's executors); a
    rule is kept if its support and confidence reach the limits, its confidence beats the verdict's own share (by
    `deviation` standard errors of that share among as many rows as the rule fits), and no rule of fewer of its tokens
    has the same confidence or more. Rows of null url or verdict are passed over.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and verdict is not null").select(F.concat(tokens(F.col("url")), F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    if not rows.limit(1).count():
        return spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith("verdict=") & (F.col("lift") > 1) & ~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    if deviation:
        share, fits = F.col("confidence") / F.col("lift"), F.col("support") / F.col("confidence") * F.lit(rows.count())
        rules = rules.where(F.col("confidence") - share >= deviation * F.sqrt(share * (1 - share) / fits))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support")
    # a rule is needless beside a shorter one that is as sure; they share the shorter one's rarest token
    short = _keyed(rules).select(F.col("items").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), "key")
    parts = rules.withColumn("key", F.explode("items"))
    needless = parts.join(short, "key").where((F.size("less") < F.size("items")) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("less", "items")) == 0))
    return rules.join(needless.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined, confidence) for the distinct token sets of urls(url) that a rule fits: the surest rule's verdict.

    An inverted index holds each rule under one of its tokens, the one in the fewest rules; a URL looks up its tokens
    and checks the rest of a rule's items. While tokens are looked up, a set goes by two hashes of it, so that a URL of
    many tokens isn't copied for each. Ties go to the larger support, then to more items, then to block.
    """
    sets = urls.select(tokens(F.col("url")).alias("tokens")).distinct().withColumns({"h1": F.xxhash64("tokens"), "h2": F.xxhash64(F.lit(1), "tokens")})
    looked = sets.select("h1", "h2", F.explode("tokens").alias("key")).join(_keyed(rules), "key").drop("key")
    found = looked.join(sets, ["h1", "h2"]).where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("items").alias("size"), "verdict"))
    return found.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


def url_filter(pages: DataFrame, labelled: DataFrame, rules=RULES, default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, deviation: float = DEVIATION) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, confidence (of a mined rule that decided).

    labelled (url, verdict) is what rules are mined from. The longest listed rule decides; else the surest mined rule;
    else `default`. A rule must pass the verdict's share by `deviation` standard errors, so that labels that say nothing
    about URLs decide nothing. A null url, or one without ://, has empty host and path and gets the default. Only page_id and url
    are read; null and repeated ids are rows like others. No labelled rows: nothing is mined. No pages give no rows.
    """
    u = F.col("url")
    p = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    mined = match_rules(p, mine_rules(labelled, min_support, min_confidence, deviation))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = p.withColumns({"host": host_of(u), "path": path_of(u), "tokens": tokens(u)}).join(mined, "tokens", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "mined", F.lit(default)).alias("verdict"), F.when(verdict.isNull(), F.col("confidence")).alias("confidence"))
