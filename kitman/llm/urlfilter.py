"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens that lead to a label; rules
are pruned by support and confidence, and by simpler rules that say the same.
They are matched through an inverted index: each URL token finds the rules that
start with it, and a rule fits if all its tokens are there.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, sized

BLOCK = "label=block"
#: Labelled rows that a rule must rest on, whatever the size of the table.
MIN_ROWS, MIN_CONFIDENCE = 5, 0.6
#: Host and path of the stated rules, with their verdicts.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring({_sql(url)}, locate('://', {_sql(url)}) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _sql(url: str) -> str:
    return f"coalesce(`{url}`, '')"


def stated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest stated rule that fits; null if none does."""
    out_name = out_verdict = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):     # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out_name, out_verdict = F.when(fits, h + p).otherwise(out_name), F.when(fits, verdict).otherwise(out_verdict)
    return out_name, out_verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL: scheme, words of the host's labels, path segments
    and query names; the last two as they are and with digits as one sign."""
    host, path = host_path(url)
    u = F.coalesce(F.col(url), F.lit(""))
    parts = F.transform(F.split(host, "[._-]"), lambda x: F.concat(F.lit("word="), F.lower(x)))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path="), F.lower(x)))
    query = F.transform(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"),
                        lambda x: F.concat(F.lit("query="), F.lower(F.substring_index(x, "=", 1))))
    folded = F.transform(F.concat(segments, query), lambda x: F.regexp_replace(x, r"[0-9]+", "0"))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(u, "://", 1))))
    every = F.filter(F.concat(scheme, parts, segments, query, folded), lambda x: ~x.endswith("="))
    return F.when(F.locate("://", u) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _kinds(occurs: DataFrame, min_rows: int) -> DataFrame:
    """(token, item, n, b), written: tokens of at least ``min_rows`` blocked rows.
    Tokens that occur in just the same rows (their row sets have one 128-bit hash)
    are one item, named after the least of them; n rows have it, b of them blocked."""
    row_set = [F.sum(F.xxhash64(F.col("row"), F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)]
    each = save(occurs.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("b"), *row_set)
                .where(F.col("b") >= min_rows), "tokens")
    same = each.groupBy("h0", "h1").agg(F.min("token").alias("item"))
    return save(each.join(same, ["h0", "h1"]).select("token", "item", "n", "b"), "kinds")


def _minimal(rules: DataFrame) -> DataFrame:
    """rules(items, confidence, support) without those of which a part is a rule of at
    least their confidence.  A part is looked for under its rarest item only."""
    each = rules.withColumn("item", F.explode("items"))
    often = each.groupBy("item").agg(F.count("*").alias("often"))
    parts = (each.join(sized(often), "item").groupBy("items")
             .agg(F.min_by("item", F.struct("often", "item")).alias("item"), F.first("confidence").alias("sure"))
             .withColumnRenamed("items", "part"))
    needless = (each.join(sized(save(parts, "parts")), "item")
                .where((F.size("part") < F.size("items")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
                .select("items").distinct())
    return rules.join(needless, "items", "left_anti")


def mine_items(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled(tokens, block boolean) → rules (rule_id, items, confidence, support) of
    item sets that lead to ``block`` in at least ``min_rows`` rows, and (token, item):
    a URL has an item if it has one of its tokens.  A rule goes if a part of it is
    already a rule of at least its confidence; rules of one item are given for each
    of its tokens.

    Only what a rule can be made of is mined: items of enough blocked rows.  Tokens that
    always come together are one item, so a long URL that is often labelled is a
    few items, not all subsets of its tokens; an item that is blocked wherever it
    occurs is a rule that no larger set improves."""
    rows = save(labelled.where("block is not null and size(tokens) > 0").select(
        F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "block"), "baskets")
    all_rows = rows.count()
    occurs = rows.select("row", "block", F.explode("tokens").alias("token"))
    kinds = _kinds(occurs, min_rows)
    sure = lambda b, n: [(F.col(b) / F.col(n)).alias("confidence"), (F.col(b) / all_rows).alias("support")]
    found = kinds.select("item", "n", "b").distinct().select(F.array("item").alias("items"), *sure("b", "n"))
    mixed = (occurs.join(sized(kinds.where("b < n").select("token", "item")), "token")
             .groupBy("row", "block").agg(F.collect_set("item").alias("items")).where("size(items) > 1"))
    baskets = save(mixed.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items")), "mixed")
    n = baskets.count()
    if n >= min_rows:
        # half a row less, so that rounding never asks for one more
        sets = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / n).fit(baskets).freqItemsets.where("size(items) > 1")
        sets = save(sets.select(F.array_sort(F.array_remove("items", BLOCK)).alias("items"), F.array_contains("items", BLOCK).alias("blocked"), "freq"), "sets")
        blocked = sets.where("blocked and size(items) > 1").select("items", F.col("freq").alias("b"))
        larger = blocked.join(sets.where("not blocked").select("items", F.col("freq").alias("n")), "items")
        found = found.unionByName(larger.select("items", *sure("b", "n")))
    kept = _minimal(save(found.where(F.col("confidence") >= min_confidence), "found"))
    by_token = kept.where("size(items) = 1").join(kinds.select("token", "item"), F.col("items")[0] == F.col("item")).select(
        F.array("token").alias("items"), "confidence", "support")
    rules = by_token.unionByName(kept.where("size(items) > 1")).select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support")
    return save(rules, "rules"), kinds.select("token", "item")


def mine(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rules of ``mine_items``."""
    return mine_items(labelled, min_rows, min_confidence)[0]


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(key, tokens) → (key, rule_id, confidence): the surest rule that fits.

    The index files each rule under its rarest token, so a token that nearly all
    URLs have leads to rules only where a rule consists of nothing rarer."""
    rules = sized(rules)
    word = urls.select("key", "tokens", F.explode("tokens").alias("token"))
    seen = save(word.groupBy("token").agg(F.count("*").alias("n")).join(
        sized(save(rules.select(F.explode("items").alias("token")).distinct(), "rule-tokens")), "token"), "frequency")
    filed = (rules.select("rule_id", "items", "confidence", F.explode("items").alias("token"))
             .join(sized(seen), "token").groupBy("rule_id")
             .agg(F.first("items").alias("items"), F.first("confidence").alias("confidence"),
                  F.min_by("token", F.struct("n", "token")).alias("token")))
    filed = sized(save(filed, "index"))
    hit = word.join(filed, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    return (hit.groupBy("key").agg(F.max(F.struct("confidence", "rule_id")).alias("r"))
            .select("key", "r.rule_id", "r.confidence"))


def _named(urls: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(key, tokens) with the items of rules that stand for a token of theirs
    among the tokens."""
    used = rules.select(F.explode("items").alias("item")).distinct()
    named = sized(save(items.where("token != item").join(used, "item"), "named"))
    more = urls.select("key", F.explode("tokens").alias("token")).join(named, "token").groupBy("key").agg(F.collect_set("item").alias("more"))
    both = F.array_union("tokens", F.coalesce("more", F.array().cast("array<string>")))
    return save(urls.join(save(more, "more"), "key", "left").select("key", both.alias("tokens")), "urls")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined_rule, confidence) for every
    page.  The longest stated rule decides; elsewhere a mined rule blocks, and
    without one the URL is allowed.  Null URLs and such without ``://`` have no
    token and are allowed; equal URLs are judged once; repeated rows repeat; of rules
    of one confidence the one of the greatest id is named; URLs of any length are
    read whole; without labels nothing is mined, without pages nothing is judged."""
    mined, items = mine_items(labelled.select(tokens("url").alias("tokens"), "block"))
    urls = pages.select("url").where("url is not null").distinct().select(F.col("url").alias("key"), tokens("url").alias("tokens"))
    hits = sized(save(matched(_named(save(urls, "urls"), items, mined), mined), "hits"))
    host, path = host_path("url")
    name, verdict = stated(host, path, rules)
    return (pages.select("page_id", "url", host.alias("host"), path.alias("path"), name.alias("rule"), verdict.alias("v"))
            .join(hits, F.col("url") == F.col("key"), "left")
            .select("page_id", "url", "host", "path", "rule",
                    F.coalesce("v", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                    F.col("rule_id").alias("mined_rule"), "confidence"))
