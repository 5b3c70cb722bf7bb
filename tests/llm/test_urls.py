"""Mined URL rules against all item sets; long and often labelled URLs."""
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from kitman.llm import urlfilter


def brute_rules(rows, min_rows, min_confidence):
    """All rules by listing every token set; minimal ones only."""
    tokens = sorted({t for ts, _ in rows for t in ts})
    conf = {}
    for size in range(1, 6):
        for x in itertools.combinations(tokens, size):
            n = [b for ts, b in rows if set(x) <= set(ts)]
            if sum(n) >= min_rows and sum(n) / len(n) >= min_confidence:
                conf[frozenset(x)] = sum(n) / len(n)
    return {x: c for x, c in conf.items() if not any(y < x and conf[y] >= c for y in conf)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_enumerated_sets(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(60):
        ts = [t for t in "abcdefg" if r.random() < 0.45]
        ts += ["twin of a"] * ("a" in ts) + ["a and b"] * ({"a", "b"} <= set(ts))
        score = 0.2 + 0.35 * ("a" in ts) * ("c" in ts) + 0.3 * ("d" in ts) * ("e" not in ts)
        rows.append((ts, r.random() < score))
    df = spark.createDataFrame(rows, "tokens array<string>, block boolean").repartition(3)
    rules, items = urlfilter.mine_items(df, 3, 0.5)
    of = {}
    for x in items.collect():
        of.setdefault(x["item"], []).append(x["token"])
    got = {}
    for x in rules.collect():
        choices = [[i] for i in x["items"]] if len(x["items"]) == 1 else [of[i] for i in x["items"]]
        for tokens in itertools.product(*choices):
            got[frozenset(tokens)] = x["confidence"]
    # a token and its twin in one rule never make it surer, so sets of at most five tokens are all
    assert got == pytest.approx(brute_rules([(t, b) for t, b in rows if t], 3, 0.5)) and len(got) > 3


@pytest.mark.parametrize("segments, copies", [(7, 6), (30, 6), (30, 1000)])
def test_long_urls_that_are_often_labelled(spark, segments, copies):
    long = "https://a.example/" + "/".join(f"part{i}x{i}" for i in range(segments))
    urls = [long] * copies + [f"http://fine.test/{i}" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = pages.select("url", (F.col("page_id") < copies).alias("block"))
    began = time.time()
    got = urlfilter.judge(pages, labelled).collect()
    assert {(r["url"], r["verdict"]) for r in got} == {(u, "block" if u == long else "allow") for u in urls} and len(got) == len(urls)
    assert time.time() - began < 90


def test_mixed_labels_on_long_urls(spark):
    """All tokens are in blocked and allowed rows, so nothing is settled by one token."""
    long = "https://a.example/" + "/".join(f"part{i}" for i in range(30))
    rows = [(long, i % 3 > 0) for i in range(300)] + [(f"{long}/{'xy'[i % 2]}", i % 2 == 0) for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    got = {r["url"]: r["verdict"] for r in urlfilter.judge(pages, labelled).collect()}
    assert got == {long: "block", f"{long}/x": "block", f"{long}/y": "block"}
    rules = {tuple(r["items"]): round(r["confidence"], 3) for r in urlfilter.mine(labelled.select(urlfilter.tokens().alias("tokens"), "block")).collect()}
    assert rules[("path=x",)] == 1.0 and rules[("path=part3",)] == round(230 / 360, 3)


def test_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x", "y"), (1, "http://a.b/c", "x", "y"), (2, None, None, None)],
                                  "page_id long, url string, key string, tokens string")
    none = pages.select("url", F.lit(True).alias("block")).where("false")
    assert sorted(r["page_id"] for r in urlfilter.judge(pages, none).collect()) == [1, 1, 2]
    assert urlfilter.judge(pages.where("false"), none).count() == 0
