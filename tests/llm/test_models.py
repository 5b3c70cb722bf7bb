"""Classifiers, fingerprints and the corpus pipeline against plain computations."""
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_MID, SF_SMALL
from kitman.llm import common, decontaminate, fingerprints, langid, mixing, quality, simhash
from tests.llm.test_mixing import count

SPACE = re.compile("[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, name, at=SF_SMALL):
    return spark.read.parquet(f"{at}/{name}.parquet")


# -- 3: fingerprints bit by bit -----------------------------------------------------

def plain_simhash(text, width=3):
    ws = [w for w in SPACE.split((text or "").translate(UPPER)) if w]
    grams = [" ".join(ws[i:i + width]) for i in range(len(ws) - width + 1)] if len(ws) >= width else [" ".join(ws)] if ws else []
    ones = [0] * 64
    for h, n in Counter(xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams).items():
        for bit in range(64):
            ones[bit] += n * (h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(grams))


def test_simhash_bit_by_bit(spark):
    texts = [r["text"] for r in table(spark, "documents").select("text").collect()]
    texts += [None, "", " \t\n", "One", "one TWO", "ÀÉ É A b \x1c c", "a b c " * 3, "x\x00y z", "w " * 70_000 + "end",
              " ".join(str(i % 9000) for i in range(70_000))]
    assert [simhash.fingerprint(t) for t in texts] == [plain_simhash(t) for t in texts]


# -- 10: bins -------------------------------------------------------------------------

def test_bins_hold_the_least_hash_and_borrow(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    texts = ["", "one two", "a b c d e", "A B c d E f", "x " * 300, "the quick brown fox jumps over the lazy dog again and again", long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    words = spark.createDataFrame(sorted({(w,) for t in texts for w in t.lower().split()}), "w string").select("w", F.xxhash64("w").alias("h"))
    word = {r["w"]: r["h"] for r in words.collect()}
    grams, short = set(), set()
    for t in texts:
        h = [word[w] for w in t.lower().split()]
        grams |= {tuple(h[i:i + 5]) for i in range(len(h) - 4)}
        short |= {tuple(h)} if 0 < len(h) < 5 else set()
    five = spark.createDataFrame(sorted(grams), "a long, b long, c long, d long, e long").select(F.array("*").alias("k"), F.xxhash64("*").alias("h"))
    some = spark.createDataFrame([(list(s),) for s in sorted(short)], "k array<bigint>").select("k", F.xxhash64("k").alias("h"))
    shingle = {tuple(r["k"]): r["h"] % 2 ** 64 for r in five.unionAll(some).collect()}
    near = spark.range(fingerprints.BINS).select(*(F.pmod(F.xxhash64(F.col("id").cast("int"), F.lit(a)), F.lit(fingerprints.BINS)).alias(f"a{a}")
                                                   for a in range(1, fingerprints.PROBES + 3))).collect()
    for i, t in enumerate(texts):
        h = [word[w] for w in t.lower().split()]
        keys = [tuple(h[j:j + 5]) for j in range(len(h) - 4)] if len(h) >= 5 else [tuple(h)] if h else []
        held = {}
        for k in keys:
            b = shingle[k] >> 64 - fingerprints.BIN_BITS
            held[b] = min(held.get(b, 1 << 64), shingle[k])
        low = lambda b: held[b] & 255
        want = ""
        for b in range(fingerprints.BINS if held else 0):
            probes = [b, *(near[b][a] for a in range(fingerprints.PROBES))]
            full = next((p for p in probes if p in held), None)
            if full is None:
                start, stride = near[b][fingerprints.PROBES], near[b][fingerprints.PROBES + 1] | 1
                full = next(p for p in ((start + s * stride) % fingerprints.BINS for s in range(fingerprints.BINS)) if p in held)
            want += f"{low(full):02x}"
        assert got[i] == (want or "0" * 256), t[:40]


# -- 8: the discriminant ----------------------------------------------------------------

def test_quality_equals_the_formula(spark):
    docs, labels = table(spark, "documents", SF_MID), table(spark, "labels", SF_MID)
    learn = common.fold("doc_id", 3) != 1
    held = {r["doc_id"] for r in docs.where(~learn).select("doc_id").collect()}
    x = {r["doc_id"]: np.array(quality.statistics(r["text"])) for r in docs.collect()}
    marks = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    by = {y: np.array([x[d] for d, q in marks if q == y and d not in held and d in x]) for y in (0, 1)}
    n = sum(map(len, by.values()))
    spread = np.diag(np.maximum(sum(len(v) / n * v.var(axis=0) for v in by.values()), 1e-4))
    logs = {}
    for y, v in by.items():
        c = (1 - quality.SHRINK) * np.cov(v.T, bias=True) + quality.SHRINK * spread + 1e-6 * np.eye(len(quality.NAMES))
        inverse, prior = np.linalg.inv(c), (len(v) + quality.PRIOR_WEIGHT) / (n + 2 * quality.PRIOR_WEIGHT)
        logs[y] = {d: math.log(prior) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z - v.mean(axis=0)) @ inverse @ (z - v.mean(axis=0)) for d, z in x.items()}
    want = {d: 1 / (1 + math.exp(max(-700, min(700, (logs[0][d] - logs[1][d]) / quality.TEMPERATURE)))) for d in x}
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, learn).collect()}
    assert {d: r["score"] for d, r in got.items()} == pytest.approx(want, abs=1e-6)
    apart = [(got[d]["predicted"], y) for d, y in marks if d in held]
    assert len(apart) > 50 and np.mean([p == y for p, y in apart]) > 0.95


# -- 9: profiles as exact sets -------------------------------------------------------------

def plain_language(rows, ask):
    """rows(lang, text) → for each asked text (language, share, trigrams), with sets."""
    grams = lambda t: [int(g) for part in langid.trigrams(t or "") for g in part]
    counts = {}
    for lang, t in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
    held = {lang: {g for g, n in c.items() if n >= langid.MIN_SHARE * c.total()} for lang, c in counts.items()}
    out = []
    for t in ask:
        gs = grams(t)
        share = {lang: sum(g in s for g in gs) / len(gs) for lang, s in sorted(held.items())} if gs else {}
        best = max(share, key=share.get, default=None)
        out.append((best or "und", share.get(best, 0.0), len(gs)))
    return out


def test_language_equals_exact_sets(spark):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in table(spark, "documents", SF_MID).collect()]
    docs = table(spark, "documents", SF_MID)
    learn = common.fold("doc_id", 4) != 2
    held = {r["doc_id"] for r in docs.where(~learn).select("doc_id").collect()}
    want = plain_language([(lang, t) for d, lang, t in rows if lang is not None and t is not None and d not in held], [t for _, _, t in rows])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs, learn)).collect()}
    same = [got[d][0] == w[0] for (d, _, _), w in zip(rows, want)]
    assert np.mean(same) > 0.995 and max(abs(got[d][1] - w[1]) for (d, _, _), w, s in zip(rows, want, same) if s) < 0.02
    right = [got[d][0] == lang for d, lang, _ in rows if d in held and lang is not None]
    assert len(right) > 100 and np.mean(right) > 0.98


# -- the pipeline, stage by stage -----------------------------------------------------------

def test_every_stage_of_the_pipeline(spark):
    docs = table(spark, "documents")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.save(stage(spark, before, SF_SMALL), f"test-{name}")
        assert docs.columns[:len(columns)] == columns
        at[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    before, after = at["language"]
    told = plain_language([(r["lang"], r["text"]) for r in before if r["lang"] is not None], [r["text"] for r in before])
    assert ids(after) == ids(r for r, (lang, share, n) in zip(before, told) if lang != "und" and langid.most_share(share, n) >= langid.MIN_SCORE)

    before, after = at["near_dedup"]
    fps = {r["doc_id"]: plain_simhash(r["text"]) for r in before}
    root = dict(zip(fps, fps))
    for _ in fps:
        new = {d: min(root[e] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 2) for d in fps}
        if new == root:
            break
        root = new
    assert ids(after) == sorted(set(root.values())) and len(after) < len(before)

    before, after = at["decontaminate"]
    words = lambda t: [w for w in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER)) if w]
    grams = lambda t: {tuple(w[i:i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))} if words(t) else set()
    items = [g for g in (grams(r["text"]) for r in table(spark, "benchmark").collect()) if g]
    assert ids(after) == ids(r for r in before for g in [grams(r["text"])] if not any(len(i & g) >= 0.8 * len(i) - 1e-9 for i in items))

    before, after = at["mix"]
    size = Counter()
    for r in before:
        size[r["source"]] += len((r["text"] or "").encode())
    want = Counter({r["doc_id"]: count(r["doc_id"], size.total() / len(size) / size[r["source"]]) for r in before})
    assert Counter(r["doc_id"] for r in after) == +want

    before, after = at["shard"]
    assert sorted(map(repr, before)) == sorted(repr({c: r[c] for c in columns}) for r in after)
    slots = {}
    for r in after:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < corpus_pipeline.SHARDS
    run = corpus_pipeline.run(spark, SF_SMALL)
    assert Counter(r["doc_id"] for r in run.collect()) == +want


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, SF_SMALL), f"test-empty-{name}")
        assert docs.count() == 0


# -- clashing names ---------------------------------------------------------------------------

def test_stages_keep_columns_of_any_name(spark):
    clash = ["__h", "__d", "__salt", "__size", "__part", "__gone", "__row", "row", "own_0", "mix_cdf", "__source", "__parts", "__cdf", "__own", "fp", "item"]
    docs = table(spark, "documents").limit(60).select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in clash))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns[:len(docs.columns)] == docs.columns
        docs = common.save(out.select(*docs.columns), f"test-clash-{name}")
        assert docs.count() > 0 and docs.where(" or ".join(f"`{c}` != concat('{c}', doc_id)" for c in clash)).count() == 0
    big = decontaminate.without_leaks(docs, table(spark, "benchmark"), block_shingles=0)
    assert big.columns == docs.columns and big.count() == docs.count()
    assert mixing.mix_sources(docs).columns == [*docs.columns, "copy_no", "n_copies", "shuffle_key"]


# -- 6: items that share a heading ------------------------------------------------------------

def test_a_heading_that_all_items_share(spark):
    import random
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    heading = prose(30)
    items = [(i, f"{heading} {prose(40)}") for i in range(120)] + [(500, heading), (501, None), (502, "short one")]
    docs = [(i, f"{heading} {prose(60)}") for i in range(150)] + [(1000 + i, f"{prose(20)} {t} {prose(20)}") for i, t in items if t] + [(2000, "short one"), (2001, None)]
    docs.append((2002, " ".join(items[7][1].split()[:60])))               # most of an item
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: (x["doc_id"], x["item_id"], x["item_shingles"], x["contained"])
    small, large = (sorted(map(key, decontaminate.leaks(d, b, block_shingles=n).collect())) for n in (500_000, 0))
    assert small == large and {(x[0], x[1]) for x in large} >= {(1000 + i, i) for i, t in items if t and len(t) > 20}
    held = b.select(F.monotonically_increasing_id().alias("item"), F.col("text").alias("t"))
    sketches = decontaminate._sketches(held, 5, 0.8)
    # the heading's own item aside, no two items have a hash of their sketches in common
    assert sketches.groupBy("h").count().where("count > 2").count() == 0
