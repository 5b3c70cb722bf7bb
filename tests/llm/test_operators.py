"""The operators against brute force on small tables: nulls, empty texts, ties,
repeated rows, clashing columns, empty tables."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kitman.llm import (common, components, decontaminate, fingerprints, langid, mixing, quality, sharding, simhash,
                        substrings, tokens, urlfilter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string"
R = random.Random(5)
VOCABULARY = ["alpha", "Beta", "gamma,", "delta", "the", "of", "Ünder", "straße", "café", "omega.", "zeta", "x"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", str(r.randrange(40))]) for _ in range(n))


def texts():
    base = [prose(n, n) for n in (3, 60, 140, 400, 900)]
    shared = prose(75, 99)
    out = [None, "", "   \n\t", "one", "two words", *base, base[2], base[2].replace("alpha", "alpha,", 1), base[3] + " tail end",
           prose(30, 7) + " " + shared + " " + prose(30, 8), shared + "\n" + prose(20, 9), "a " * 130, "b " + "a " * 90, "a b " * 60,
           "c a b " + "a b " * 40, "no words: !!! ???", "😀 é̈ ok"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else "s2", len(t or ""), "clash", "clash") for i, t in enumerate(texts())]
    rows += [rows[7], (None, "null id", None, None, 7, None, None)]          # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_links_match_brute_force(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 30)
    fps = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 64, (6, 2))}
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    root = {f: f for f in fps}
    for _ in fps:                                        # least label of every neighbour, until nothing moves
        new = {a: min(root[b] for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= 2) for a in fps}
        if new == root:
            break
        root = new
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {x["node"]: x["root"] for x in components.components(simhash.links(table)).collect()}
    assert all(got.get(f, f) == root[f] for f in fps)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {x["doc_id"] for x in rows if x["doc_id"] == x["component_id"]} | {None}
    assert {x["doc_id"] for x in kept.collect()} == want


def test_covering_masks_meet_every_pair():
    for radius in (1, 2):
        masks = [m & (2**64 - 1) for m in simhash.masks(radius)]
        for i in range(64):
            for j in range(i if radius == 2 else i, 64 if radius == 2 else i + 1):
                d = (1 << i) | (1 << j)
                assert any(not m & d for m in masks)


def brute_removed(rows, w):
    first = {}
    for d, t in rows:
        ws = (t or "").encode().split()
        for p in range(len(ws) - w + 1):
            k = tuple(ws[p:p + w])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        ws = (t or "").encode().split()
        gone = set()
        for p in range(len(ws) - w + 1):
            if first[tuple(ws[p:p + w])] < d:
                gone |= set(range(p, p + w))
        out[d] = (len(ws), len(gone), b" ".join(x for i, x in enumerate(ws) if i not in gone).decode())
    return out


@pytest.mark.parametrize("segment", [200_000, 97])
def test_substrings_match_brute_force(spark, docs, empty, segment, monkeypatch):
    ids = list(enumerate(texts()))
    for window in (50, 8):
        want = brute_removed(ids, window)
        if segment == 200_000:
            got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(docs, window).collect()}
            assert {k: v for k, v in got.items() if k is not None} == want
        else:                                            # cut anywhere, the anchors of windows stay
            monkeypatch.setattr(substrings, "SEGMENT", segment)
            for _, t in ids:
                parts = {}
                for _, h, doc, pos in substrings._segments([0], [t], window):
                    p, name, where = substrings.anchors(h, doc, window)
                    parts |= {int(pos[a]): (int(n), int(pos[x]) - int(pos[a])) for a, n, x in zip(p, name, where)}
                ws = substrings.words(t)
                if len(ws) >= window:
                    p, name, where = substrings.anchors(common.word_hashes(ws), np.zeros(len(ws), int), window)
                    assert parts == {int(a): (int(n), int(x - a)) for a, n, x in zip(p, name, where)}
    if segment == 200_000:
        assert substrings.without_repeats(empty).count() == 0


def test_sharding_is_even_gapless_and_whole(spark, docs, empty):
    many = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', repeat(concat('w', id % 997, ' '), 1 + id % 50)) as text")
    for table, n in ((docs, 4), (many, 7)):
        rows = sharding.shard(table, n, rows_per_range=50).collect()
        assert len(rows) == table.count()
        size, slots, where = Counter(), {}, {}
        for r in rows:
            size[r["shard"]] += len((r["text"] or "").encode()) + 8
            slots.setdefault(r["shard"], []).append(r["slot"])
            where.setdefault((r["doc_id"], r["text"]), set()).add(r["shard"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in where.values())
        mean = sum(size.values()) / n
        assert max(size.values()) <= 1.06 * mean + max(len((r["text"] or "").encode()) + 8 for r in rows)
    assert sharding.shard(empty, 5).count() == 0


def test_sharding_divides_rows_equal_in_text_and_id(spark):
    text = "if(id % 3 = 0, repeat('hot ', 10), if(id % 3 = 1, null, repeat(concat('w', id % 997, ' '), 1 + id % 50)))"
    table = spark.range(9000).selectExpr("if(id % 3 = 0, 7, if(id % 3 = 1, null, id)) as doc_id", f"{text} as text", "id as row").repartition(5)
    rows = sharding.shard(table, 24, rows_per_range=50).collect()
    assert sorted(r["row"] for r in rows) == list(range(9000)) and rows[0].asDict().keys() == {"doc_id", "text", "row", "shard", "slot"}
    size, slots = Counter(), {}
    for r in rows:
        size[r["shard"]] += len(r["text"] or "") + 8
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(size) == 24
    assert max(size.values()) <= 1.06 * sum(size.values()) / 24 + 300
    keys = sharding.keyed(table)
    total = keys.agg(F.sum("__size")).first()[0]
    drawn = Counter(k[:2] for k in sharding._sample(keys, F.col("__size") * (900 / total)))
    hot = keys.where("doc_id = 7").agg(F.sum("__size")).first()[0] / total
    assert abs(max(drawn.values()) - 900 * hot) < 120 and abs(sum(drawn.values()) - 900) < 150   # by bytes, not all or none
    split = sharding.plan(keys, 24, 50).split
    in_range = Counter(r["__part"] for r in sharding._ranged(keys, split).where("doc_id = 7").collect())
    assert max(in_range.values()) < 300                   # no range (a window task) holds the hot id alone


def test_mixing_draws_poisson_and_repeats(spark, empty):
    many = spark.range(20000).selectExpr("id as doc_id", "repeat('x', 10) as text", "if(id % 4 = 0, null, 's') as source")
    got = mixing.mix_sources(many, {"s": 3.0}, total=600_000.0, seed=1)
    counts = Counter(r["doc_id"] for r in got.collect())
    assert all(d % 4 for d in counts)                    # the null source has no weight
    mean = sum(counts.values()) / 15000
    assert abs(mean - 4) < 0.1 and abs(np.var([counts.get(d, 0) for d in range(20000) if d % 4]) - 4) < 0.3
    same = mixing.mix_sources(many, {"s": 3.0}, total=600_000.0, seed=1)
    assert Counter(r["doc_id"] for r in same.collect()) == counts
    big = mixing.mix_sources(many.where("doc_id < 40"), {"s": 1.0}, total=10.0 * 30 * 1700, seed=1).groupBy("doc_id").count().collect()
    assert abs(np.mean([r["count"] for r in big]) - 1700) < 40            # rates beyond one draw are sums of draws
    assert mixing.mix_sources(empty).count() == 0


def test_decontamination_matches_brute_force(spark, docs, empty):
    leak = prose(40, 123)
    items = spark.createDataFrame([(1, leak), (2, prose(30, 5)), (3, "tiny"), (4, None), (5, "!!"), (6, prose(60, 60)[:300])],
                                  "item_id long, text string")
    rows = [(100, "start, " + leak.replace(" ", " \n") + "; end"), (101, " ".join(leak.split()[:20])), (102, "Tiny!"), (103, "a tiny word")]
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))

    def shingles(t):
        ws = decontaminate.words(t)
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    want = Counter()
    for d, t in [(r["doc_id"], r["text"]) for r in table.collect()]:
        for i, x in [(r["item_id"], r["text"]) for r in items.collect()]:
            q = shingles(x)
            if q and len(q & shingles(t)) >= 0.8 * len(q):
                want[d, i, len(q), len(q & shingles(t))] += 1
    for block in (500_000, 30):
        got = decontaminate.leaks(table, items, block_shingles=block).collect()
        assert Counter((r["doc_id"], r["item_id"], r["item_shingles"], r["contained"]) for r in got) == want
    assert (100, 1) in {k[:2] for k in want} and (102, 3) in {k[:2] for k in want}
    clean = decontaminate.without_leaks(table, items).collect()
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in table.collect()} - {k[0] for k in want}
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(docs, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def test_decontamination_of_a_large_benchmark_stays_in_spark(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, prose(40, 123)), (1, prose(40, 123)), (2, texts()[8]), (3, "one"), (4, None)], "item_id long, text string")
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(100, "x " + prose(40, 123)), (None, prose(40, 123))], "doc_id long, text string"))
    key = lambda r: Counter(map(tuple, r))
    want = key(decontaminate.leaks(table, items).collect())
    clean = key(decontaminate.without_leaks(table, items).collect())
    monkeypatch.setattr(decontaminate._Block, "add", lambda *a: pytest.fail("an item was indexed in the driver"))
    assert key(decontaminate.leaks(table, items, block_shingles=30).collect()) == want
    assert key(decontaminate.without_leaks(table, items, block_shingles=30).collect()) == clean
    assert {(100, 1), (None, 1), (3, 3)} <= {k[:2] for k in want}


def test_language_und_ties_and_empty(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(w) for _ in range(30)), lang) for i, (lang, w) in enumerate(
        [("en", ["the", "house", "walking"]), ("de", ["über", "straße", "nicht"])] * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, common.fold("doc_id", 4) != 2)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "12 !?"), (903, "Nicht über"), (904, "x" * 3_000_000)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in langid.predict(table.select("doc_id", "text").unionAll(odd), model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] == "de" and got[904]["lang_pred"] in ("de", "en") and all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identified(odd, model).columns == odd.columns and {x["doc_id"] for x in langid.identified(odd, model).collect()} == {903}
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred != 'und'").count() == 0


def test_language_keeps_short_texts_that_are_predicted_rightly(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(w) for _ in range(30)), lang) for i, (lang, w) in enumerate(
        [("en", ["the", "house", "walking"]), ("de", ["über", "straße", "nicht"])] * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    short, strange = "the house qzqzqz vkvkvkv", "qzqzqz vkvkvkv"
    odd = spark.createDataFrame([(1, short), (2, strange), (3, " ".join([short] * 200)), (4, "qq"), (5, None), (6, "17")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in langid.predict(odd, model).collect()}
    assert got[1]["lang_pred"] == "en" and 0.3 < got[1]["score"] < 0.5 and abs(got[3]["score"] - got[1]["score"]) < 0.05
    assert {x["doc_id"] for x in langid.identified(odd, model).collect()} == {1}   # the long one is surely below, the others hold nothing


def test_trigrams_of_blocks_are_those_of_the_whole(monkeypatch):
    t = prose(300, 1) + "  !! " + prose(40, 2)
    whole = np.concatenate(list(langid.trigrams(t)))
    monkeypatch.setattr(langid, "BLOCK", 17)
    assert np.array_equal(whole, np.concatenate(list(langid.trigrams(t))))


def test_quality_learns_and_takes_any_text(spark, docs, empty):
    good = [(i, prose(80, i), 1) for i in range(60)]
    bad = [(100 + i, prose(80, i).upper().replace(" ", "!! "), 0) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, y int")
    labels = table.selectExpr("doc_id", "y as quality").unionAll(spark.createDataFrame([(5, None), (None, 1)], "doc_id long, quality int"))
    got = quality.classify(table.select("doc_id", "text").unionAll(docs.select("doc_id", "text").where("doc_id is null or text is null")),
                           labels, common.fold("doc_id", 3) != 1).collect()
    y = {d: v for d, _, v in good + bad}
    assert all(r["predicted"] == y[r["doc_id"]] for r in got if r["doc_id"] in y and r["doc_id"] > 0) and len(got) == 122
    assert all(0 <= r["score"] <= 1 for r in got)
    one = quality.classify(table, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0} and {r["score"] for r in quality.classify(table, labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_fingerprints_estimate_similarity(spark, docs, empty):
    ids = [(i, t or "") for i, t in enumerate(texts())]
    ids[7:7] = []
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.compare(table, rows_each=4).collect()}
    assert len(got) == len(ids)
    for k, (i, t) in enumerate(ids):
        half, nxt = len(t) // 2, ids[(k + 1) % len(ids)][1]
        edit = t[:len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        sets = [(lambda w: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(
            x.lower().encode().split()) for x in (t, edit)]
        j = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
        assert abs(got[i]["near_edited"] - j) < 0.25
    assert got[7]["fingerprint"] == got[10]["fingerprint"] and len({len(r["fingerprint"]) for r in got.values()}) == 1
    assert fingerprints.compare(empty).count() == 0 and fingerprints.compare(docs, rows_each=3).count() == docs.count()


def test_token_files_read_back(spark, docs, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["don't I'll", "A.B,c", "<|endoftext|> x<|startoftext|>", "ΟΔΟΣ İstanbul ẞ", "你好 123 a1", "nbsp\xa0x\u2003y\x1cz", "'''"]
    for a, b in zip(odd, tokens.Encoder(path).encode(odd)):
        assert np.array(t.encode(a, add_special_tokens=False).ids, "<u4").tobytes() == b
    manifest = common.save(tokens.write(docs, str(tmp_path / "t"), path, 1, file_docs=5), "manifest")
    got = sorted(tokens.read(spark, manifest).collect(), key=lambda r: r["start"])
    want = sorted(((-2**63 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert [r["doc_id"] for r in got] == [w[0] for w in want] and manifest.count() > 1
    at = 0
    for r, (_, x) in zip(got, want):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert r["start"] == at and bytes(r["ids"]) == ids
        at += len(ids) // 4
    file = manifest.first()["file"]
    raw = bytearray(open(file, "rb").read())
    raw[12] ^= 255
    open(file, "wb").write(raw)
    with pytest.raises(Exception):
        tokens.File(file).read(0)
    assert tokens.write(empty, str(tmp_path / "e"), path, 1).count() == 0


def test_url_hosts_that_differ_in_digits_are_told_apart(spark):
    urls = [f"https://{h}.test/p{i}/x" for i in range(20) for h in ("bad1", "fine2", "fine3", "10.0.0.8", "10.0.0.9")]
    urls += [f"https://shop.test/{'2024' if i % 2 else '2023'}/i{i}" for i in range(20)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    bad = lambda u: any(x in u for x in ("bad1", "0.0.8", "/2024/"))
    labelled = spark.createDataFrame([(u, bad(u)) for u in urls], "url string, block boolean")
    for r in urlfilter.judge(pages, labelled).collect():
        assert r["verdict"] == ("block" if bad(r["url"]) else "allow"), r["url"]


def test_url_rules_rest_on_the_same_rows_at_every_size(spark):
    import itertools
    bad = [(["scheme=https", "word=bad", f"path={i}"], True) for i in range(6)] + [(["word=four"], True)] * 4
    few = spark.createDataFrame(bad, "tokens array<string>, block boolean")
    many = few.unionAll(spark.range(6000).selectExpr("array('scheme=https', concat('word=ok', id % 50))", "false"))
    for table in (few, many):
        rules = {tuple(r["items"]) for r in urlfilter.mine(table).collect()}
        assert ("word=bad",) in rules and not any("word=four" in r for r in rules)
        assert not any(set(a) < set(b) for a, b in itertools.permutations(rules, 2))       # parts of equal confidence prune
    assert urlfilter.mine(few.limit(4)).count() == 0


def test_url_rules_match_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q=1", "https://example.com/de/1", "http://x.org/fr/2#a", "http://net", "ftp://q.net/?a/",
            "http://example.net?x=/en/", "http://anet/", "a://b://c/d"]
    urls += [f"https://{'bad-bets' if i % 2 else 'fine'}.example.com/en/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").unionAll(
        spark.createDataFrame([(3, urls[3])], "page_id long, url string"))
    labelled = pages.where("page_id > 10").select("url", (F.col("page_id") % 2 == 0).alias("block"))
    rows = urlfilter.judge(pages, labelled).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None), u
        if fit:
            assert r["verdict"] == max(fit)[2]
        elif r["page_id"] > 10:
            assert r["verdict"] == ("block" if "bad" in u or r["page_id"] % 2 == 0 and "bad" in u else "allow")
    none = urlfilter.judge(pages.where("page_id < 0"), labelled.where("block is null"))
    assert none.count() == 0
