"""Mixing: many copies of one document, clashing names, nulls and repeated rows."""
import hashlib
import math

from pyspark.sql import functions as F

from kitman.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_cdf string, mix_source int, mix_piece int, MIX_PARTS int, own_0 int, n_copies int"


def count(doc_id, rate, seed=7):
    """Poisson count by the running sum of probabilities, part by part."""
    parts = max(1, math.ceil(rate / mixing.RATE_PART))
    lam, out = rate / parts, 0
    upto = math.ceil(lam + 12 * math.sqrt(lam) + 30)
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = c = math.exp(-lam)
        k = 0
        while c <= u and k <= upto:
            k += 1
            p = p * lam / k
            c += p
        out += k
    return out


def rows():
    docs = [(i, "word " * (i % 7), "big", "c", i, 1, 2, 3, 9) for i in range(3000)]
    docs += [(5000, "lone text", "lone", "c", 0, 1, 2, 3, 9), (5001, None, None, None, None, None, None, None, None), (5002, "no source", None, "c", 1, 1, 2, 3, 9),
             (None, "no id", "big", "c", 0, 1, 2, 3, 9), docs[5], docs[5]]
    return docs


def test_counts_and_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    out = mixing.mix_sources(df)
    assert out.columns == [*df.columns[:-1], "copy_no", "n_copies", "shuffle_key"]
    size = {}
    for d, t, s, *_ in rows():
        size[s] = size.get(s, 0) + len(t or "")
    rate = {s: sum(size.values()) / len(size) / n for s, n in size.items()}
    assert max(rate.values()) > 300
    want = {}
    for d, t, s, *_ in rows():
        n = count(d, rate[s])
        if n:
            want[d, s] = want.get((d, s), 0) + n
    got = {(r["doc_id"], r["source"]): r["n"] for r in out.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    assert got == want
    lone = out.where("doc_id = 5000")
    assert lone.select("copy_no").distinct().count() == lone.first()["n_copies"] == want[5000, "lone"]
    kept = lone.select("mix_cdf", "mix_source", "mix_piece", "MIX_PARTS", "own_0", "text").distinct().collect()
    assert [tuple(r) for r in kept] == [("c", 0, 1, 2, 3, "lone text")]


def test_a_document_of_very_many_copies_is_spread(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'0123456789' as text", "if(id = 0, 'lone', 'rest') as source")
    out = mixing.mix_sources(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2       # pieces, then copies
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "copy_no").alias("d"), F.max("n_copies").alias("m")).collect()
    by = {r["source"]: r for r in got}
    assert by["lone"]["n"] == by["lone"]["d"] == by["lone"]["m"] == count(0, 20_000) and by["rest"]["n"] == by["rest"]["d"]


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
