"""Spark detection + redaction equals the brute-force Python oracle on every
document of the given tables (whole texts) and on the contract corpus."""
from pyspark.sql import functions as F

from conftest import SF_MID
from kitman.operators.detect import detect
from kitman.operators.redact import redact_column
from kitman.plans import catalog
import pyoracle


def _check(df):
    out = detect(df).withColumn("red", redact_column(F.col("text"), F.col("spans"), None))
    n = 0
    for r in out.select("doc_id", "text", "spans", "red", "lang").collect():
        text = r.text or ""
        want = pyoracle.detect(text)
        got = [(s.start, s.end, s.kind, s.text, s.confidence, s.lang) for s in r.spans]
        assert got == [(s["start"], s["end"], s["kind"], s["text"], s["confidence"], s["lang"]) for s in want], r.doc_id
        if r.text is not None:
            assert r.red == pyoracle.redact(text, want), r.doc_id
        assert r.lang == pyoracle.doc_lang(text)
        n += len(got)
    return n


def test_documents_match_python(spark):
    assert _check(catalog.documents(spark, SF_MID)) > 0


def test_corpus_match_python(spark):
    assert _check(catalog.corpus(spark, SF_MID)) > 0


def test_rule_hits_match_python(spark):
    """Every single rule's raw hits (before dedupe), incl. the card rule on
    documents that has no SQL oracle."""
    from kitman import rules as R
    from kitman.operators.detect import rule_hits_of
    docs = catalog.documents(spark, SF_MID).unionByName(
        catalog.corpus(spark, SF_MID).select("doc_id", "document_id", "text"))
    for rule in R.rules():
        rows = docs.select("doc_id", "text", rule_hits_of("text", rule).alias("h")).collect()
        for r in rows:
            got = [(h.start, h.end, h.text) for h in r.h]
            want = [(h["start"], h["end"], h["text"]) for h in pyoracle.rule_hits(r.text or "", rule)]
            assert got == want, (rule.kind, rule.family, r.doc_id)


def test_short_and_long_paths_agree(spark, monkeypatch):
    """Few spans compete one by one and short arrays are summed element by element;
    the paths of many give the same, around the limits too."""
    import random

    from pyspark.sql import functions as F

    from kitman.functions import arrays as A
    from kitman.operators import spans as S
    rnd = random.Random(5)

    def span(i):
        start, length = rnd.randrange(60), rnd.randrange(1, 9)
        return (start, start + length, rnd.randrange(4), i, start, start + length, "k", "t", rnd.choice([0.7, 0.8, 0.9]))

    rows = [(n, [span(i) for i in range(n)], [rnd.randrange(9) for _ in range(n)]) for n in [0, 1, 2, 3, 15, 16, 17, 23, 24, 25, 40] * 3]
    df = spark.createDataFrame(rows, f"n int, spans {S.SPAN_ARRAY}, a array<int>")
    got = {}
    for few, short in ((S.FEW_SPANS, A.SHORT), (0, 0)):
        monkeypatch.setattr(S, "FEW_SPANS", few)
        monkeypatch.setattr(A, "SHORT", short)
        got[few] = df.select(S.resolve_overlaps(F.col("spans")), A.inclusive_scan(F.col("a")), A.exclusive_scan_sum(F.col("a")), A.inclusive_scan(F.col("a"), "max")).collect()
    assert got[24] == got[0]
    for (_, _, a), r in zip(rows, got[24]):
        assert r[1] == [sum(a[:i + 1]) for i in range(len(a))] and r[2] == [sum(a[:i]) for i in range(len(a))]
        assert r[3] == [max(a[:i + 1]) for i in range(len(a))]


def test_lines_are_split_only_where_a_kind_occurs(spark):
    from pyspark.sql import functions as F

    from kitman.operators.spans import line_label_hits
    plan = spark.range(1).select(line_label_hits(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") >= 8                         # the gate, a line's, and each kind's
