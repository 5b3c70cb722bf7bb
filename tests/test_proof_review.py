"""Proof body, seal, verify/tamper (O09, O10, O18, O19) and review ops."""
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from fixtures import F1_CONTRACT
from kitman import rules as R
from kitman.operators import proof as P
from kitman.operators import review as V
from kitman.plans.release import DEMO_KEY, FIXED_ISSUED_AT, extract, release


def _docs(spark):
    return spark.createDataFrame([("doc_00000000aa", F1_CONTRACT), ("doc_00000000bb", "nothing here")],
                                 "document_id string, text string")


def test_release_proof_and_seal(spark):
    rel = release(extract(_docs(spark)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).collect()
    by = {r.document_id: r for r in rel}
    r = by["doc_00000000aa"]
    assert r.redacted_count == 9 and r.proof.redaction_count == 9
    body = r.proof.asDict(recursive=True)
    # canonical text equals Python's sorted-key json, and the seal is HMAC-SHA256
    assert r.body_json == json.dumps(body, sort_keys=True, ensure_ascii=False)
    assert r.seal == hmac.new(DEMO_KEY, r.body_json.encode(), hashlib.sha256).hexdigest()
    assert body["original_sha256"] == hashlib.sha256(F1_CONTRACT.encode()).hexdigest()
    assert body["issued_at_iso"] == "2026-01-01T00:00:00Z"
    assert all(set(x) == {"confidence", "kind", "lang", "length"} for x in body["redactions"])
    assert "majed" not in r.body_json          # no span text in the proof
    assert by["doc_00000000bb"].redacted_count == 0
    assert by["doc_00000000bb"].redacted_text == "nothing here"


def test_verify_and_tamper(spark):
    rel = release(extract(_docs(spark)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).select("document_id", "proof", "seal")
    ok = P.verify(rel, DEMO_KEY).collect()
    assert all(r.valid and r.detail == R.VERIFY_OK for r in ok)
    bad = P.verify(P.tamper(rel), DEMO_KEY).collect()
    assert all((not r.valid) and r.redaction_count == R.TAMPER_COUNT for r in bad)
    assert all(not r.valid for r in P.verify(rel, b"other-key").collect())
    req = rel.sparkSession.createDataFrame([("doc_00000000aa",), ("doc_0000000000",), ("../x",)], "document_id string")
    found = {r.document_id: r for r in P.verify_requests(req, rel, DEMO_KEY).collect()}
    assert found["doc_00000000aa"].found and not found["doc_0000000000"].found
    assert found["../x"].detail == "Invalid document id."


def test_null_items_and_quotes_do_not_pass(spark):
    rel = release(extract(_docs(spark)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).select("document_id", "proof", "seal")
    extra = F.struct(F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("kind"),
                     F.lit("en").alias("lang"), F.lit(999).alias("length"))
    added = rel.withColumn("proof", F.col("proof").withField("redactions", F.concat("proof.redactions", F.array(extra))))
    assert not any(r.valid for r in P.verify(added, DEMO_KEY).collect())
    odd = spark.createDataFrame([('doc_", "x": "\\\n', None)], "document_id string, text string")
    r = release(extract(odd), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).first()
    assert json.loads(r.body_json) == r.proof.asDict(recursive=True)       # null text is empty text
    assert r.redacted_text == "" and r.seal is not None and r.signature_valid


def test_release_rejects_overlaps(spark):
    import pytest
    ex = extract(_docs(spark)).withColumn("spans", F.concat("spans", "spans"))
    with pytest.raises(Exception, match="overlap"):
        release(ex, None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).collect()


def test_decisions_latest_wins_and_release(spark):
    ex = extract(_docs(spark))
    spans = V.spans_table(ex)
    email_ids = [r.span_id for r in spans.filter("kind = 'email'").collect()]
    dec = spark.createDataFrame(
        [("doc_00000000aa", email_ids[0], True, 1, 1), ("doc_00000000aa", email_ids[0], False, 2, 1),
         ("doc_00000000aa", email_ids[1], False, 1, 1), ("doc_00000000aa", email_ids[1], True, 1, 2),
         ("doc_00000000aa", "pii_unknown000", False, 3, 1), ("doc_ffffffffff", email_ids[0], False, 1, 1)],
        "document_id string, span_id string, approved boolean, decided_at long, ord int")
    applied = {r.span_id: r.approved for r in V.apply_decisions(spans, dec).collect()}
    assert applied[email_ids[0]] is False and applied[email_ids[1]] is True
    assert sum(1 for v in applied.values() if v) == 8
    dead = V.unknown_document_decisions(dec, ex).collect()
    assert [r.document_id for r in dead] == ["doc_ffffffffff"]
    counts = {r.document_id: (r.items_found, r.redacted_count)
              for r in V.review_counts(ex, V.apply_decisions(spans, dec)).collect()}
    assert counts == {"doc_00000000aa": (9, 8), "doc_00000000bb": (0, 0)}
    rel = release(ex, dec, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).filter("document_id = 'doc_00000000aa'").collect()[0]
    assert rel.redacted_count == 8
    assert "majed.harbi@example.net" in rel.redacted_text
    assert "laura.bennett@example.net" not in rel.redacted_text


def test_review_list(spark):
    sp = V.spans_table(extract(_docs(spark)))
    rows = V.review_list(sp, "ar").collect()
    assert [r.start for r in rows] == sorted(r.start for r in rows)
    assert {r.kind_label for r in rows} >= {"اسم", "بريد", "آيبان"}
    assert all(r.confidence_pct in (72, 75, 80, 85, 97, 98) and not r.low_confidence for r in rows)
    assert all(not r.approved for r in V.decide_all(sp, False).collect())
    rejected = V.decide_all(sp, False)
    assert all(r.approved for r in V.decide_all(rejected, True).collect())


def test_bucketed_release_moves_only_decisions(spark):
    from conftest import SF_SMALL
    from kitman.plans import catalog
    from kitman.sources.sinks import save_extracts_bucketed
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = catalog.detected(spark, SF_SMALL)
    dec = catalog.labels_decisions(spark, SF_SMALL)
    bucketed = save_extracts_bucketed(plain, "extracts_bucketed_test", n)
    a = release(bucketed, dec, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT, co_partitions=n)
    b = release(plain, dec, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    cols = ["document_id", "redacted_count", "redacted_text", "seal"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan
