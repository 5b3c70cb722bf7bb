"""ST1 (file intake stream) equals the batch path; ST2 applies late
decisions with latest-wins, dead-letters unknown documents, re-releases."""
import json
import os
import tempfile

from fixtures import F1_CONTRACT, F2_LABELS
from kitman.plans.release import DEMO_KEY, FIXED_ISSUED_AT, extract
from kitman.sources import intake as I
from kitman.streaming.pipelines import read_latest, start_decisions, start_intake


def test_intake_then_decisions_stream(spark):
    base = tempfile.mkdtemp(prefix="kitman-stream-")
    src, state, dec = (os.path.join(base, x) for x in ("in", "state", "decisions"))
    os.makedirs(src), os.makedirs(dec)
    for name, text in (("f1.txt", F1_CONTRACT), ("f2.txt", F2_LABELS)):
        with open(os.path.join(src, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    with open(os.path.join(src, "x.exe"), "wb") as fh:
        fh.write(b"x")
    q = start_intake(spark, src, state, checkpoint=os.path.join(base, "ck1"))
    q.awaitTermination(120)
    ex = read_latest(spark, os.path.join(state, "extracts"))
    batch = extract(I.accepted(I.intake(I.read_files(spark, src))))
    assert sorted((r.document_id, len(r.spans)) for r in ex.collect()) == \
        sorted((r.document_id, len(r.spans)) for r in batch.collect())
    q_rows = spark.read.parquet(os.path.join(state, "quarantine")).collect()
    assert [r.reject_reason for r in q_rows] == ["unsupported_type"]

    from kitman.operators.review import spans_table
    f1 = [r for r in ex.collect() if "Service" in r.text][0]
    sp = spans_table(ex.filter(ex.document_id == f1.document_id)).filter("kind = 'email'").collect()
    lines = [dict(document_id=f1.document_id, span_id=sp[0].span_id, approved=False, decided_at=1, ord=1),
             dict(document_id=f1.document_id, span_id=sp[0].span_id, approved=True, decided_at=2, ord=1),
             dict(document_id=f1.document_id, span_id=sp[1].span_id, approved=False, decided_at=1, ord=1),
             dict(document_id="doc_ffffffffff", span_id="pii_x", approved=False, decided_at=1, ord=1)]
    with open(os.path.join(dec, "d1.json"), "w") as fh:
        fh.write("\n".join(json.dumps(x) for x in lines))
    q2 = start_decisions(spark, dec, state, key=DEMO_KEY, checkpoint=os.path.join(base, "ck2"), issued_at=FIXED_ISSUED_AT)
    q2.awaitTermination(180)
    rel = read_latest(spark, os.path.join(state, "releases")).collect()
    assert len(rel) == 1 and rel[0].redacted_count == 8
    assert sp[1].text in rel[0].redacted_text and sp[0].text not in rel[0].redacted_text
    dead = spark.read.parquet(os.path.join(state, "dead_letter")).collect()
    assert [r.document_id for r in dead] == ["doc_ffffffffff"]
    st = {r.span_id: r.approved for r in spark.read.parquet(os.path.join(state, "decisions")).collect()}
    assert st == {sp[0].span_id: True, sp[1].span_id: False}


def test_decisions_query_writes_its_sets_in_parallel(spark):
    import glob

    from conftest import SF_SMALL
    from kitman.plans import catalog
    from kitman.session import ensure_checkpoint_dir
    runs = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/st2-*"))
    before = runs()
    rows = catalog.q_st2_stream_decisions(spark, SF_SMALL).collect()
    (run,) = runs() - before
    files = glob.glob(run + "/decisions/part-*.json")
    assert len(files) > 2                                  # not one task a set
    sent = catalog.labels_decisions(spark, SF_SMALL)
    assert sum(len(open(f, encoding="utf-8").read().splitlines()) for f in files) == sent.count()
    assert sorted(r.document_id for r in rows) == sorted(r.document_id for r in sent.select("document_id").distinct().collect())
    assert len(glob.glob(run + "/state/releases/version=*")) >= 2


def _early(spark, wait_s):
    """A decision comes before its document, and one for a document that never comes."""
    base = tempfile.mkdtemp(prefix="kitman-early-")
    src, state, dec = (os.path.join(base, x) for x in ("in", "state", "decisions"))
    os.makedirs(src), os.makedirs(dec)
    put = lambda name, text: open(os.path.join(src, name), "w", encoding="utf-8").write(text)
    put("f2.txt", F2_LABELS)
    start_intake(spark, src, state, checkpoint=os.path.join(base, "ck1")).awaitTermination(120)
    put("f1.txt", F1_CONTRACT)
    ex = extract(I.accepted(I.intake_files(spark, src)))
    f1 = [r for r in ex.collect() if "Service" in r.text][0]
    span = f1.spans[0]
    from kitman.operators.review import spans_table
    sid = spans_table(ex.filter(ex.document_id == f1.document_id)).filter(f"emit_order = 0 and start = {span.start}").first().span_id
    os.remove(os.path.join(src, "f1.txt"))

    def send(name, *rows):
        with open(os.path.join(dec, name), "w") as fh:
            fh.write("\n".join(json.dumps(x) for x in rows))
        start_decisions(spark, dec, state, key=DEMO_KEY, checkpoint=os.path.join(base, "ck2"), issued_at=FIXED_ISSUED_AT,
                        wait_s=wait_s).awaitTermination(180)
    send("1.json", dict(document_id=f1.document_id, span_id=sid, approved=False, decided_at=1, ord=1),
         dict(document_id="doc_ffffffffff", span_id="pii_x", approved=False, decided_at=1, ord=1))
    rows = lambda t: read_latest(spark, os.path.join(state, t)).collect()
    assert rows("releases") == [] and rows("dead_letter") == []
    put("f1.txt", F1_CONTRACT)
    start_intake(spark, src, state, checkpoint=os.path.join(base, "ck1")).awaitTermination(120)
    send("2.json", dict(document_id="doc_eeeeeeeeee", span_id="pii_y", approved=True, decided_at=5, ord=1))
    return f1, span, rows


def test_a_decision_waits_for_its_document(spark):
    f1, span, rows = _early(spark, 3600)
    (rel,) = rows("releases")
    assert rel.document_id == f1.document_id and rel.redacted_count == len(f1.spans) - 1 and span.text in rel.redacted_text
    assert rows("dead_letter") == []


def test_a_decision_without_a_document_is_dead_in_time(spark):
    f1, _, rows = _early(spark, 1)                          # a second: over when the later decision comes
    assert [r.document_id for r in rows("releases")] == [f1.document_id]
    assert [r.document_id for r in rows("dead_letter")] == ["doc_ffffffffff"]


def test_oversize_files_are_turned_away_unread(spark):
    base = tempfile.mkdtemp(prefix="kitman-guard-")
    src, state = os.path.join(base, "in"), os.path.join(base, "state")
    os.makedirs(src)
    with open(os.path.join(src, "big.txt"), "wb") as fh:
        fh.truncate(2_300_000_000)                          # more than Spark can read as one value; takes no disk
    for name, text in (("good.TXT", F1_CONTRACT), ("a.pdf", "x"), ("b.exe", "x"), ("none.txt", "")):
        with open(os.path.join(src, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    rows = {r.filename: r for r in I.intake_files(spark, src).collect()}
    want = {"good.TXT": None, "big.txt": "too_large", "a.pdf": "pdf_text_required", "b.exe": "unsupported_type"}
    assert {k: r.reject_reason for k, r in rows.items() if k != "none.txt"} == want
    assert rows["good.TXT"].text == F1_CONTRACT and rows["big.txt"].length == 2_300_000_000
    start_intake(spark, src, state, checkpoint=os.path.join(base, "ck")).awaitTermination(120)
    assert [r.filename for r in read_latest(spark, os.path.join(state, "extracts")).collect()] == ["good.TXT"]
    assert {r.filename: r.reject_reason for r in read_latest(spark, os.path.join(state, "quarantine")).collect()
            if r.filename != "none.txt"} == {k: v for k, v in want.items() if v}


def test_table_of_several_files_is_streamed(spark):
    """A table may be a folder of files; its name is then no file's name."""
    from kitman.streaming.pipelines import stream_detect_table
    base = tempfile.mkdtemp(prefix="kitman-stream-table-")
    rows = spark.createDataFrame([(1, F1_CONTRACT), (2, F2_LABELS), (2, F2_LABELS), (None, F2_LABELS), (3, None)], "doc_id long, text string")
    rows.repartition(3).write.parquet(os.path.join(base, "documents.parquet"))
    out = stream_detect_table(spark, base, "documents", os.path.join(base, "out"), os.path.join(base, "ck"))
    want = extract(rows).select("doc_id", "spans").collect()
    assert out.count() == sum(len(r.spans) for r in want) > 0
    assert {r.doc_id for r in out.collect()} == {1, 2, None}
