"""External responses (F5-F7, O11-O17) and intake guards."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from fixtures import F4_REVERSED
from kitman import rules as R
from kitman.functions.text import guess_kind, redaction_fragments
from kitman.operators import external as X
from kitman.operators import values as VAL
from kitman.sources import intake as I

def _region(*pairs):
    return {"output": {"elements": [{"type": "keyValueRegion", "pairs": [
        {"key": {"value": k}, "value": {"value": v}, "confidence": c} for k, v, c in pairs]}]}}


F5 = _region(("اسم المريض", "ليلى الزهراني", 0.88), ("Email address", "laila@example.net", 0.93))
F6 = {"output": {"markdown": "Tenant: Laura Bennett\n"}}
F7 = _region(("عنوان السكن", "حي الورود، نجران", 0.77))


def test_candidates_f5(spark):
    df = spark.createDataFrame([(json.dumps(F5, ensure_ascii=False),)], "response string")
    c = df.select(F.explode(X.external_candidates(X.parse_response(F.col("response")))).alias("s")).collect()
    assert [(r.s.kind, r.s.text, r.s.start, r.s.end, r.s.confidence) for r in c] == [
        ("name", "ليلى الزهراني", 0, 0, 0.88), ("email", "laila@example.net", 0, 0, 0.93)]


def test_extract_with_external_f6_and_fallback(spark):
    rows = [("d1", F4_REVERSED, json.dumps(F6)), ("d2", F4_REVERSED, "not json"),
            ("d3", "x", json.dumps(F5, ensure_ascii=False))]
    df = spark.createDataFrame(rows, "document_id string, text string, response string")
    out = {r.document_id: r for r in X.extract_with_external(df).collect()}
    kinds = {(s.kind, s.lang) for s in out["d1"].spans}
    assert ("address", "ar") in kinds and ("name", "ar") in kinds
    assert out["d1"].engine == "external" and out["d2"].engine == "local-fallback"
    assert [s.text for s in out["d3"].spans] == ["ليلى الزهراني", "laila@example.net"]


def test_guess_kind_and_fragments(spark):
    df = spark.createDataFrame([("Residence",), ("E-mail address",), ("الاسم",), ("Note",), (None,)], "k string")
    assert [r[0] for r in df.select(guess_kind(F.col("k"))).collect()] == [
        "national_id", "address", "name", "field", "field"]
    f = spark.createDataFrame([("حي الورود، نجران",), ("ab, abc - abc",)], "v string")
    got = [r[0] for r in f.select(redaction_fragments(F.col("v"))).collect()]
    assert got == [["حي الورود، نجران", "حي الورود", "نجران"], ["ab, abc - abc", "abc"]]


def test_value_redaction_and_log(spark):
    text = "Tenant: حي الورود، نجران and again نجران; keep@example.com"
    spans = ("array<struct<kind:string,text:string,approved:boolean>>")
    df = spark.createDataFrame([(text, [("address", "حي الورود، نجران", True),
                                        ("email", "keep@example.com", False)])],
                               f"text string, spans {spans}")
    r = VAL.operation_log(VAL.redact_values(df, "red")).collect()[0]
    assert "نجران" not in r.red and "keep@example.com" in r.red
    assert r.ops == ["stage_value «حي الورود، نجر…»", "apply_redactions", "seal (hmac-sha256)"]


def test_intake_guards_binary_files(spark):
    d = tempfile.mkdtemp(prefix="kitman-intake-")
    files = {"a.exe": b"x", "ok.TXT": "اسم العميل: ماجد".encode(), "bad.txt": b"ab\xffcd",
             "big.txt": b"a" * (R.MAX_UPLOAD_BYTES + 1), "edge.txt": b"a" * R.MAX_UPLOAD_BYTES,
             "scan.pdf": b"%PDF-1.4"}
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    rows = {os.path.basename(r.path): r for r in I.intake(I.read_files(spark, d)).collect()}
    assert rows["a.exe"].reject_reason == "unsupported_type"
    assert rows["big.txt"].reject_reason == "too_large"
    assert rows["edge.txt"].reject_reason is None
    assert rows["scan.pdf"].reject_reason == "pdf_text_required"
    assert rows["bad.txt"].text == "ab�cd"
    assert rows["ok.TXT"].reject_reason is None and rows["ok.TXT"].document_id.startswith("doc_")
    again = {os.path.basename(r.path): r.document_id for r in I.intake(I.read_files(spark, d)).collect()}
    assert again["ok.TXT"] == rows["ok.TXT"].document_id          # deterministic id
    tbl = spark.createDataFrame([("/x/empty.txt", 0, b""), ("/x/", 3, b"abc")], "path string, length long, content binary")
    t = {r.path: r for r in I.intake(tbl).collect()}
    assert t["/x/empty.txt"].reject_reason == "empty" and t["/x/"].filename == R.DEFAULT_FILENAME
    ids = spark.createDataFrame([("doc_0123456789",), ("doc_../../etc",), ("DOC_0123456789",), (None,)], "i string")
    assert [r[0] for r in ids.select(I.valid_document_id(F.col("i"))).collect()] == [True, False, False, False]


def test_overlapping_values_and_private_use_text(spark):
    spans = "array<struct<kind:string,text:string,approved:boolean>>"
    df = spark.createDataFrame([
        ("x abc def ghi y", [("name", "abc def", True), ("name", "def ghi", True)]),
        ("one \ue000 Laura Bennett end aaaa", [("name", "Laura Bennett", True), ("field", "aaa", True)]),
        (None, [("name", "abc", True)])], f"text string, spans {spans}")
    got = [r.redacted for r in VAL.redact_values(df).collect()]
    assert got == ["x [NAME ███████████] y", "one \ue000 [NAME ████████████] end [FIELD ████]", None]


def test_release_external_leaves_other_text_alone(spark):
    from kitman.plans.release import DEMO_KEY, FIXED_ISSUED_AT, release_external
    text = "Reach laura@example.net or Laura Bennett today, thanks."
    df = spark.createDataFrame([("doc_00000000aa", text, json.dumps(F6)), ("doc_00000000bb", text, "not json")],
                               "document_id string, text string, response string")
    r = {x.document_id: x for x in release_external(df, None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).collect()}
    assert r["doc_00000000aa"].redacted_text == "Reach [EMAIL ████████████] or [NAME ████████████] today, thanks."
    assert r["doc_00000000aa"].operations[-1] == "seal (hmac-sha256)" and r["doc_00000000aa"].signature_valid
    assert r["doc_00000000bb"].engine == "local-fallback" and "Laura Bennett" in r["doc_00000000bb"].redacted_text


def test_long_ids_are_not_cut(spark):
    from kitman.functions.text import document_id_from_key
    df = spark.createDataFrame([(-1,), (-2,), (2**40,), (2**44 + 5,), (2**44 + 6,)], "k long")
    assert len({r[0] for r in df.select(document_id_from_key(F.col("k"))).collect()}) == 5
    tbl = spark.createDataFrame([("/x/a.txt", 3, b"abc")], "path string, length long, content binary")
    assert len(I.intake(tbl, id_width=32).first().document_id) == 36
