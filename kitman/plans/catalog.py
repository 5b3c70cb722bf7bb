"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)`` and reads the given tables — the
``documents`` corpus, or the contract corpus Spark derives from ``customer``
— in full.  Keys start with the inventory id.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..functions.arrays import exploded
from ..operators import external as X
from ..operators import proof as P
from ..operators import review as V
from ..operators import values as VAL
from ..operators.detect import RULES_BY_ID, detect, rule_hits_of, with_span_lang
from ..operators.redact import redact_column
from ..operators.spans import dedupe_exact_offsets, line_label_hits, resolve_overlaps
from ..sources import intake as I
from ..sources.corpus import contract_corpus_from, load
from ..session import shared_folder, spread, stored
from .release import DECISION_SCHEMA, DEMO_KEY, FIXED_ISSUED_AT, extract, release, release_changes, release_external

Query = Callable[[SparkSession, str], DataFrame]

# -- inputs ---------------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a ``document_id`` in the service's id format."""
    d = spread(load(spark, sf_dir, "documents"))
    return d.select("doc_id", T.document_id_from_key(F.col("doc_id")).alias("document_id"), "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(contract_corpus_from(spark, sf_dir).withColumnRenamed("c_custkey", "doc_id"))


def _hits(df: DataFrame, spans_col) -> DataFrame:
    return (exploded(df, spans_col, "doc_id")
            .select("doc_id", "s.start", "s.end", "s.kind", "s.text", "s.confidence"))


def rule_query(rule_id: str, source: str) -> Query:
    rule = RULES_BY_ID[rule_id]

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = documents(spark, sf_dir) if source == "documents" else corpus(spark, sf_dir)
        return _hits(df, rule_hits_of("text", rule))
    return q


def line_query(kind: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = _hits(corpus(spark, sf_dir), line_label_hits(F.col("text")))
        return hits.filter(F.col("kind") == kind)
    return q


# -- working set of the review / release operators -------------------------------
# They run on the full detection of the contract corpus: several spans of most
# kinds a document.

def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(corpus(spark, sf_dir))


def detected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.spans_table(detected(spark, sf_dir), keep=("doc_id",))


def labels_decisions(spark: SparkSession, sf_dir: str, spans: DataFrame | None = None) -> DataFrame:
    """Decisions for the spans of every labelled document, derived from
    ``labels``: first approve = (quality = 1), sent twice; documents flagged toxic
    get a later review with approve = (toxic = 0), which wins; where 7 divides the
    id two reviewers disagree at the same moment; and each span brings a decision
    for a span that does not exist.  ``spans``: the detected spans, if they are there."""
    spans, lab = detected_spans(spark, sf_dir) if spans is None else spans, load(spark, sf_dir, "labels")
    one = lambda span, approved, at: F.struct(
        span.alias("span_id"), approved.alias("approved"), F.lit(at).cast("long").alias("decided_at"), F.lit(1).alias("ord"))
    own, quality, toxic = F.col("span_id"), F.col("quality") == 1, F.col("toxic") == 0
    sent = F.array(
        one(own, quality, 1), one(own, quality, 1), F.when(F.col("toxic") == 1, one(own, toxic, 2)),
        F.when(F.col("doc_id") % 7 == 0, one(own, F.lit(True), 3)), F.when(F.col("doc_id") % 7 == 0, one(own, F.lit(False), 3)),
        one(F.lit("pii_nowhere"), F.lit(False), 9))
    j = spans.select("doc_id", "document_id", "span_id").join(lab, "doc_id")
    return exploded(j, F.array_compact(sent), "document_id").select("document_id", "s.*")


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The contract corpus detected once: its extracts, their spans, the decisions."""
    extracts = stored(detected(spark, sf_dir), "detected")
    spans = V.spans_table(extracts, keep=("doc_id",))
    return extracts, spans, labels_decisions(spark, sf_dir, spans)


# -- queries ----------------------------------------------------------------------

def q_t05_document_language(spark, sf_dir):
    d = documents(spark, sf_dir).unionByName(corpus(spark, sf_dir).select(
        "doc_id", "document_id", "text"))
    return d.select("document_id", T.document_language(F.col("text")).alias("lang"),
                    F.char_length("text").alias("char_count"))


def q_t01_fold_digits(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.select("doc_id", T.fold_arabic_digits(F.col("text")).alias("folded"),
                    (F.char_length(T.fold_arabic_digits(F.col("text"))) == F.char_length("text")).alias("same_length"))


def q_t03_clean_value(spark, sf_dir):
    """T02+T03 on every line of the contract corpus."""
    c = corpus(spark, sf_dir)
    lines = exploded(c, F.split("text", "\n", -1), "doc_id", item="line", position="line_no")
    return lines.select("doc_id", "line_no", T.clean_value(F.col("line")).alias("cleaned"))


def q_t08_guess_kind(spark, sf_dir):
    """Kind of every ``label: value`` label of the contract corpus lines."""
    c = corpus(spark, sf_dir)
    lines = exploded(c, F.split("text", "\n", -1), "doc_id", item="line", position="line_no")
    lab = lines.filter(F.col("line").contains(": ")).select(
        "doc_id", "line_no", F.substring_index("line", ": ", 1).alias("label"))
    return lab.select("doc_id", "line_no", "label", T.guess_kind(F.col("label")).alias("kind"))


def q_t09_fragments(spark, sf_dir):
    sp = _hits(corpus(spark, sf_dir), line_label_hits(F.col("text")))
    return exploded(sp, T.redaction_fragments(F.col("text")), "doc_id", "start", item="fragment", position="pos")


def q_t10_value_preview(spark, sf_dir):
    sp = detected_spans(spark, sf_dir)
    return sp.select("document_id", "span_id", T.value_preview(F.col("text")).alias("preview"))


def q_t12_sha256(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("document_id", T.sha256_hex(F.col("text")).alias("sha256"))


def q_t13_iso_utc(spark, sf_dir):
    e = load(spark, sf_dir, "orders").select("o_orderkey")
    ts = F.lit(FIXED_ISSUED_AT) + F.col("o_orderkey") * 3601
    return e.select("o_orderkey", ts.alias("epoch"), T.iso_utc(ts).alias("iso"))


def line_spans(spark, sf_dir) -> DataFrame:
    """Per-line label spans (D24) of the contract corpus as a spans table."""
    c = corpus(spark, sf_dir)
    return V.spans_table(c.withColumn("spans", with_span_lang(
        F.coalesce(line_label_hits(F.col("text")), F.array().cast(
            "array<struct<start:int,end:int,rule:int,seq:int,bstart:int,bend:int,"
            "kind:string,text:string,confidence:double>>")))))


def q_t16_review_flags(spark, sf_dir):
    return q_o13_extract_external(spark, sf_dir).select(
        "doc_id", "n", T.confidence_percent(F.col("confidence")).alias("pct"), T.low_confidence(F.col("confidence")).alias("low"))


def q_t17_kind_label(spark, sf_dir):
    sp = line_spans(spark, sf_dir)
    ui = F.when(F.col("lang") == "ar", "ar").otherwise("en")
    return sp.select("document_id", "span_id", "kind", "lang", T.kind_label(F.col("kind"), ui).alias("label"))


def q_t18_redaction_bar(spark, sf_dir):
    sp = detected_spans(spark, sf_dir)
    return sp.select("document_id", "span_id", T.redaction_bar(F.col("kind"), F.col("text")).alias("bar"))


def q_d25_detect(source: str) -> Query:
    def q(spark, sf_dir):
        df = documents(spark, sf_dir) if source == "documents" else corpus(spark, sf_dir)
        return (exploded(detect(df), "spans", "doc_id")
                .select("doc_id", "n", "s.start", "s.end", "s.kind", "s.text", "s.confidence", "s.lang"))
    return q


def q_o01_dedupe(spark, sf_dir):
    c = corpus(spark, sf_dir)
    from ..operators.detect import candidate_spans
    return _hits(c, dedupe_exact_offsets(candidate_spans(F.col("text"))))


def q_o02_resolve(spark, sf_dir):
    """Overlap resolution over the raw hits of all rules on the contract corpus
    (phone hits overlap national ids, IBANs and cards, labels overlap them all)."""
    d = corpus(spark, sf_dir)
    from ..operators.detect import candidate_spans
    return _hits(d, resolve_overlaps(dedupe_exact_offsets(candidate_spans(F.col("text")))))


def q_o03_redact(spark, sf_dir):
    e = detected(spark, sf_dir)
    return e.select("doc_id", redact_column(F.col("text"), F.col("spans"), None).alias("redacted"))


def q_o04_approved(spark, sf_dir):
    _, spans, decisions = reviewed(spark, sf_dir)
    sp = V.apply_decisions(spans, decisions)
    return V.approved_only(sp).select("document_id", "span_id", "start", "end")


def q_o05_apply_decisions(spark, sf_dir):
    _, spans, decisions = reviewed(spark, sf_dir)
    sp = V.apply_decisions(spans, decisions)
    return sp.select("document_id", "span_id", "start", "approved")


def q_o06_latest_decision(spark, sf_dir):
    return V.latest_decisions(labels_decisions(spark, sf_dir))


def q_o07_unknown_documents(spark, sf_dir):
    """Decisions keyed by ``labels.doc_id`` whose document does not exist."""
    lab = load(spark, sf_dir, "labels")
    dec = lab.select(T.document_id_from_key(F.col("doc_id") * 7).alias("document_id"),
                     F.lit("pii_0000000000").alias("span_id"), (F.col("toxic") == 0).alias("approved"))
    return V.unknown_document_decisions(dec, documents(spark, sf_dir))


def q_o08_counts(spark, sf_dir):
    _, spans, decisions = reviewed(spark, sf_dir)
    sp = V.apply_decisions(spans, decisions)
    return V.review_counts(corpus(spark, sf_dir), sp)


def q_o09_proof(spark, sf_dir):
    extracts, _, decisions = reviewed(spark, sf_dir)
    r = release(extracts, decisions, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return r.select("document_id", "redacted_count", F.col("proof.original_sha256").alias("original_sha256"),
                    F.col("proof.redacted_sha256").alias("redacted_sha256"),
                    F.col("proof.issued_at_iso").alias("issued_at_iso"), "body_json")


def q_o10_seal(spark, sf_dir):
    extracts, _, decisions = reviewed(spark, sf_dir)
    r = release(extracts, decisions, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return r.select("document_id", "seal", "key_id")


def _sealed(spark, sf_dir):
    extracts, _, decisions = reviewed(spark, sf_dir)
    r = release(extracts, decisions, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return r.select("document_id", "proof", "seal")


def q_o18_verify(spark, sf_dir):
    return P.verify(_sealed(spark, sf_dir), DEMO_KEY)


def q_o19_tamper(spark, sf_dir):
    """One altered copy of each proof per field and per way to alter the items."""
    sealed = _sealed(spark, sf_dir)
    proof, items = F.col("proof"), F.col("proof.redactions")
    item = lambda **k: F.struct(*(F.lit(k.get(n, v)).cast(t).alias(n) for n, v, t in (
        ("confidence", 0.9, "double"), ("kind", "name", "string"), ("lang", "en", "string"), ("length", 9, "int"))))
    ways = {
        "count": proof.withField("redaction_count", F.lit(R.TAMPER_COUNT)),
        "text_field": proof.withField("product", F.concat(F.col("proof.product"), F.lit('", "x": "'))),
        "time": proof.withField("issued_at", F.col("proof.issued_at") + 1),
        "null_field": proof.withField("original_sha256", F.lit(None).cast("string")),
        "added": proof.withField("redactions", F.concat(items, F.array(item()))),
        "added_null": proof.withField("redactions", F.concat(items, F.array(item(kind=None)))),
        "dropped": F.when(F.size(items) > 0, proof.withField("redactions", F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))))
        .otherwise(proof.withField("document_id", F.lit("doc_0000000000"))),
    }
    copies = F.explode(F.array(*(F.struct(F.lit(w).alias("way"), p.alias("proof")) for w, p in ways.items())))
    altered = sealed.select("document_id", "seal", copies.alias("c")).select("document_id", "seal", "c.*")
    valid = P.seal_valid(F.col("proof"), F.col("seal"), DEMO_KEY)
    return altered.select("document_id", valid.alias("valid"), T.verify_message(valid).alias("detail"), "way")


def q_o20_reject_all(spark, sf_dir):
    sp = V.decide_all(detected_spans(spark, sf_dir), False)
    return V.review_counts(corpus(spark, sf_dir), sp)


def q_o21_review_list(spark, sf_dir):
    return V.review_list(V.spans_table(extract(corpus(spark, sf_dir))), "en")


def q_o22_release(spark, sf_dir):
    r = release(extract(documents(spark, sf_dir)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return r.select("document_id", "redacted_count", "redacted_preview", "seal")


def q_o22_release_corpus(spark, sf_dir):
    r = release(extract(corpus(spark, sf_dir)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return r.select("document_id", "redacted_count", "redacted_text", "seal")


# external responses derived from customer rows (same SQL text in DuckDB)
RESPONSE_SQL = (
    "CASE WHEN c_custkey % 11 = 0 THEN 'not json' ELSE concat("
    "'{\"output\": {', CASE WHEN c_custkey % 5 = 0 THEN concat('\"markdown\": \"Tenant: ', c_name, '\", ') ELSE '' END, "
    "'\"elements\": [{\"type\": \"keyValueRegion\", \"pairs\": ["
    "{\"key\": {\"value\": \"الاسم\"}, \"value\": {\"value\": \"', c_name, '\"}, \"confidence\": ', CASE WHEN c_custkey % 4 = 0 THEN '0.5549' ELSE '0.9151' END, '}, "
    "{\"key\": {\"value\": \"Email\"}, \"value\": {\"value\": \"c', cast(c_custkey as string), '@example.com\"}, "
    "\"confidence\": ', CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '0.99' END, '}, "
    "{\"key\": {\"value\": \"Residence\"}, \"value\": {\"value\": \"حي السلام، حائل\"}}, "
    "{\"key\": {\"value\": \"Note\"}, \"value\": {\"value\": \"\"}, \"confidence\": 0.5}]}, "
    "{\"type\": \"paragraph\", \"text\": \"Phone: +966 55 ', lpad(cast(c_custkey % 1000 as string), 3, '0'), ' 1234\"}]}}') END")


def responses(spark, sf_dir):
    c = corpus(spark, sf_dir)
    cust = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name",
                                                  F.expr(RESPONSE_SQL).alias("response"))
    return c.join(cust, "doc_id")


def q_s06_parse(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("doc_id", F.try_parse_json(F.col("response")).isNotNull().alias("valid_json"),
                    X.external_text(X.parse_response(F.col("response"))).alias("ext_text"))


def q_o11_external_candidates(spark, sf_dir):
    r = responses(spark, sf_dir)
    c = exploded(r, X.external_candidates(X.parse_response(F.col("response"))), "doc_id")
    return c.select("doc_id", F.concat(F.lit("ext_"), F.col("n").cast("string")).alias("span_id"),
                    "s.kind", "s.text", "s.start", "s.end", "s.confidence")


def q_o13_extract_external(spark, sf_dir):
    r = X.extract_with_external(responses(spark, sf_dir))
    return (exploded(r, "spans", "doc_id", "engine")
            .select("doc_id", "engine", "n", "s.kind", "s.text", "s.start", "s.end", "s.confidence"))


def q_o12_merge(spark, sf_dir):
    """O12 as sets: the distinct (kind, text) that own, external and candidate
    spans merge to, and how often each stays."""
    r = X.extract_with_external(responses(spark, sf_dir))
    return (exploded(r, "spans", "doc_id").groupBy("doc_id", "s.kind", "s.text")
            .agg(F.count("*").alias("n")))


def reviewed_extracts(spark, sf_dir) -> DataFrame:
    """Contract corpus extracts whose spans carry span_id/approved; e-mail
    spans of documents with k % 5 = 0 are rejected by the reviewer."""
    e = extract(corpus(spark, sf_dir))
    no_map = F.lit(None).cast("array<struct<k:string,v:boolean>>")
    spans = V.apply_decision_map(F.col("spans"), F.col("document_id"), no_map)
    spans = F.transform(spans, lambda s: s.withField("approved", ~(
        (s["kind"] == "email") & (F.col("doc_id") % 5 == 0))))
    return e.withColumn("spans", spans)


def q_o14_approved_values(spark, sf_dir):
    e = reviewed_extracts(spark, sf_dir)
    return exploded(e, VAL.approved_values(F.col("spans")), "doc_id", item="v").select(
        "doc_id", "n", "v.value", "v.kind")


def q_o15_value_redaction(spark, sf_dir):
    e = reviewed_extracts(spark, sf_dir)
    return VAL.redact_values(e.select("doc_id", "text", "spans")).select("doc_id", "redacted")


def q_o16_safety_net(spark, sf_dir):
    e = extract(documents(spark, sf_dir)).withColumn("spans", V.apply_decision_map(
        F.col("spans"), F.col("document_id"), F.lit(None).cast("array<struct<k:string,v:boolean>>")))
    out = VAL.redact_values(e.select("doc_id", "text", "spans")).select("doc_id", "redacted")
    return VAL.safety_net(out, "redacted")


def q_o17_operation_log(spark, sf_dir):
    e = reviewed_extracts(spark, sf_dir)
    return VAL.operation_log(e.select("doc_id", "text", "spans")).select("doc_id", "ops")


def intake_rows(spark, sf_dir):
    """Intake input built from ``documents``: a path whose extension cycles
    by id, the UTF-8 bytes of the text as content."""
    d = load(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in [".txt", ".TXT", ".pdf", ".html", ""]]),
                       (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return d.select("doc_id", F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/doc"),
                                       F.col("doc_id").cast("string"), ext).alias("path"),
                    F.octet_length(content).alias("length"), content.alias("content"))


def q_s03_intake_guards(spark, sf_dir):
    rows = I.intake(intake_rows(spark, sf_dir))
    return rows.select("path", "filename", "length", "reject_reason",
                       F.col("document_id").isNotNull().alias("has_id"))


def q_s02_decode(spark, sf_dir):
    rows = intake_rows(spark, sf_dir)
    return rows.select("doc_id", I.decode_utf8(F.col("content")).alias("text"))


def q_s04_document_id(spark, sf_dir):
    rows = intake_rows(spark, sf_dir)
    return rows.select("path", I.document_id_for(F.col("path"), F.col("content")).alias("document_id"))


def q_s05_valid_id(spark, sf_dir):
    d = documents(spark, sf_dir)
    cand = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../"), F.col("document_id")))
                    .when(F.col("doc_id") % 3 == 1, F.upper("document_id"))
                    .otherwise(F.col("document_id")).alias("candidate"))
    return cand.select("doc_id", "candidate", I.valid_document_id(F.col("candidate")).alias("valid"))


def q_s09_clean_copy(spark, sf_dir):
    from ..sources.sinks import clean_copy
    d = documents(spark, sf_dir)
    raw = load(spark, sf_dir, "documents").select("doc_id", "lang")
    # English documents also have a signed copy; every document is released
    signed = d.join(raw.filter(F.col("lang") == "en"), "doc_id", "left_semi").select(
        "document_id", F.concat(F.lit("signed/"), F.col("document_id"), F.lit(".pdf")).alias("uri"))
    red = release(extract(d), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).select(
        "document_id", F.col("redacted_text").alias("text"))
    lab = load(spark, sf_dir, "labels")
    req = lab.select(T.document_id_from_key(F.col("doc_id")).alias("document_id")).unionByName(
        lab.select(T.document_id_from_key(F.col("doc_id") * 7 + 3).alias("document_id")))
    return clean_copy(req, signed, red).select("document_id", "source")


def q_s10_proof_lookup(spark, sf_dir):
    from ..sources.sinks import proof_lookup
    req = load(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(
        T.document_id_from_key(F.col("doc_id")).alias("document_id"))
    return proof_lookup(req, _sealed(spark, sf_dir)).select("document_id", "seal")


def q_st1_stream_detect(spark, sf_dir):
    """ST1: the ``documents`` file consumed as a stream (availableNow);
    output must equal batch detection (D25)."""
    import os
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming.pipelines import stream_detect_table
    run = os.path.join(ensure_checkpoint_dir(spark), "st1-" + uuid.uuid4().hex)
    return stream_detect_table(spark, sf_dir, "documents", os.path.join(run, "out"),
                               os.path.join(run, "checkpoint"))


def q_st2_stream_decisions(spark, sf_dir):
    """ST2: stored extracts + reviewer decisions arriving as JSON files on a
    stream, which stops and goes on from its checkpoint when the later ones have
    come; releases of the touched documents must equal the batch release."""
    import os
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import write_rows
    from ..streaming.pipelines import read_latest, start_decisions
    run = os.path.join(ensure_checkpoint_dir(spark), "st2-" + uuid.uuid4().hex)
    state, dec_dir = os.path.join(run, "state"), os.path.join(run, "decisions")
    extracts, _, decisions = reviewed(spark, sf_dir)
    write_rows(extracts.select("document_id", "text", "spans", "engine"), os.path.join(state, "extracts"))
    sent = stored(decisions, "sent")
    for part in ("decided_at = 1", "decided_at > 1"):
        sent.filter(part).write.mode("append").json(dec_dir)
        q = start_decisions(spark, dec_dir, state, key=DEMO_KEY, checkpoint=os.path.join(run, "checkpoint"),
                            issued_at=FIXED_ISSUED_AT)
        q.awaitTermination()
    return read_latest(spark, os.path.join(state, "releases")).select("document_id", "redacted_count", "seal")


# -- stores: write all, rewrite some, read back -----------------------------------

def _corpus_release(spark, sf_dir, issued_at=FIXED_ISSUED_AT):
    return release(detected(spark, sf_dir), None, key=DEMO_KEY, issued_at=issued_at)


def q_s07_clean_text(spark, sf_dir):
    """Clean texts of all documents, then of every seventh again, revised."""
    from ..sources import sinks
    path = shared_folder(spark, "s07")
    sinks.write_clean_text(_corpus_release(spark, sf_dir), path)
    again = corpus(spark, sf_dir).filter("doc_id % 7 = 0").select("document_id")
    revised = sinks.read_rows(spark, path, only=again).select(
        "document_id", F.concat(F.lit("revised: "), F.col("text")).alias("redacted_text"))
    sinks.write_clean_text(revised, path)
    return sinks.read_rows(spark, path).select("document_id", "text")


def q_s08_proofs(spark, sf_dir):
    """Proofs of all documents, then of every seventh issued an hour later."""
    from ..sources import sinks
    path = shared_folder(spark, "s08")
    sinks.write_proofs(_corpus_release(spark, sf_dir), path)
    later = release(detected(spark, sf_dir).filter("doc_id % 7 = 0"), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT + 3600)
    sinks.write_proofs(later, path)
    return sinks.read_rows(spark, path, "json").select("document_id", "body_json", "seal")


def q_s11_state(spark, sf_dir):
    """Span state of all documents, then of every seventh with all e-mails rejected."""
    from ..sources import sinks
    path = shared_folder(spark, "s11")
    spans = sinks.save_table(detected_spans(spark, sf_dir), path)
    again = spans.filter("doc_id % 7 = 0").withColumn("approved", F.col("kind") != "email")
    return sinks.save_table(again, path).select("document_id", "span_id", "approved")


def q_s11_erased(spark, sf_dir):
    """Span state of all documents; every seventh is then stored again with its
    structured kinds only (none, for some), every eleventh erased, and the versions
    folded and cleaned."""
    from ..sources import sinks
    path = shared_folder(spark, "s11")
    spans = sinks.save_table(detected_spans(spark, sf_dir).select("document_id", "doc_id", "span_id", "kind"), path)
    ids = corpus(spark, sf_dir).select("doc_id", "document_id")
    again = spans.filter("doc_id % 7 = 0 and kind in ('email', 'iban', 'credit_card', 'ip_address')")
    sinks.write_rows(again, path, documents=ids.filter("doc_id % 7 = 0").select("document_id"))
    sinks.erase(spark, path, ids.filter("doc_id % 11 = 0").select("document_id"))
    sinks.fold_versions(spark, path, every=True)
    sinks.clean(spark, path, older_than_s=0)
    return sinks.read_rows(spark, path).select("document_id", "span_id", "kind")


def q_s10_stored_proofs(spark, sf_dir):
    """Lookups in the proof sink: the files that hold a requested id, and no others."""
    from ..sources import sinks
    path = shared_folder(spark, "s10")
    extracts, _, decisions = reviewed(spark, sf_dir)
    sinks.write_proofs(release(extracts, decisions, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT), path)
    req = load(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(
        T.document_id_from_key(F.col("doc_id")).alias("document_id"))
    return sinks.stored_proofs(req, path).select("document_id", "seal")


def q_s01_intake_files(spark, sf_dir):
    """The texts of ``documents`` as files, one each (a line feed after the text),
    read back with a limit of 4 KiB: larger ones are turned away unread."""
    from ..sources import sinks
    docs, path = load(spark, sf_dir, "documents"), shared_folder(spark, "s01")
    sinks.write_text_files(docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("value")), path)
    rows = I.intake_files(spark, path, max_bytes=4096)
    return rows.select(F.regexp_extract("path", r"/doc=(-?\d+)(?:/|\.txt$)", 1).try_cast("long").alias("doc_id"), "length", "reject_reason",
                       F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def q_o22_release_changes(spark, sf_dir):
    """Release of all documents under the first decisions; when the later ones are
    there, only the documents they name are released again."""
    from ..sources import sinks
    run = shared_folder(spark, "o22")
    extracts, _, decisions = reviewed(spark, sf_dir)
    sent = stored(decisions, "sent")
    sinks.write_rows(extracts.select("document_id", "text", "spans", "engine"), f"{run}/extracts")
    for part in ("decided_at = 1", "decided_at > 1"):
        fresh = sent.filter(part)
        held = sinks.read_rows(spark, f"{run}/decisions", schema=DECISION_SCHEMA, only=fresh).select(*fresh.columns)
        sinks.write_rows(fresh.unionByName(held), f"{run}/decisions")
        release_changes(spark, f"{run}/extracts", f"{run}/decisions", f"{run}/releases", key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return sinks.read_rows(spark, f"{run}/releases").select("document_id", "seal", "key_id")


def q_o18_verify_requests(spark, sf_dir):
    """Lookups by id: known, unknown and malformed ids."""
    lab = load(spark, sf_dir, "labels").select("doc_id").distinct()
    ids = F.array(T.document_id_from_key(F.col("doc_id")), F.concat(F.lit("../doc_"), F.col("doc_id").cast("string")))
    req = lab.select(F.explode(ids).alias("document_id"))
    return P.verify_requests(req, _sealed(spark, sf_dir), DEMO_KEY).select("document_id", "found", "valid", "detail")


def q_o18_verify_key_ring(spark, sf_dir):
    """Proofs sealed under three keys by turns; the ring holds two of them, and the
    stored seal of every fifth proof is of another proof's body."""
    extracts, _, decisions = reviewed(spark, sf_dir)
    proofs = release(extracts, decisions, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT).select("document_id", "proof")
    number = F.conv(F.substring("document_id", 5, 10), 16, 10).cast("long")
    old, lost = b"kitman-retired-key", b"kitman-lost-key"
    sealed = None
    for turn, key in enumerate((DEMO_KEY, old, lost)):
        part = P.seal(proofs.filter(number % 3 == turn), key)
        sealed = part if sealed is None else sealed.unionByName(part)
    altered = F.when(number % 5 == 0, F.col("proof").withField("issued_at", F.col("proof.issued_at") + 1)).otherwise(F.col("proof"))
    return P.verify(sealed.withColumn("proof", altered), P.key_ring(DEMO_KEY, old)).select("document_id", "valid", "detail")


def q_o22_release_external(spark, sf_dir):
    """External path over derived responses; e-mail spans of documents whose id 5
    divides are rejected."""
    docs = responses(spark, sf_dir).select("doc_id", "document_id", "text", "response")
    spans = V.spans_table(X.extract_with_external(docs), keep=("doc_id",))
    rejected = spans.filter((F.col("kind") == "email") & (F.col("doc_id") % 5 == 0)).select(
        "document_id", "span_id", F.lit(False).alias("approved"), F.lit(1).cast("long").alias("decided_at"), F.lit(1).alias("ord"))
    r = release_external(docs, rejected, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)
    return r.select("document_id", "engine", "redacted_count", "redacted_text", "operations", "signature_valid")


def corpus_lines(spark, sf_dir) -> DataFrame:
    c = corpus(spark, sf_dir)
    return exploded(c, F.split("text", "\n", -1), "doc_id", item="line", position="line_no")


def q_t02_strip_bidi(spark, sf_dir):
    return corpus_lines(spark, sf_dir).select("doc_id", "line_no", T.strip_bidi(F.col("line")).alias("stripped"))


def q_t04_either_order(spark, sf_dir):
    """Lines containing a label phrase of each per-line kind, forward or
    word-reversed (the phrase patterns built by T04)."""
    from ..functions import dialect
    lines = corpus_lines(spark, sf_dir)
    hits = F.array(*[F.when(F.col("line").rlike(dialect.line_label_pattern(ph)), F.lit(k))
                     for k, ph in R.LINE_LABEL_SPECS])
    return exploded(lines, F.array_compact(hits), "doc_id", "line_no", item="kind", position="i").drop("i")


def q_t06_span_language(spark, sf_dir):
    return corpus_lines(spark, sf_dir).select("doc_id", "line_no", T.span_language(F.col("line")).alias("lang"))


def q_t07_span_id(spark, sf_dir):
    return detected_spans(spark, sf_dir).select("document_id", "start", "span_id")


def q_t11_text_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", T.text_preview(F.col("text")).alias("preview"))


def q_t14_round_length(spark, sf_dir):
    return q_o13_extract_external(spark, sf_dir).select(
        "doc_id", "n", F.round("confidence", 2).alias("confidence"), F.char_length("text").alias("length"))


def q_t15_char_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.char_length("text").alias("char_count"))


def q_t19_verify_message(spark, sf_dir):
    sealed = _sealed(spark, sf_dir)
    ok = P.verify(sealed, DEMO_KEY).select("document_id", "valid", "detail", F.lit("stored").alias("copy"))
    bad = P.verify(P.tamper(sealed), DEMO_KEY).select("document_id", "valid", "detail", F.lit("tampered").alias("copy"))
    return ok.unionByName(bad)


def build() -> dict[str, Query]:
    q: dict[str, Query] = {
        "d01_email": rule_query("structured:email", "documents"),
        "d02_iban": rule_query("structured:iban", "corpus"),
        "d03_credit_card": rule_query("structured:credit_card", "documents"),
        "d03_credit_card_corpus": rule_query("structured:credit_card", "corpus"),
        "d04_national_id": rule_query("structured:national_id", "corpus"),
        "d05_phone": rule_query("structured:phone", "documents"),
        "d05_phone_corpus": rule_query("structured:phone", "corpus"),
        "d06_ip_address": rule_query("structured:ip_address", "documents"),
        "d07_name_en": rule_query("label_en:name", "corpus"),
        "d08_address_en": rule_query("label_en:address", "corpus"),
        "d09_dob_en": rule_query("label_en:dob", "documents"),
        "d09_dob_en_corpus": rule_query("label_en:dob", "corpus"),
        "d10_iban_en": rule_query("label_en:iban", "corpus"),
        "d11_name_ar": rule_query("label_ar:name", "corpus"),
        "d12_address_ar": rule_query("label_ar:address", "corpus"),
        "d13_dob_ar": rule_query("label_ar:dob", "corpus"),
        "d14_national_id_ar": rule_query("label_ar:national_id", "corpus"),
        "d15_phone_ar": rule_query("label_ar:phone", "corpus"),
        "d16_iban_ar": rule_query("label_ar:iban", "corpus"),
    }
    for i, (kind, _) in enumerate(R.LINE_LABEL_SPECS):
        q[f"d{17 + i}_{kind}_line"] = line_query(kind)
    q.update({
        "d25_detect_documents": q_d25_detect("documents"),
        "d25_detect_corpus": q_d25_detect("corpus"),
        "t01_fold_digits": q_t01_fold_digits,
        "t02_strip_bidi": q_t02_strip_bidi,
        "t04_either_order": q_t04_either_order,
        "t06_span_language": q_t06_span_language,
        "t07_span_id": q_t07_span_id,
        "t11_text_preview": q_t11_text_preview,
        "t14_round_length": q_t14_round_length,
        "t15_char_count": q_t15_char_count,
        "t19_verify_message": q_t19_verify_message,
        "t03_clean_value": q_t03_clean_value,
        "t05_document_language": q_t05_document_language,
        "t08_guess_kind": q_t08_guess_kind,
        "t09_fragments": q_t09_fragments,
        "t10_value_preview": q_t10_value_preview,
        "t12_sha256": q_t12_sha256,
        "t13_iso_utc": q_t13_iso_utc,
        "t16_review_flags": q_t16_review_flags,
        "t17_kind_label": q_t17_kind_label,
        "t18_redaction_bar": q_t18_redaction_bar,
        "o01_dedupe": q_o01_dedupe,
        "o02_resolve": q_o02_resolve,
        "o03_redact": q_o03_redact,
        "o04_approved": q_o04_approved,
        "o05_apply_decisions": q_o05_apply_decisions,
        "o06_latest_decision": q_o06_latest_decision,
        "o07_unknown_documents": q_o07_unknown_documents,
        "o08_counts": q_o08_counts,
        "o09_proof": q_o09_proof,
        "o10_seal": q_o10_seal,
        "o11_external_candidates": q_o11_external_candidates,
        "o12_merge": q_o12_merge,
        "o13_extract_external": q_o13_extract_external,
        "o14_approved_values": q_o14_approved_values,
        "o15_value_redaction": q_o15_value_redaction,
        "o16_safety_net": q_o16_safety_net,
        "o17_operation_log": q_o17_operation_log,
        "o18_verify": q_o18_verify,
        "o19_tamper": q_o19_tamper,
        "o20_reject_all": q_o20_reject_all,
        "o21_review_list": q_o21_review_list,
        "o22_release": q_o22_release,
        "o22_release_external": q_o22_release_external,
        "o18_verify_requests": q_o18_verify_requests,
        "o18_verify_key_ring": q_o18_verify_key_ring,
        "s07_clean_text": q_s07_clean_text,
        "s08_proofs": q_s08_proofs,
        "s11_state": q_s11_state,
        "s11_erased": q_s11_erased,
        "s10_stored_proofs": q_s10_stored_proofs,
        "s01_intake_files": q_s01_intake_files,
        "o22_release_changes": q_o22_release_changes,
        "o22_release_corpus": q_o22_release_corpus,
        "s02_decode": q_s02_decode,
        "s03_intake_guards": q_s03_intake_guards,
        "s04_document_id": q_s04_document_id,
        "s05_valid_id": q_s05_valid_id,
        "s06_parse": q_s06_parse,
        "s09_clean_copy": q_s09_clean_copy,
        "s10_proof_lookup": q_s10_proof_lookup,
        "st1_stream_detect": q_st1_stream_detect,
        "st2_stream_decisions": q_st2_stream_decisions,
    })
    return q
