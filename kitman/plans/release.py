"""End-to-end compositions: extraction (3.1) and release (O22, 3.2).

``extract``   documents → one row per document with lang, char_count, spans.
``release``   extracts (+ decisions) → redacted text, proof, seal.
``release_external``  the same for documents with an external response.
``release_changes``   stored extracts and decisions → releases of what has changed.

Detection, decision application, redaction and the proof are all computed
inside the document row.  The only exchange is the decisions join: latest
decisions are folded to one map per document (partial aggregation first),
and joined on ``document_id``; AQE broadcasts that side when it is small at
run time and sort-merge joins otherwise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.arrays import let
from ..functions.text import text_preview
from ..operators.detect import detect
from ..operators.proof import build_proof, hmac_sha256_hex, canonical_json, key_id
from ..operators.redact import redact_column
from ..operators.external import extract_with_external
from ..operators.review import NO_DECISIONS, apply_decision_map, decisions_as_map, spans_table
from ..operators.values import located, operations
from ..session import stored
from ..sources import sinks

DEMO_KEY = b"kitman-demo-seal-key"          # tests and registered queries only
FIXED_ISSUED_AT = 1767225600                # 2026-01-01T00:00:00Z, deterministic runs


def extract(documents: DataFrame, text_col: str = "text") -> DataFrame:
    return detect(documents, text_col).withColumn("engine", F.lit("local-fallback"))


def _sorted_disjoint(spans: Column) -> Column:
    """The spans, or an error if those with an extent overlap or are out of order."""
    def check(A: Column) -> Column:
        n = F.size(A)
        clash = F.when(n > 1, F.exists(F.zip_with(
            F.slice(A, 1, F.greatest(n - 1, F.lit(0))), F.slice(A, 2, F.greatest(n - 1, F.lit(0))),
            lambda x, y: x["end"] > y["start"]), lambda c: c)).otherwise(F.lit(False))
        return F.when(clash, F.raise_error(F.lit("spans to redact overlap or are not sorted by start"))).otherwise(spans)
    return let(F.filter(spans, lambda s: s["end"] > s["start"]), check)


def _decided(docs: DataFrame, decisions: DataFrame | None, co_partitions: int | None, known: DataFrame | None) -> DataFrame:
    """``spans`` with span_id and approved by the latest decisions."""
    if decisions is not None:
        docs = docs.join(decisions_as_map(decisions, co_partitions, known), "document_id", "left")
    else:
        docs = docs.withColumn("decided", F.lit(None).cast(NO_DECISIONS))
    return docs.withColumn("spans", apply_decision_map(F.col("spans"), F.col("document_id"), F.col("decided")))


def _finish(staged: DataFrame, text: Column, key: bytes, issued_at: Column | int | None, product: str) -> DataFrame:
    """Proof, seal and result columns for rows with spans, redacted_text and operations."""
    if issued_at is None:
        issued = F.unix_timestamp(F.current_timestamp())
    else:
        issued = issued_at if isinstance(issued_at, Column) else F.lit(issued_at)
    staged = staged.withColumn("proof", build_proof(
        F.col("document_id"), text, F.col("redacted_text"), F.col("spans"), issued.cast("long"), product))
    staged = staged.withColumn("body_json", canonical_json(F.col("proof")))
    staged = staged.withColumn("seal", hmac_sha256_hex(F.col("body_json"), key))
    return staged.select(
        "document_id",
        F.col("proof.redaction_count").alias("redacted_count"),
        text_preview(F.col("redacted_text")).alias("redacted_preview"),
        F.col("document_id").alias("proof_id"),
        "engine", "redacted_text", "proof", "body_json", "seal",
        F.lit(key_id(key)).alias("key_id"),
        F.col("seal").isNotNull().alias("signature_valid"),   # sealed from this very body
        "operations",
    )


def release(extracts: DataFrame, decisions: DataFrame | None = None, *, key: bytes,
            issued_at: Column | int | None = None, product: str = R.PRODUCT,
            text_col: str = "text", co_partitions: int | None = None,
            known_spans: DataFrame | None = None) -> DataFrame:
    """Redacted text, proof and seal of every document.  ``key``: the seal's
    secret.  Null text is empty text.  Spans must be sorted and disjoint (O02).

    ``co_partitions``: pass the bucket count when ``extracts`` is a table
    bucketed by ``document_id`` (``sinks.save_extracts_bucketed``, with at
    least ``spark.sql.shuffle.partitions`` buckets) so only decisions move.
    ``known_spans``: the stored spans table; decisions for other spans are then
    dropped before they are gathered by document."""
    docs = extracts if "engine" in extracts.columns else extracts.withColumn("engine", F.lit("local-fallback"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = _decided(docs, decisions, co_partitions, known_spans)
    staged = staged.withColumn("redacted_text", redact_column(text, _sorted_disjoint(F.col("spans"))))
    return _finish(staged.withColumn("operations", F.array().cast("array<string>")), text, key, issued_at, product)


def release_external(docs: DataFrame, decisions: DataFrame | None = None, *, key: bytes,
                     issued_at: Column | int | None = None, product: str = R.PRODUCT,
                     known_spans: DataFrame | None = None) -> DataFrame:
    """docs(document_id, text, response) → release by the external path: merged
    extraction (O13), decisions (O05), exact-value redaction in the own text (O15)
    with its operation log (O17), proof over the released text (O09).  Documents
    whose response is unusable take the local path."""
    staged = _decided(extract_with_external(docs), decisions, None, known_spans)
    text, outside = F.coalesce(F.col("text"), F.lit("")), F.col("engine") == "external"
    staged = located(staged)
    staged = staged.withColumn("redacted_text", F.when(
        outside, redact_column(text, F.col("_located.spans"), approved_field=None)).otherwise(redact_column(text, F.col("spans"))))
    staged = staged.withColumn("operations", F.when(outside, operations(F.col("_values"), F.col("_located.found")))
                               .otherwise(F.array().cast("array<string>")))
    return _finish(staged, text, key, issued_at, product)


DECISION_SCHEMA = "document_id string, span_id string, approved boolean, decided_at long, ord int"


def release_changes(spark: SparkSession, extracts: str, decisions: str, releases: str, *, key: bytes,
                    issued_at: Column | int | None = None, product: str = R.PRODUCT) -> int:
    """O22 between stores: releases the documents whose extracts or decisions were
    written since the last call, and no others; returns how many.

    The new version of ``releases`` notes up to which commits of the two stores it
    goes, so what was released and what is noted cannot come apart, and a call that
    fails is made good by the next.  An erased document loses its release."""
    done = sinks.noted(spark, releases)
    feeds = {name: sinks.changed(spark, path, done.get(name, 0)) for name, path in (("extracts", extracts), ("decisions", decisions))}
    marks = {name: number for name, (_, number, _) in feeds.items()}
    if marks == {name: done.get(name, 0) for name in marks}:
        return 0
    fresh = feeds["extracts"][0].unionByName(feeds["decisions"][0])
    if any(whole for _, _, whole in feeds.values()):        # what is released but not there any more
        fresh = fresh.unionByName(sinks.changed(spark, releases)[0])
    fresh = stored(fresh.distinct(), "changed")
    docs = sinks.read_rows(spark, extracts, only=fresh)
    decided = sinks.read_rows(spark, decisions, schema=DECISION_SCHEMA, only=fresh)
    rel = release(docs, decided, key=key, issued_at=issued_at, product=product, known_spans=spans_table(docs))
    sinks.write_rows(rel, releases, documents=fresh, note=marks)
    return fresh.count()
