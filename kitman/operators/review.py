"""Review operators: spans table, decisions, counts, review list.

Joins here are equi-joins on ``document_id`` (plus ``span_id``).  None is
hinted as broadcast: with AQE on, Spark measures the decision side at run time
and broadcasts it only when it is under ``spark.sql.autoBroadcastJoinThreshold``,
otherwise it sort-merge joins — a size-checked broadcast with a fallback.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import exploded, let, sorted_lookup
from ..functions.text import confidence_percent, kind_label, low_confidence, span_id

SPAN_COLUMNS = ["document_id", "span_id", "kind", "text", "start", "end", "bstart", "bend",
                "confidence", "lang", "approved", "emit_order"]


def spans_table(extracts: DataFrame, doc_col: str = "document_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat spans (one row per span) from per-document span arrays, with
    the columns of the document named in ``keep``.
    Every span starts approved (the reviewer unticks)."""
    flat = (exploded(extracts.withColumn("document_id", F.col(doc_col)), "spans", "document_id", *keep, position="emit_order")
            .select("document_id", *keep, "emit_order", "s.*"))
    return flat.select(
        "document_id", *keep,
        span_id(F.col("document_id"), F.col("start"), F.col("end"), F.col("kind"), F.col("text")).alias("span_id"),
        "kind", "text", "start", "end", "bstart", "bend", "confidence", "lang",
        F.lit(True).alias("approved"), F.col("emit_order").cast("int").alias("emit_order"))


# O04 --------------------------------------------------------------------------
def approved_only(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("approved"))


# O06 --------------------------------------------------------------------------
def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision per (document, span) wins, ordered by (decided_at, ord); of
    equal ones the approval, so that a tie redacts.  Map-side partial aggregation
    keeps the shuffle at one row per key per task."""
    return (decisions.groupBy("document_id", "span_id")
            .agg(F.max_by("approved", F.struct("decided_at", "ord", "approved")).alias("approved")))


# O07 --------------------------------------------------------------------------
def unknown_document_decisions(decisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Decisions naming a document we do not hold: the dead-letter rows."""
    return decisions.join(documents.select("document_id"), "document_id", "left_anti")


# O05 --------------------------------------------------------------------------
def apply_decisions(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per-span override; unlisted spans keep their state (default approved);
    decisions for unknown span ids match nothing and are ignored."""
    d = latest_decisions(decisions).withColumnRenamed("approved", "decided")
    return (spans.join(d, ["document_id", "span_id"], "left")
            .withColumn("approved", F.coalesce(F.col("decided"), F.col("approved"), F.lit(True)))
            .drop("decided"))


# O20 --------------------------------------------------------------------------
def decide_all(spans: DataFrame, approve: bool) -> DataFrame:
    return spans.withColumn("approved", F.lit(approve))


# O08 --------------------------------------------------------------------------
def review_counts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Items found and items to redact per document; documents without spans
    appear with zeros.  Spans are aggregated before the join, so the join
    carries one row per document."""
    per_doc = spans.groupBy("document_id").agg(
        F.count("*").alias("items_found"),
        F.count_if(F.col("approved")).alias("redacted_count"))
    return (documents.select("document_id").join(per_doc, "document_id", "left")
            .select("document_id",
                    F.coalesce("items_found", F.lit(0)).cast("long").alias("items_found"),
                    F.coalesce("redacted_count", F.lit(0)).cast("long").alias("redacted_count")))


# O21 --------------------------------------------------------------------------
def review_list(spans: DataFrame, ui_lang: str | Column = "en") -> DataFrame:
    """Spans as the reviewer sees them.  The spans of a document come in the
    order of its span array, by start; documents are not sorted among themselves."""
    ui = F.lit(ui_lang) if isinstance(ui_lang, str) else ui_lang
    return (spans.select(
        "document_id", "span_id", "start", "kind",
        kind_label(F.col("kind"), ui).alias("kind_label"),
        "text", "lang", "approved",
        confidence_percent(F.col("confidence")).alias("confidence_pct"),
        low_confidence(F.col("confidence")).alias("low_confidence")))


def decisions_as_map(decisions: DataFrame, co_partitions: int | None = None,
                     known: DataFrame | None = None) -> DataFrame:
    """Latest decisions folded to one sorted ``(span_id, approved)`` array per
    document, for applying inside the document row (no span explode/regroup).
    Sorted so each span finds its decision by binary search.  ``known``: the
    stored spans (document_id, span_id); decisions that name none of them are
    dropped first, which bounds an array by the document's own spans.

    ``co_partitions``: bucket count of a ``document_id``-bucketed extracts
    table.  Decisions are then hash-partitioned once by ``document_id`` into
    that many partitions, and both aggregations and the join reuse it (one
    exchange in total, none on the extracts side).  Without it the latest-wins
    step shuffles by (document, span), which stays balanced even when one
    document holds a large share of all decisions."""
    if co_partitions:
        decisions = decisions.repartition(co_partitions, "document_id")
    latest = latest_decisions(decisions)
    if known is not None:
        latest = latest.join(known.select("document_id", "span_id"), ["document_id", "span_id"], "left_semi")
    return (latest.groupBy("document_id")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("span_id").alias("k"),
                                                       F.col("approved").alias("v")))).alias("decided")))


NO_DECISIONS = "array<struct<k:string,v:boolean>>"


def apply_decision_map(spans: Column, document_id: Column, decided: Column) -> Column:
    """In-row O05 on a detected span array: approved = decided[span_id] ?? true."""
    def one(s: Column, D: Column) -> Column:
        sid = span_id(document_id, s["start"], s["end"], s["kind"], s["text"])
        return let(sid, lambda SID: s.withField("span_id", SID).withField(
            "approved", F.coalesce(sorted_lookup(D, SID), F.lit(True))))
    return let(F.coalesce(decided, F.array().cast(NO_DECISIONS)),
               lambda D: F.transform(spans, lambda s: one(s, D)))
