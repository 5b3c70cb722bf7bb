"""Structured Streaming: continuous intake (ST1) and late decisions (ST2).

ST1  files land → guards → decode → detect → extracts sink (+ quarantine).
     Stateless and per row; the same batch functions run on each micro-batch.
ST2  reviewer decisions arrive later than documents.  Each micro-batch folds
     its decisions into the stored decision state (latest wins, O06),
     dead-letters decisions for unknown documents (O07) and re-releases only
     the documents it touched (O22).  Decisions may also arrive first: with
     ``wait_s`` they are kept in keyed state until ST1 tells of their document,
     and dead-lettered when their time is up.

Both write through ``foreachBatch`` into versioned tables (``sources.sinks``):
a micro-batch is one version, named after the stream and the batch.  The
stream's name is made with its checkpoint, so a replayed batch changes nothing that
it has committed, and a new checkpoint never touches what an older one wrote.
Checkpoints live under the cluster's ``spark.checkpoint.dir`` unless given.
"""
from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import rules as R
from ..functions.arrays import exploded
from ..operators.review import spans_table, unknown_document_decisions
from ..plans.release import DECISION_SCHEMA, extract, release
from ..session import ensure_checkpoint_dir, spread
from ..sources.intake import accepted, intake_stream, quarantined
from ..sources.sinks import exists, is_folder, make_folder, read_rows, write_rows

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or os.path.join(ensure_checkpoint_dir(spark), name)


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own name, kept in its checkpoint folder."""
    path = f"{checkpoint}/kitman-stream"
    if not exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def read_latest(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """Rows of a table, the newest version of each document (or of ``only``)."""
    return read_rows(spark, path, only=only)


# ST1 ----------------------------------------------------------------------------

def start_intake(spark: SparkSession, source_dir: str, out_dir: str,
                 checkpoint: str | None = None, max_bytes: int = R.MAX_UPLOAD_BYTES,
                 available_now: bool = True) -> StreamingQuery:
    """Files of ``source_dir`` → ``extracts`` and ``quarantine`` below ``out_dir``, and
    ``arrivals``: the ids of the documents a committed micro-batch brought."""
    rows = intake_stream(spark, source_dir, max_bytes)

    checkpoint = _checkpoint(spark, "st1-intake", checkpoint)
    stream = _stream_name(spark, checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        ex = extract(accepted(batch)).select("document_id", "path", "filename", "text",
                                              "lang", "char_count", "spans", "engine")
        write_rows(ex, os.path.join(out_dir, "extracts"), name=f"{stream}-{batch_id}")
        write_rows(quarantined(batch).select("path", "filename", "length", "reject_reason"),
                   os.path.join(out_dir, "quarantine"), name=f"{stream}-{batch_id}")
        accepted(batch).select("document_id").distinct().write.mode("append").json(os.path.join(out_dir, "arrivals"))
        batch.unpersist()

    w = (rows.writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ST2 ----------------------------------------------------------------------------

class _Waiting(StatefulProcessor):
    """The decisions of a document, tried at once and kept until the document
    arrives (tried again) or their time is up (tried a last time)."""

    def __init__(self, wait_s: float):
        self.wait_ms = int(wait_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "span_id string, approved boolean, decided_at long, ord int, until long")

    def _out(self, key, rows: list, due: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r[:4], due) for r in rows], columns=["document_id", "span_id", "approved", "decided_at", "ord", "due"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        until, new, here = timerValues.getCurrentWatermarkInMs(), [], False
        for part in rows:
            here |= bool(part["arrived"].any())
            for r in part[~part["arrived"]].itertuples():
                new.append((r.span_id, bool(r.approved) if r.approved is not None else None, int(r.decided_at), int(r.ord)))
                until = max(until, int(r.at.timestamp() * 1000))
        if new:
            yield self._out(key, new, "sent")
        if here:
            old = list(self.kept.get()) if self.kept.exists() else []
            if old:
                yield self._out(key, old, "arrived")
            self.kept.clear()
        elif new:
            for r in new:
                self.kept.appendValue((*r, until + self.wait_ms))
            self.handle.registerTimer(until + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        rows, now = list(self.kept.get()) if self.kept.exists() else [], expiredTimerInfo.getExpiryTimeInMs()
        over = [r for r in rows if r[4] <= now]
        self.kept.clear()
        for r in rows:
            if r[4] > now:
                self.kept.appendValue(tuple(r))
        if over:
            yield self._out(key, over, "late")

    def close(self) -> None:
        pass


def _with_waiting(spark: SparkSession, decisions: DataFrame, arrivals_dir: str, wait_s: float) -> DataFrame:
    """Decisions and arrivals by document.  The time of a row is when it came in, so
    none is ever too late to be looked at."""
    make_folder(spark, arrivals_dir)
    arrivals = spark.readStream.schema("document_id string").json(arrivals_dir)
    both = decisions.withColumn("arrived", F.lit(False)).unionByName(arrivals.withColumn("arrived", F.lit(True)), allowMissingColumns=True)
    rows = both.withColumns({"at": F.current_timestamp(), "decided_at": F.coalesce("decided_at", F.lit(0)), "ord": F.coalesce("ord", F.lit(0))})
    return (rows.withWatermark("at", "0 seconds").groupBy("document_id")
            .transformWithStateInPandas(_Waiting(wait_s), f"{DECISION_SCHEMA}, due string", "Append", "EventTime"))


def start_decisions(spark: SparkSession, decisions_dir: str, state_dir: str, *, key: bytes,
                    checkpoint: str | None = None, issued_at: int | None = None, available_now: bool = True,
                    max_files: int = 1000, wait_s: float | None = None) -> StreamingQuery:
    """``state_dir`` holds ``extracts`` (from ST1), and receives
    ``decisions`` (state), ``dead_letter`` and ``releases``.

    A micro-batch first takes its documents' ids and looks up these documents'
    extracts and state; what changes nothing is not released again.  ``wait_s``:
    how long a decision waits for its document (``arrivals``, from ST1) before it is
    a dead letter; None: not at all.  Time passes with what comes in; a document
    that came unannounced is found when the time is up."""
    rows = spark.readStream.schema(DECISION_SCHEMA).option("maxFilesPerTrigger", max_files).json(decisions_dir)
    extracts_path, state_path = os.path.join(state_dir, "extracts"), os.path.join(state_dir, "decisions")
    checkpoint = _checkpoint(spark, "st2-decisions", checkpoint)
    stream = _stream_name(spark, checkpoint)
    if wait_s is None:
        rows = rows.withColumn("due", F.lit("late"))
    else:
        rows = _with_waiting(spark, rows, os.path.join(state_dir, "arrivals"), wait_s)

    def sink(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream}-{batch_id}"
        cols = ["document_id", "span_id", "approved", "decided_at", "ord"]
        batch = batch.persist()
        docs = read_rows(spark, extracts_path, only=batch)
        held = docs.select("document_id").distinct().persist()
        late = unknown_document_decisions(batch.filter("due = 'late'").select(*cols), held)
        write_rows(late, os.path.join(state_dir, "dead_letter"), name=name)
        known = batch.join(held, "document_id", "left_semi").select(*cols)
        prior = read_rows(spark, state_path, schema=DECISION_SCHEMA, only=held).select(*cols)
        # latest decision per span over stored state and this batch (O06); what a replay
        # finds committed it leaves, so the state that says a release is made comes last
        fold = F.max(F.struct("decided_at", "ord", "approved"))
        was = F.max(F.when(~F.col("new"), F.struct("decided_at", "ord", "approved")))
        state = (known.withColumn("new", F.lit(True)).unionByName(prior.withColumn("new", F.lit(False)))
                 .groupBy("document_id", "span_id").agg(fold.alias("w"), was.alias("was"))
                 .select("document_id", "span_id", "w.approved", "w.decided_at", "w.ord", (~F.col("w").eqNullSafe(F.col("was"))).alias("moved"))
                 ).checkpoint(eager=True)
        touched = state.filter("moved").select("document_id").distinct()
        new_state = state.drop("moved").join(touched, "document_id", "left_semi")
        docs = docs.join(touched, "document_id", "left_semi")
        rel = release(docs, new_state, key=key, issued_at=issued_at, known_spans=spans_table(docs))
        write_rows(rel, os.path.join(state_dir, "releases"), name=name)
        write_rows(new_state, state_path, name=name)
        held.unpersist()
        batch.unpersist()

    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    if wait_s is None:
        return w.start()
    before = spark.conf.get(STATE_STORE, None)              # keyed timers need this store
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return w.start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def stream_detect_table(spark: SparkSession, table_dir: str, table: str, out_dir: str,
                        checkpoint: str, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """ST1 over a parquet table, one file or a folder of files: the table's files are
    the stream source (``availableNow``), each micro-batch is detected and becomes a
    version named after the batch; returns the flat span rows written."""
    at = f"{table_dir}/{table}.parquet"
    schema, reader = spark.read.parquet(at).schema, spark.readStream
    if not is_folder(spark, at):                            # a stream reads folders: the one file of its folder
        reader, at = reader.option("pathGlobFilter", f"{table}.parquet"), table_dir
    src = reader.schema(schema).parquet(at)

    def sink(batch: DataFrame, batch_id: int) -> None:
        ex = extract(spread(batch.select(key_col, text_col)), text_col)
        spans = (exploded(ex, "spans", key_col)
                 .select(key_col, "n", "s.start", "s.end", "s.kind", "s.text", "s.confidence", "s.lang"))
        write_rows(spans, out_dir, name=f"{stream}-{batch_id}")

    stream = _stream_name(spark, checkpoint)
    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_rows(spark, out_dir)
