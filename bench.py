"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query is forced through a ``noop`` sink so every
output column is computed; time is the median of warm runs (plan built and
JIT warm).  Throughput is reported as documents/s and chars/s of the main
detect → redact → proof release over ``documents``.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kitman.plans import catalog  # noqa: E402
from kitman.plans.release import DEMO_KEY, FIXED_ISSUED_AT, extract, release  # noqa: E402
from kitman.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def q_detect(spark):
    return extract(catalog.documents(spark, SF_DIR)).select("document_id", "lang", "spans")


def q_release(spark):
    return release(extract(catalog.documents(spark, SF_DIR)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)


def q_release_corpus(spark):
    return release(extract(catalog.corpus(spark, SF_DIR)), None, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)


def q_decisions_release(spark):
    extracts, _, decisions = catalog.reviewed(spark, SF_DIR)
    return release(extracts, decisions, key=DEMO_KEY, issued_at=FIXED_ISSUED_AT)


def q_value_redaction(spark):
    return catalog.q_o15_value_redaction(spark, SF_DIR)


def q_review_counts(spark):
    return catalog.q_o08_counts(spark, SF_DIR)


QUERIES = {
    "detect_documents": q_detect,
    "release_documents": q_release,
    "release_corpus": q_release_corpus,
    "decisions_release": q_decisions_release,
    "value_redaction_corpus": q_value_redaction,
    "review_counts": q_review_counts,
}


def run(query, spark) -> float:
    """Seconds from the call of the query (some store what they use twice) to its last row."""
    t = time.perf_counter()
    query(spark).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2 if CPUS.isdigit() else 16, app="kitman-bench")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    n_docs, n_chars = docs.select(F.count("*"), F.sum(F.char_length("text"))).first()
    times = {}
    for name, q in QUERIES.items():
        run(q, spark)                             # warm: plan + JIT
        samples = [run(q, spark) for _ in range(RUNS)]
        times[name] = round(statistics.median(samples), 3)
    rel = times["release_documents"]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "cpus": CPUS, "documents": n_docs, "chars": n_chars,
        "release_docs_per_sec": round(n_docs / rel, 1), "release_chars_per_sec": round(n_chars / rel, 1),
        "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
