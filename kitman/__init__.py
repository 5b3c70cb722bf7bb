"""kitman: Spark-native bilingual (Arabic/English) PII detection, review,
redaction and sealed proofs of redaction, as DataFrame jobs.

Typical use::

    from kitman import extract, release
    extracts = extract(documents)                 # document_id, text → spans
    releases = release(extracts, decisions, key=secret_key)
"""
from .operators.detect import detect, detect_column
from .operators.proof import verify
from .operators.redact import redact_column
from .plans.release import extract, release

__all__ = ["detect", "detect_column", "extract", "redact_column", "release", "verify"]
