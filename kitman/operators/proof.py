"""Proof of redaction: body (O09), keyed seal and check (O10), verify (O18),
tamper check (O19).

The seal is HMAC-SHA256 over a canonical JSON text of the proof body, built
from ``sha2``/``unhex``/``concat`` (RFC 2104), so sealing and checking are
plain projections.  The canonical text is what Python's
``json.dumps(body, sort_keys=True, ensure_ascii=False)`` prints for the same
body (keys sorted, ``", "``/``": "`` separators), so a verifier outside Spark
can recompute it byte for byte.

Unlike a public-key signature, a keyed digest proves integrity only to key
holders.  The key is a function argument (load it from your secret store);
note that, as any literal, its derived pads appear in the query plan.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.arrays import let
from ..functions.text import iso_utc, sha256_hex, verify_message
from ..sources.intake import valid_document_id

PROOF_FIELDS = ["document_id", "issued_at", "issued_at_iso", "original_sha256", "product",
                "redacted_sha256", "redaction_count", "redactions"]


def removed_items(spans: Column) -> Column:
    """Approved spans → {confidence (2 dp), kind, lang, length}; never the text."""
    return F.transform(
        F.filter(spans, lambda s: F.coalesce(s["approved"], F.lit(True))),
        lambda s: F.struct(F.round(s["confidence"], 2).alias("confidence"), s["kind"].alias("kind"),
                           s["lang"].alias("lang"), F.char_length(s["text"]).cast("int").alias("length")))


def build_proof(document_id: Column, original: Column, redacted: Column, spans: Column,
                issued_at: Column, product: str = R.PRODUCT) -> Column:
    removed = removed_items(spans)
    return F.struct(
        document_id.alias("document_id"),
        issued_at.cast("long").alias("issued_at"),
        iso_utc(issued_at).alias("issued_at_iso"),
        sha256_hex(original).alias("original_sha256"),
        F.lit(product).alias("product"),
        sha256_hex(redacted).alias("redacted_sha256"),
        F.size(removed).cast("int").alias("redaction_count"),
        removed.alias("redactions"),
    )


def _q(c: Column) -> Column:
    """A JSON string; most need no escape, which one scan tells."""
    escaped = F.substring(F.to_json(F.array(c)), F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)
    return F.when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def canonical_json(proof: Column) -> Column:
    """Key-sorted JSON text of a proof struct; null if any field, or any field of
    any item, is missing (``array_join`` would pass over a null item)."""
    item = lambda r: F.concat(
        F.lit('{"confidence": '), r["confidence"].cast("string"),
        F.lit(', "kind": '), _q(r["kind"]), F.lit(', "lang": '), _q(r["lang"]),
        F.lit(', "length": '), r["length"].cast("string"), F.lit("}"))
    reds = let(F.transform(proof["redactions"], item), lambda items: F.when(
        ~F.exists(items, lambda x: x.isNull()), F.array_join(items, ", ")))
    return F.concat(
        F.lit('{"document_id": '), _q(proof["document_id"]),
        F.lit(', "issued_at": '), proof["issued_at"].cast("string"),
        F.lit(', "issued_at_iso": '), _q(proof["issued_at_iso"]),
        F.lit(', "original_sha256": '), _q(proof["original_sha256"]),
        F.lit(', "product": '), _q(proof["product"]),
        F.lit(', "redacted_sha256": '), _q(proof["redacted_sha256"]),
        F.lit(', "redaction_count": '), proof["redaction_count"].cast("string"),
        F.lit(', "redactions": ['), reds, F.lit("]}"))


def _pads(key: bytes) -> tuple[str, str]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return (bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex())


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    ipad, opad = _pads(key)
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(opad)), F.unhex(inner)), 256)


def key_id(key: bytes) -> str:
    return hashlib.sha256(b"key-id|" + key).hexdigest()[:16]


def seal(proofs: DataFrame, key: bytes, proof_col: str = "proof") -> DataFrame:
    """Adds ``body_json``, ``seal`` and ``key_id``."""
    body = canonical_json(F.col(proof_col))
    return (proofs.withColumn("body_json", body)
            .withColumn("seal", hmac_sha256_hex(F.col("body_json"), key))
            .withColumn("key_id", F.lit(key_id(key))))


def seal_valid(proof: Column, seal_col: Column, key: bytes) -> Column:
    """Recompute from the proof struct; any null/missing part → false."""
    return F.coalesce(hmac_sha256_hex(canonical_json(proof), key) == seal_col, F.lit(False))


def key_ring(*keys: bytes) -> dict[str, bytes]:
    """Keys by the id that a proof names."""
    return {key_id(k): k for k in keys}


def verify(proofs: DataFrame, key: bytes | dict[str, bytes]) -> DataFrame:
    """O18 over stored proofs: valid flag, issued_at_iso, count, message.

    ``key``: one key for all proofs, or a key ring: each proof is then checked under
    the key that its ``key_id`` names, so proofs sealed before a change of keys stay
    valid as long as the old key is in the ring.  A null or unknown id is invalid and
    said to be unknown, not altered."""
    if isinstance(key, bytes):
        valid, known = seal_valid(F.col("proof"), F.col("seal"), key), F.lit(True)
    else:
        def checked(body: Column) -> Column:
            out = F.lit(False)
            for name, one in key.items():
                out = F.when(F.col("key_id") == name, F.coalesce(hmac_sha256_hex(body, one) == F.col("seal"), F.lit(False))).otherwise(out)
            return out
        valid, known = let(canonical_json(F.col("proof")), checked), F.coalesce(F.col("key_id").isin(list(key)), F.lit(False))
    return proofs.select(
        "document_id", valid.alias("valid"),
        F.col("proof.issued_at_iso").alias("issued_at_iso"),
        F.col("proof.redaction_count").alias("redaction_count"),
        F.when(known, verify_message(valid)).otherwise("Unknown key.").alias("detail"))


def verify_requests(requests: DataFrame, proofs: DataFrame, key: bytes | dict[str, bytes]) -> DataFrame:
    """O18 lookup by id: malformed ids (S05) are rejected before the lookup;
    ids with no stored proof → found = false."""
    ask = requests.select("document_id", valid_document_id(F.col("document_id")).alias("well_formed"))
    v = verify(proofs, key)
    return (ask.join(v, "document_id", "left")
            .withColumn("found", F.col("valid").isNotNull() & F.col("well_formed"))
            .withColumn("valid", F.coalesce("valid", F.lit(False)) & F.col("well_formed"))
            .withColumn("detail", F.when(~F.col("well_formed"), "Invalid document id.")
                        .otherwise(F.coalesce("detail", F.lit("Not found."))))
            .drop("well_formed"))


def tamper(proofs: DataFrame, count: int = R.TAMPER_COUNT) -> DataFrame:
    """A copy with ``redaction_count`` altered — for checks only."""
    return proofs.withColumn("proof", F.col("proof").withField("redaction_count", F.lit(count)))
