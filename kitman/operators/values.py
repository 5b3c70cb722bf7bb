"""Exact-value redaction (O14–O17), re-aimed from staging values on a remote
service to relocating them in the document's own text.

Per document: approved values (O14) → each value and its fragments (T09) →
every literal occurrence in the text, overlapping ones too → the union of their
intervals → one bar each (O03).  Occurrences are found in one pass with an
automaton over the document's own values, as an Arrow-batched function, so the
cost follows text + values + hits.  Optional safety net (O16) runs the
email/card/phone rules over the already-redacted text.  All in-row; documents
never leave their partition.
"""
from __future__ import annotations

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.arrays import let
from ..functions.text import redaction_fragments, strip_ws, value_preview
from .detect import RULES_BY_ID, rule_hits_of
from .redact import redact_column


def approved_values(spans: Column) -> Column:
    """Stripped text of approved spans, length >= 3, first-seen order,
    each with the kind of its first span."""
    vals = F.transform(F.filter(spans, lambda s: F.coalesce(s["approved"], F.lit(True))),
                       lambda s: F.struct(strip_ws(s["text"]).alias("value"), s["kind"].alias("kind")))
    vals = F.filter(vals, lambda v: F.char_length(v["value"]) >= R.MIN_VALUE_LEN)
    by_value = F.sort_array(F.transform(vals, lambda v, i: F.struct(
        v["value"].alias("value"), i.alias("i"), v["kind"].alias("kind"))))

    def firsts(S: Column) -> Column:
        first = F.filter(S, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(x["value"] != S[i - 1]["value"]))
        in_order = F.sort_array(F.transform(first, lambda x: F.struct(
            x["i"].alias("i"), x["value"].alias("value"), x["kind"].alias("kind"))))
        return F.transform(in_order, lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind")))
    return let(by_value, firsts)


LOCATED = ("struct<spans:array<struct<start:int,end:int,bstart:int,bend:int,kind:string,text:string>>,"
           "found:array<boolean>>")


def _locate(text: str | None, fragments: list[list[str]] | None, kinds: list[str] | None) -> dict:
    """Covered intervals of ``text``, and which values (lists of fragments) occur.
    An interval has the kind of the longest fragment that starts it; a fragment
    has the kind of the first value that has it."""
    owners: dict[str, list[int]] = {}
    for v, parts in enumerate(fragments or []):
        for f in parts:
            if f:
                owners.setdefault(f, []).append(v)
    found = [False] * len(fragments or [])
    if not text or not owners:
        return {"spans": [], "found": found}
    automaton = ahocorasick.Automaton()
    for f in owners:
        automaton.add_word(f, f)
    automaton.make_automaton()
    hits = sorted((stop + 1 - len(f), -(stop + 1), f) for stop, f in automaton.iter(text))
    for f in {f for _, _, f in hits}:                     # a fragment's owners once, however often it occurs
        for v in owners[f]:
            found[v] = True
    covered: list[list] = []
    for start, minus_end, f in hits:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], -minus_end)
        else:
            covered.append([start, -minus_end, kinds[owners[f][0]]])
    spans, at, byte = [], 0, 0
    for start, end, kind in covered:
        b0 = byte + len(text[at:start].encode())
        byte, at = b0 + len(text[start:end].encode()), end
        spans.append({"start": start, "end": end, "bstart": b0, "bend": byte, "kind": kind, "text": text[start:end]})
    return {"spans": spans, "found": found}


def located(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds ``_values`` (O14) and ``_located`` (``LOCATED``): where the approved
    values and their fragments cover the text."""
    staged = df.withColumn("_values", approved_values(F.col(spans_col)))
    parts = F.transform("_values", lambda v: redaction_fragments(v["value"]))
    staged = staged.withColumns({"_parts": parts, "_kinds": F.transform("_values", lambda v: v["kind"])})
    find = F.udf(_locate, LOCATED, useArrow=True)
    return staged.withColumn("_located", find(F.col(text_col), F.col("_parts"), F.col("_kinds"))).drop("_parts", "_kinds")


def redact_values(df: DataFrame, out: str = "redacted", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds ``out``, the text with its approved values and their fragments barred."""
    got = located(df, text_col, spans_col)
    return got.withColumn(out, redact_column(F.col(text_col), F.col("_located.spans"), approved_field=None)).drop(
        "_values", "_located")


def safety_net(df: DataFrame, col: str) -> DataFrame:
    """Email, card and phone rules over already-redacted text, applied
    whatever the reviewer decided (opt-in; one staged column per preset)."""
    for rid in ("structured:email", "structured:credit_card", "structured:phone"):
        hits = rule_hits_of(col, RULES_BY_ID[rid])
        df = df.withColumn(col, redact_column(F.col(col), hits, approved_field=None))
    return df


def operations(values: Column, found: Column, safety_net: bool = False) -> Column:
    presets = F.array(*[F.lit(f"preset:{p}") for p in R.SAFETY_NET_PRESETS]) if safety_net \
        else F.array().cast("array<string>")
    staged = F.filter(
        F.zip_with(values, found, lambda v, f: F.when(f, F.concat(
            F.lit("stage_value «"), value_preview(v["value"]), F.lit("»")))),
        lambda s: s.isNotNull())
    return F.concat(staged, presets, F.array(F.lit("apply_redactions"), F.lit("seal (hmac-sha256)")))


def operation_log(df: DataFrame, out: str = "ops", text_col: str = "text", spans_col: str = "spans",
                  safety_net: bool = False) -> DataFrame:
    """Adds ``out``, the ordered operations — one ``stage_value`` per approved
    value found in the text, the presets when enabled, then apply and seal."""
    got = located(df, text_col, spans_col)
    return got.withColumn(out, operations(F.col("_values"), F.col("_located.found"), safety_net)).drop("_values", "_located")
