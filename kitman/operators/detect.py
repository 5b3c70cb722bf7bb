"""Detectors D01–D25 as DataFrame transforms.

``detect`` adds, in one narrow projection (no shuffle):

* ``lang``        document language (T05)
* ``char_count``  code points (T15)
* ``spans``       resolved span array (D25 = structured ∪ labels ∪ lines → O02)

Each rule is gated by a cheap test the rule's own pattern implies (``@`` for
email, a digit for numeric rules, the label words for label rules), so a
document that cannot match skips the rule's ``regexp_replace``/``split``.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import dialect
from ..functions.arrays import let
from ..functions.text import document_language, span_language
from .spans import dedupe_exact_offsets, line_label_hits, regex_hits, resolve_overlaps

_RULES = R.rules()
RULES_BY_ID = {f"{r.family}:{r.kind}": r for r in _RULES}


# Necessary conditions implied by each structured pattern (cheap scans with
# no look-around), checked before the full rule.
_STRUCTURED_GATES = {
    "iban": r"[A-Z][A-Z]\p{Nd}\p{Nd}",
    "ip_address": r"\p{Nd}\.\p{Nd}",
    "national_id": r"[12\x{661}\x{662}]\p{Nd}{9}",
}


def _gate(rule: R.Rule, text: Column, has_digit: Column) -> Column:
    if rule.family != "structured":
        return text.rlike(dialect.label_gate(rule))
    if rule.kind == "email":
        return F.instr(text, "@") > 0
    extra = _STRUCTURED_GATES.get(rule.kind)
    return has_digit & text.rlike(extra) if extra else has_digit


def _working_copy(text: Column) -> tuple[Column, Column]:
    """Text with any pre-existing sentinel code point replaced (same length,
    same byte width); flag says whether that happened."""
    has_pua = (F.instr(text, R.SENTINEL_OPEN) > 0) | (F.instr(text, R.SENTINEL_CLOSE) > 0)
    work = F.when(has_pua, F.translate(text, R.SENTINEL_OPEN + R.SENTINEL_CLOSE,
                                       R.PUA_REPLACEMENT * 2)).otherwise(text)
    return work, has_pua


def text_context(text: Column) -> Column:
    """Per-document facts every rule needs, computed once per document:
    the working copy, whether it differs from the text, and a digit flag."""
    work, has_pua = _working_copy(text)
    return F.struct(text.alias("text"), work.alias("work"), has_pua.alias("pua"),
                    text.rlike(r"\p{Nd}").alias("digit"))


def rule_hits(text: Column, rule: R.Rule, ctx: Column | None = None) -> Column:
    """Valid hits of a single rule (before cross-rule dedupe).  ``ctx`` is a
    bound ``text_context``; without it the facts are computed here."""
    if ctx is None:
        return let(text_context(text), lambda C: rule_hits(C["text"], rule, C))
    empty = F.array().cast(_SPAN_ARRAY)
    hits = regex_hits(ctx["work"], rule, F.encode(ctx["text"], "UTF-8"), ctx["pua"])
    return F.when(_gate(rule, ctx["text"], ctx["digit"]), hits).otherwise(empty)


_SPAN_ARRAY = ("array<struct<start:int,end:int,rule:int,seq:int,bstart:int,bend:int,"
               "kind:string,text:string,confidence:double>>")


HAS_ARABIC = f"[{R.ARABIC_RANGE}]"
FOLDS_TO_ASCII = "[\u017f\u0130\u0131\u212a]"


def family_gate(family: str, text: Column) -> Column | None:
    """One cheap scan that every rule of a family implies: each Arabic label
    contains an Arabic-block letter, each English one a literal word of the
    lower-cased text (or a letter that folds to ASCII only in a regex)."""
    if family == "label_ar":
        return text.rlike(HAS_ARABIC)
    if family == "label_en":
        heads = dialect.label_words(r for r in _RULES if r.family == "label_en")
        return let(F.lower(text), lambda low: reduce(or_, (low.contains(h) for h in heads))) | text.rlike(FOLDS_TO_ASCII)
    return None


def candidate_spans(text: Column, families: tuple[str, ...] = ("structured", "label_en", "label_ar"),
                    kinds: tuple[str, ...] | None = None, ctx: Column | None = None) -> Column:
    """Concatenated valid hits of the selected regex rules, in emission order."""
    if ctx is None:
        return let(text_context(text), lambda C: candidate_spans(C["text"], families, kinds, C))
    parts = []
    for fam in ("structured", "label_en", "label_ar"):
        if fam not in families:
            continue
        hits = [rule_hits(text, r, ctx) for r in _RULES
                if r.family == fam and (kinds is None or r.kind in kinds)]
        if not hits:
            continue
        block = F.concat(*hits) if len(hits) > 1 else hits[0]
        gate = family_gate(fam, text)
        parts.append(block if gate is None else
                     F.when(gate, block).otherwise(F.array().cast(_SPAN_ARRAY)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


_BUILT: dict[tuple, Column] = {}


def _memo(key: tuple, build) -> Column:
    """Building these expression trees from Python costs thousands of py4j
    calls (seconds); the result only names its input column, so it is built
    once per session and column name and reused by every DataFrame."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    k = (sc.applicationId if sc is not None else None,) + key
    if k not in _BUILT:
        _BUILT[k] = build()
    return _BUILT[k]


def detect_column(text: Column | str) -> Column:
    """D25 on one text column → resolved span array (sorted by start)."""
    def body(t: Column) -> Column:
        regex_part = dedupe_exact_offsets(candidate_spans(t))
        lines = F.coalesce(line_label_hits(t), F.array().cast(_SPAN_ARRAY))
        return resolve_overlaps(F.concat(regex_part, lines))
    if isinstance(text, str):
        return _memo(("detect", text), lambda: body(F.coalesce(F.col(text), F.lit(""))))
    return let(text, body)


def rule_hits_of(col_name: str, rule: R.Rule) -> Column:
    return _memo(("rule", col_name, rule.order),
                 lambda: rule_hits(F.coalesce(F.col(col_name), F.lit("")), rule))


def with_span_lang(spans: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("lang", span_language(s["text"])))


def detect(df: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    return df.withColumns({
        "lang": document_language(t),
        "char_count": F.char_length(t),
        "spans": with_span_lang(detect_column(text_col)),
    })
