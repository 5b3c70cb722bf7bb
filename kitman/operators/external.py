"""External extraction responses.

A remote parser's JSON response is parsed with ``from_json`` against an
explicit schema and turned into candidate spans and candidate text with
array functions inside the row.  No network call is made here: responses
arrive as a table column (``document_id``, ``response``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.arrays import let
from ..functions.text import guess_kind, span_language
from .detect import detect_column, with_span_lang

# confidence is read as text so a non-numeric value nulls one field
# (then defaults) instead of discarding the whole response.
RESPONSE_SCHEMA = (
    "struct<output:struct<markdown:string,elements:array<struct<type:string,text:string,"
    "pairs:array<struct<key:struct<value:string>,value:struct<value:string>,"
    "confidence:string>>>>>>")


def parse_response(response: Column) -> Column:
    """JSON text → struct; malformed JSON → null."""
    return F.from_json(response, RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})


def _kv_pairs(parsed: Column) -> Column:
    """All key/value pairs of key/value regions, in document order."""
    els = F.coalesce(parsed["output"]["elements"], F.array())
    regions = F.filter(els, lambda e: e["type"] == R.EXTERNAL_PAIR_TYPE)
    return F.flatten(F.transform(regions, lambda e: F.coalesce(e["pairs"], F.array())))


def external_candidates(parsed: Column) -> Column:
    """Non-empty pair values → value-only spans (start = end = 0)."""
    def build(P: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            conf = F.coalesce(F.nullif(p["confidence"].try_cast("double"), F.lit(0.0)),
                              F.lit(R.EXTERNAL_DEFAULT_CONFIDENCE))
            return F.struct(
                F.lit(0).alias("start"), F.lit(0).alias("end"),
                F.lit(R.LINE_RULE_ORDER + 1).alias("rule"), i.cast("int").alias("seq"),
                F.lit(0).alias("bstart"), F.lit(0).alias("bend"),
                guess_kind(p["key"]["value"]).alias("kind"),
                p["value"]["value"].alias("text"),
                conf.alias("confidence"))
        kept = F.filter(P, lambda p: F.coalesce(F.char_length(p["value"]["value"]), F.lit(0)) > 0)
        return F.transform(kept, one)
    return let(_kv_pairs(parsed), build)


def external_text(parsed: Column) -> Column:
    """Markdown, then ``key: value`` lines and paragraph/text elements."""
    els = F.coalesce(parsed["output"]["elements"], F.array())

    def element_text(e: Column) -> Column:
        pairs = F.filter(F.coalesce(e["pairs"], F.array()),
                         lambda p: F.coalesce(F.char_length(p["value"]["value"]), F.lit(0)) > 0)
        kv = F.array_join(F.transform(pairs, lambda p: F.concat(
            F.coalesce(p["key"]["value"], F.lit("")), F.lit(": "), p["value"]["value"], F.lit("\n"))), "")
        para = F.when(e["type"].isin(*R.EXTERNAL_TEXT_TYPES) & (F.coalesce(F.char_length(e["text"]), F.lit(0)) > 0),
                      F.concat(e["text"], F.lit("\n"))).otherwise(F.lit(""))
        return F.when(e["type"] == R.EXTERNAL_PAIR_TYPE, kv).otherwise(para)

    return F.concat(F.coalesce(parsed["output"]["markdown"], F.lit("")),
                    F.array_join(F.transform(els, element_text), ""))


def merge_spans(a: Column, b: Column) -> Column:
    """A then the spans of B whose (kind, text) is new to A and to the
    earlier part of B.  Duplicates inside A are kept; no overlap pass."""
    def tagged(spans: Column, part: int) -> Column:
        return F.transform(spans, lambda x, i: F.struct(
            x["kind"].alias("kind"), x["text"].alias("text"), F.lit(part).alias("part"), i.alias("i"), x.alias("span")))

    def keep(S: Column) -> Column:        # sorted: equal (kind, text) lie together, A's before B's
        kept = F.filter(S, lambda x, i: F.when((x["part"] == 0) | (i == 0), F.lit(True)).otherwise(
            ~(x["kind"].eqNullSafe(S[i - 1]["kind"]) & x["text"].eqNullSafe(S[i - 1]["text"]))))
        return F.transform(F.sort_array(F.transform(kept, lambda x: F.struct(
            x["part"].alias("part"), x["i"].alias("i"), x["span"].alias("span")))), lambda x: x["span"])
    return let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), keep)


def extract_with_external(docs: DataFrame, text_col: str = "text",
                          response_col: str = "response") -> DataFrame:
    """Local detection on the own text, merged with detection on the
    external text (when non-empty and different) and the external
    candidates.  Spans of the external text are value-only (all offsets 0): they
    name values, not places in the own text.  An unusable response (null after
    parsing) → local only."""
    staged = docs.withColumns({
        "_parsed": parse_response(F.col(response_col)),
        "_own": with_span_lang(detect_column(text_col)),
    }).withColumn("_ext_text", external_text(F.col("_parsed")))
    own, ext_text, parsed = F.col("_own"), F.col("_ext_text"), F.col("_parsed")
    nowhere = lambda s: s.withField("start", F.lit(0)).withField("end", F.lit(0)).withField(
        "bstart", F.lit(0)).withField("bend", F.lit(0))
    from_ext_text = F.when((F.char_length(ext_text) > 0) & (ext_text != F.coalesce(F.col(text_col), F.lit(""))),
                           F.transform(with_span_lang(detect_column("_ext_text")), nowhere)).otherwise(F.slice(own, 1, 0))
    cands = F.transform(external_candidates(parsed),
                        lambda s: s.withField("lang", span_language(s["text"])))
    # malformed JSON is the failed remote call → local only; well-formed but
    # unexpected JSON keeps the external engine label with local spans
    usable = F.try_parse_json(F.col(response_col)).isNotNull()
    return staged.withColumns({
        "spans": F.when(usable, merge_spans(merge_spans(own, from_ext_text), cands)).otherwise(own),
        "engine": F.when(usable, F.lit("external")).otherwise(F.lit("local-fallback")),
    }).drop("_parsed", "_own", "_ext_text")
