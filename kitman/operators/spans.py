"""Span generation and span-array operators (D-generator, O01, O02, O23).

A *span* is a struct; its field order makes the natural struct ordering sort
by position first and emission order second::

    start, end, rule, seq, bstart, bend, kind, text, confidence

``start``/``end`` are 0-based half-open code-point offsets; ``bstart``/``bend``
the matching UTF-8 byte offsets, which let redaction cut the text with binary
``substring`` (O(piece) instead of O(position) per cut).  ``rule``/``seq`` is
the emission order that breaks ranking ties.

All operators here are per-row array expressions: no shuffle, no Python.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import dialect
from ..functions.arrays import empty_like, exclusive_scan_sum, inclusive_scan, index_range, let, search_rounds
from ..functions.text import clean_value, strip_chars, strip_ws

SPLIT_ON_SENTINELS = f"[{R.SENTINEL_OPEN}{R.SENTINEL_CLOSE}]"
SPAN_ARRAY = ("array<struct<start:int,end:int,rule:int,seq:int,bstart:int,bend:int,"
              "kind:string,text:string,confidence:double>>")


def span_struct(start, end, rule, seq, bstart, bend, kind, text, confidence) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(rule).cast("int").alias("rule") if not isinstance(rule, Column) else rule.cast("int").alias("rule"),
        seq.cast("int").alias("seq"),
        bstart.cast("int").alias("bstart"), bend.cast("int").alias("bend"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        text.alias("text"),
        (F.lit(confidence) if not isinstance(confidence, Column) else confidence).cast("double").alias("confidence"),
    )


# -- regex span generator ------------------------------------------------------

def regex_hits(work: Column, rule: R.Rule, original_bytes: Column | None = None,
               has_pua: Column | None = None) -> Column:
    """All non-overlapping leftmost matches of ``rule`` as span structs.

    The value of every match is wrapped in two private-use sentinels with one
    ``regexp_replace``; splitting on them yields gap/value segments alternately
    and a running length over the segments gives exact offsets.
    """
    marked = F.regexp_replace(work, dialect.java_pattern(rule), dialect.marker_replacement(rule))
    # ``has_pua`` must be a bound value (a lambda variable or literal), not a
    # text scan: it is referenced inside the per-hit lambda
    if has_pua is None:
        has_pua = F.lit(False)

    def from_segments(segs: Column, pua: Column) -> Column:
        clen = F.transform(segs, lambda s: F.char_length(s))
        blen = F.transform(segs, lambda s: F.octet_length(s))
        ends = F.struct(inclusive_scan(clen).alias("c"), inclusive_scan(blen).alias("b"))

        def build(E: Column) -> Column:
            odd = F.filter(index_range(F.size(segs)), lambda i: i % 2 == 1)

            def hit(i: Column) -> Column:
                c_end, b_end = E["c"][i], E["b"][i]
                c_start = c_end - F.char_length(segs[i])
                b_start = b_end - F.octet_length(segs[i])
                raw = segs[i]
                if original_bytes is not None:
                    raw = F.when(pua, original_bytes.substr(b_start + 1, b_end - b_start)
                                 .cast("string")).otherwise(raw)
                text = strip_ws(raw) if rule.family == "structured" else clean_value(raw)
                return span_struct(c_start, c_end, rule.order, F.floor(i / 2), b_start, b_end,
                                   rule.kind, text, rule.confidence)

            spans = F.transform(odd, hit)
            if rule.family == "structured":   # raw hits shorter than 3 are dropped
                return F.filter(spans, lambda s: F.char_length(s["text"]) >= R.MIN_VALUE_LEN)
            return F.filter(spans, lambda s: F.char_length(s["text"]) > 0)

        # one segment = no match: skip the offset scan entirely
        return F.when(F.size(segs) == 1, F.array().cast(SPAN_ARRAY)).otherwise(let(ends, build))

    return let(F.split(marked, SPLIT_ON_SENTINELS, -1), lambda segs: from_segments(segs, has_pua))


# -- O01: first rule wins an exact (start, end) --------------------------------

def dedupe_exact_offsets(spans: Column) -> Column:
    """Keep the earliest-emitted span per (start, end).  Input holds only valid
    hits, so rejected hits never claim an offset."""
    def keep(S: Column) -> Column:
        return F.filter(S, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(
            (x["start"] != S[i - 1]["start"]) | (x["end"] != S[i - 1]["end"])))
    return let(F.sort_array(spans), keep)


# -- D24: order-agnostic per-line labels ----------------------------------------

_SIDE_STRIP = R.LINE_SIDE_STRIP


def _line_candidate(line: Column, kind: str, pattern: str, c0: Column, b0: Column,
                    idx: Column) -> Column:
    def with_parts(parts: Column) -> Column:
        before, after = parts[0], F.when(F.size(parts) == 2, parts[1])
        side = F.when(F.char_length(strip_chars(after, _SIDE_STRIP))
                      >= F.char_length(strip_chars(before, _SIDE_STRIP)), after).otherwise(before)

        def with_value(v: Column) -> Column:
            pos = F.position(v, line)                      # 1-based, 0 = absent
            bpre = F.octet_length(line.substr(F.lit(1), pos - 1))
            ok = (F.size(parts) == 2) & (F.char_length(v) >= R.MIN_VALUE_LEN) & (pos > 0)
            return F.when(ok, span_struct(
                c0 + pos - 1, c0 + pos - 1 + F.char_length(v), R.LINE_RULE_ORDER, idx,
                b0 + bpre, b0 + bpre + F.octet_length(v), kind, v, R.LINE_CONFIDENCE))

        return F.when(F.size(parts) == 2, let(clean_value(side), with_value))

    # ``split`` compiles its pattern for every line, ``rlike`` once: lines without the kind are not split
    return F.when(line.rlike(pattern), let(F.split(line, pattern, 2), with_parts))


def line_label_hits(text: Column) -> Column:
    union = dialect.line_label_union()
    kinds = [(k, dialect.line_label_pattern(ph)) for k, ph in R.LINE_LABEL_SPECS]

    def over_lines(L: Column) -> Column:
        offs = F.struct(
            exclusive_scan_sum(F.transform(L, lambda l: F.char_length(l) + 1)).alias("c"),
            exclusive_scan_sum(F.transform(L, lambda l: F.octet_length(l) + 1)).alias("b"))

        def per_line(O: Column) -> Column:
            def one(i: Column) -> Column:
                line = L[i]
                cands = [_line_candidate(line, k, p, O["c"][i], O["b"][i], i) for k, p in kinds]
                return F.when(line.rlike(union), F.coalesce(*cands))
            return F.filter(F.transform(index_range(F.size(L)), one), lambda s: s.isNotNull())

        return let(offs, per_line)

    # every line label is Arabic: an Arabic-letter scan is an exact, cheap pre-gate
    gate = text.rlike(f"[{R.ARABIC_RANGE}]") & text.rlike(union)
    return F.when(gate, let(F.split(text, "\n", -1), over_lines))


#: Spans of a document up to which each is compared with all that are kept.
FEW_SPANS = 24


# -- O02: overlap resolution ----------------------------------------------------

def _overlaps_kept(K: Column, x: Column) -> Column:
    """Does ``x`` overlap a span of ``K`` (disjoint, sorted by start)?  Binary
    search for the last kept span starting before ``x`` ends; only it can
    overlap ``x``."""
    n = F.size(K)

    def step(acc: Column, _r: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        right = F.when(lo < hi, K[mid]["start"] < x["end"]).otherwise(F.lit(False))
        return F.when(lo >= hi, acc).otherwise(F.struct(
            F.when(right, mid + 1).otherwise(lo).alias("lo"), F.when(right, hi).otherwise(mid).alias("hi")))

    first_after = F.aggregate(search_rounds(n + 1), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step,
                              lambda acc: acc["lo"])
    pred = first_after - 1
    return F.when(pred >= 0, K[pred]["end"] > x["start"]).otherwise(F.lit(False))


def _ranked(spans: Column) -> Column:
    """By confidence desc, length desc, emission order."""
    keyed = F.transform(spans, lambda x: F.struct(
        (-x["confidence"]).alias("k1"), (x["start"] - x["end"]).alias("k2"),
        x["rule"].alias("k3"), x["seq"].alias("k4"), x.alias("span")))
    return F.transform(F.sort_array(keyed), lambda y: y["span"])


def _blocks(S: Column) -> Column:
    """Ranges of ranked spans that are resolved at once: a run of spans equal in
    confidence, length and rule if it is long (no two hits of a rule overlap), else
    about the square root of the number of spans."""
    n = F.size(S)
    differs = lambda x, y: ((x["confidence"] != y["confidence"]) | (x["rule"] != y["rule"])
                            | (x["end"] - x["start"] != y["end"] - y["start"]))
    starts = F.filter(index_range(n), lambda i: F.when(i == 0, F.lit(True)).otherwise(differs(S[i], S[i - 1])))
    width = F.ceil(F.sqrt(n)).cast("int")
    ranges = lambda cuts: F.transform(cuts, lambda c, j: F.struct(
        c.alias("a"), F.coalesce(F.get(cuts, j + 1), n).alias("b")))

    def cut(L: Column) -> Column:
        even = F.filter(F.transform(index_range(F.ceil(n / width).cast("int")), lambda b: b * width),
                        lambda m: ~F.exists(L, lambda x: (m > x["a"]) & (m < x["b"])))
        marks = F.concat(even, F.transform(L, lambda x: x["a"]), F.transform(L, lambda x: x["b"]))
        return let(F.sort_array(F.array_distinct(F.filter(marks, lambda m: m < n))), ranges)

    return let(F.filter(let(starts, ranges), lambda x: x["b"] - x["a"] >= width), cut)


def resolve_overlaps(spans: Column) -> Column:
    """Rank by (confidence desc, length desc, emission order) and keep
    each span that overlaps no span kept before it; result sorted by start.

    The ranked spans are taken in blocks.  A block first loses what overlaps the spans
    kept so far (disjoint, sorted: binary search); if the rest is disjoint it is kept,
    else it competes within the block; the kept ones are merged into the sorted
    set once a block.  Hits of few rules and lengths make few long blocks, so chains of
    them cost O(n log n); n spans of many lengths cost at most O(n ** 1.5) steps
    however they overlap.  Few spans compete one by one: blocks cost more than they save."""
    def compete(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    def by_rank(S: Column) -> Column:
        def added(fresh: Column) -> Column:
            in_order = lambda A: F.exists(F.zip_with(A, F.slice(A, 2, F.size(A)), lambda x, y: x["end"] > y["start"]), lambda c: c)
            return F.when(F.coalesce(let(F.sort_array(fresh), in_order), F.lit(False)),
                          F.aggregate(fresh, empty_like(S), compete)).otherwise(fresh)

        def block(kept: Column, b: Column) -> Column:
            fresh = F.filter(F.slice(S, b["a"] + 1, b["b"] - b["a"]), lambda x: ~_overlaps_kept(kept, x))
            return F.sort_array(F.concat(kept, let(fresh, added)))

        return F.aggregate(_blocks(S), empty_like(S), block)

    def one_by_one(S: Column) -> Column:
        return F.sort_array(F.aggregate(S, empty_like(S), compete))

    return let(spans, lambda S: F.when(F.size(S) <= 1, S).when(F.size(S) <= FEW_SPANS, let(_ranked(S), one_by_one))
               .otherwise(let(_ranked(S), by_rank)))
