"""O03 redaction: replace every approved, non-empty span with its bar.

The clean copy is assembled left to right from (gap, bar) pieces cut out of
the UTF-8 bytes of the original by the spans' byte offsets and joined once,
so the cost is linear in the text length however many spans there are
(character ``substring`` would rescan the string from the start per cut).
Spans must be disjoint and sorted by start — the output of O02.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import redaction_bar


def redact_column(text: Column, spans: Column, approved_field: str | None = "approved") -> Column:
    def keep(x: Column) -> Column:
        ok = x["end"] > x["start"]
        return ok & F.coalesce(x[approved_field], F.lit(True)) if approved_field else ok

    def body(A: Column) -> Column:
        def with_bytes(TB: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                prev = F.when(i == 0, F.lit(0)).otherwise(A[i - 1]["bend"])
                gap = TB.substr(prev + 1, x["bstart"] - prev).cast("string")
                return F.concat(gap, redaction_bar(x["kind"], x["text"]))
            last = A[F.size(A) - 1]["bend"]
            tail = TB.substr(last + 1, F.octet_length(TB) - last).cast("string")
            return F.concat(F.array_join(F.transform(A, piece), ""), tail)
        return F.when(F.size(A) == 0, text).otherwise(let(F.encode(text, "UTF-8"), with_bytes))

    return let(F.filter(spans, keep), body)
