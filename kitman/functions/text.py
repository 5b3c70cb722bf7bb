"""Scalar text functions (T01–T19) as Spark ``Column`` expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .dialect import WS, WS_INNER


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# T01 -------------------------------------------------------------------------
def fold_arabic_digits(text) -> Column:
    """Arabic-Indic digits → ASCII, length preserving."""
    return F.translate(_c(text), R.ARABIC_INDIC_DIGITS, R.ASCII_DIGITS)


# T02 -------------------------------------------------------------------------
def strip_bidi(value) -> Column:
    return F.translate(_c(value), R.BIDI_CONTROLS, "")


_EDGE = f"[{WS_INNER}{R.VALUE_EDGE_SEPARATORS}]+"


# T03 -------------------------------------------------------------------------
def clean_value(value) -> Column:
    """Text without bidi marks, its whitespace runs single spaces, its edges
    free of whitespace and separators."""
    v = strip_bidi(value)
    v = F.regexp_replace(v, f"{WS}+", " ")
    return F.regexp_replace(v, f"\\A{_EDGE}|{_EDGE}\\z", "")


def strip_ws(value) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(_c(value), f"\\A{WS}+|{WS}+\\z", "")


def strip_chars(value, chars: str) -> Column:
    cls = "[" + "".join("\\x{%X}" % ord(ch) for ch in chars) + "]+"
    return F.regexp_replace(_c(value), f"\\A{cls}|{cls}\\z", "")


# T05 / T06 --------------------------------------------------------------------
_AR = f"[{R.ARABIC_RANGE}]"


def document_language(text) -> Column:
    t = _c(text)
    has_ar = t.rlike(_AR)
    has_en = t.rlike("[A-Za-z]")
    return (F.when(has_ar & has_en, "mixed").when(has_ar, "ar").otherwise("en"))


def span_language(fragment) -> Column:
    return F.when(_c(fragment).rlike(_AR), "ar").otherwise("en")


# Deterministic ids --------------------------------------------------
def hex_id(prefix: str, *parts, width: int = R.ID_HEX_WIDTH) -> Column:
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, width))


def span_id(document_id, start, end, kind, text) -> Column:
    return hex_id(R.SPAN_ID_PREFIX, document_id, start, end, kind, text)


def document_id_from_key(key, width: int = R.ID_HEX_WIDTH) -> Column:
    """``doc_`` + lower-case hex of an integer key (table input), zero-padded to
    ``width`` digits; keys that need more digits keep them all."""
    digits = F.lower(F.hex(_c(key).cast("long")))
    return F.concat(F.lit(R.DOC_ID_PREFIX), F.when(F.char_length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


# T08 --------------------------------------------------------------------------
def guess_kind(label) -> Column:
    low = F.lower(F.coalesce(_c(label), F.lit("")))
    out = None
    for kind, words in R.GUESS_KIND_KEYWORDS:
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise(R.GUESS_KIND_DEFAULT)


# T09 --------------------------------------------------------------------------
def redaction_fragments(value) -> Column:
    """Distinct pieces of a value worth finding: itself, then its parts of 3 or
    more characters."""
    v = _c(value)
    parts = F.transform(F.split(v, R.FRAGMENT_SPLIT, -1), lambda p: strip_ws(p))
    parts = F.filter(parts, lambda p: F.char_length(p) >= R.MIN_VALUE_LEN)
    return F.array_distinct(F.concat(F.array(v), parts))


# T10 --------------------------------------------------------------------------
def value_preview(value, n: int = R.VALUE_PREVIEW_CHARS) -> Column:
    v = strip_ws(F.regexp_replace(_c(value), "\n", " "))
    return F.when(F.char_length(v) <= n, v).otherwise(
        F.concat(F.substring(v, 1, n), F.lit("…")))


# T11 --------------------------------------------------------------------------
def text_preview(text, n: int = R.PREVIEW_CHARS) -> Column:
    return F.substring(_c(text), 1, n)


# T12 --------------------------------------------------------------------------
def sha256_hex(text) -> Column:
    return F.sha2(_c(text), 256)


# T13 --------------------------------------------------------------------------
def iso_utc(epoch_seconds) -> Column:
    """``YYYY-MM-DDThh:mm:ssZ`` in UTC whatever the session time zone
    (``date_format`` renders in the session zone, so shift to UTC first)."""
    ts = F.to_utc_timestamp(F.timestamp_seconds(_c(epoch_seconds)), F.current_timezone())
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# T16 --------------------------------------------------------------------------
def low_confidence(conf) -> Column:
    return _c(conf) < R.LOW_CONFIDENCE


def confidence_percent(conf) -> Column:
    return F.floor(_c(conf) * 100 + 0.5).cast("int")


# T17 --------------------------------------------------------------------------
def kind_label(kind, ui_lang) -> Column:
    """Localised badge; unknown UI language → Arabic; unknown kind → kind
    with underscores as spaces."""
    pairs = []
    for lang, table in R.KIND_LABELS.items():
        for k, label in table.items():
            pairs += [F.lit(f"{lang}|{k}"), F.lit(label)]
    table = F.create_map(*pairs)
    lang = F.when(_c(ui_lang).isin(*R.KIND_LABELS.keys()), _c(ui_lang)).otherwise("ar")
    found = F.try_element_at(table, F.concat(lang, F.lit("|"), _c(kind)))
    return F.coalesce(found, F.regexp_replace(_c(kind), "_", " "))


# T18 --------------------------------------------------------------------------
def redaction_bar(kind, text) -> Column:
    n = F.greatest(F.lit(R.BAR_MIN), F.least(F.char_length(_c(text)), F.lit(R.BAR_MAX)))
    return F.concat(F.lit("["), F.upper(_c(kind)), F.lit(" "),
                    F.repeat(F.lit(R.BAR_CHAR), n), F.lit("]"))


# T19 --------------------------------------------------------------------------
def verify_message(valid) -> Column:
    return F.when(_c(valid), R.VERIFY_OK).otherwise(R.VERIFY_BAD)
