"""DuckDB oracle SQL for the registered queries.

An independent formulation of each query in DuckDB SQL (RE2 regexes, list
lambdas, window functions) over the same parquet views.  RE2 has no
look-around, so ``\\b`` and the look-behinds are written as consumed context
groups; match offsets are rebuilt from ``regexp_split_to_array`` gaps.  Digit
folding is done on the text with ``translate`` (the Spark side folds the
patterns instead).  Queries whose results need the full greedy detector have
no oracle here and are checked against a brute-force Python oracle in tests.
"""
from __future__ import annotations

from .. import rules as R
from ..functions.dialect import HWS_INNER, WS_INNER, either_order
from ..operators.proof import _pads, key_id
from ..sources import corpus as C
from .release import DEMO_KEY, FIXED_ISSUED_AT

WS = f"[{WS_INNER}]"
HWS = f"[{HWS_INNER}]"
W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"
D = r"\p{Nd}"
AR_DIGITS = R.ARABIC_INDIC_DIGITS
BIDI = R.BIDI_CONTROLS
SEPS = R.VALUE_EDGE_SEPARATORS

DOCS_SRC = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
CORPUS_SRC = f"SELECT c_custkey AS doc_id, {C.TEXT} AS text FROM customer"
DOC_ID = "concat('doc_', lpad(lower(hex(doc_id)), 10, '0'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(x: str) -> str:
    v = f"regexp_replace(translate({x}, '{BIDI}', ''), '{WS}+', ' ', 'g')"
    return f"regexp_replace({v}, '^[{WS_INNER}{SEPS}]+|[{WS_INNER}{SEPS}]+$', '', 'g')"


def lang_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[\\x{{600}}-\\x{{6FF}}]') THEN 'ar' ELSE 'en' END"


# -- regex rules in RE2 with explicit context ---------------------------------------
# groups: 1 = consumed left context, 2 = value, 3 = trailing part of the match
# (kept in the offsets, e.g. a card's separator); anything after is context.

def _label(py: str) -> str:
    py = py.replace(r"[^\S\n]", HWS).replace(r"\s", WS)
    idx = py.rfind("(")
    value = py[idx:].replace("(.+)", "([^\n]+)".replace("\n", "\\n"))
    return "(?i)(" + py[:idx] + ")" + value + "()"


RE2_RULES: dict[str, tuple[str, str | None]] = {
    # rule id: (pattern, post-filter on the char after the value or None)
    "structured:email": (r"()([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})()", None),
    "structured:iban": (f"(^|{NW})([A-Z]{{2}}{D}{{2}}(?:[ ]?[A-Z0-9]){{11,30}})()(?:{NW}|$)", None),
    "structured:credit_card": (f"(^|{NW})((?:{D}[ -]?){{12,15}}{D})(?:([ -]){W}|(?:{NW}|$))", None),
    "structured:national_id": (f"(^|[^\\p{{Nd}}A-Za-z])([12]{D}{{9}})()", D),
    "structured:phone": (f"(^|[^A-Za-z])(\\+?{D}[\\p{{Nd}}{WS_INNER}\\-()]{{7,}}{D})()", None),
    "structured:ip_address": (f"(^|{NW})((?:{D}{{1,3}}\\.){{3}}{D}{{1,3}})()", W),
}
for _r in R.rules():
    if _r.family != "structured":
        RE2_RULES[f"{_r.family}:{_r.kind}"] = (_label(_r.python_pattern), None)

_RULE_OBJ = {f"{r.family}:{r.kind}": r for r in R.rules()}


def hits_cte(rule_id: str, src: str, norm_col: str | None = None) -> str:
    """SELECT doc_id, text, start, end, kind, text, confidence, rule, seq.
    ``norm_col`` names a column of ``src`` to match on instead of the text."""
    rule = _RULE_OBJ[rule_id]
    pat, after = RE2_RULES[rule_id]
    structured = rule.family == "structured"
    norm = f"translate(text, '{AR_DIGITS}', '{R.ASCII_DIGITS}')" if structured else "text"
    if norm_col:
        norm = norm_col
    value = strip_sql("substring(text, s + 1, n)") if structured else clean_sql("core")
    keep = f"length({value}) >= {R.MIN_VALUE_LEN}" if structured else f"length({value}) > 0"
    if after:
        keep += f" AND NOT regexp_matches(substring(norm, s + n + 1, 1), '{after}')"
    return f"""
    (WITH s0 AS ({src}),
     m AS (SELECT doc_id, text, {norm} AS norm FROM s0),
     x AS (SELECT doc_id, text, norm,
                  regexp_extract_all(norm, '{pat}', 0) AS w,
                  regexp_extract_all(norm, '{pat}', 1) AS g1,
                  regexp_extract_all(norm, '{pat}', 2) AS g2,
                  regexp_extract_all(norm, '{pat}', 3) AS g3,
                  regexp_split_to_array(norm, '{pat}') AS gaps FROM m),
     u AS (SELECT doc_id, text, norm, w, g1, g2, g3, gaps, unnest(range(1, len(w) + 1)) AS i FROM x),
     o AS (SELECT doc_id, text, norm, i,
                  CAST(coalesce(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))), 0)
                + coalesce(list_sum(list_transform(list_slice(w, 1, i - 1), lambda h: length(h))), 0)
                + length(coalesce(g1[i], '')) AS BIGINT) AS s,
                  length(coalesce(g2[i], '')) + length(coalesce(g3[i], '')) AS n,
                  g2[i] AS core FROM u)
     SELECT doc_id, text AS doc_text, norm AS doc_norm, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS "end",
            CAST(s + length(coalesce(core, '')) AS INTEGER) AS core_end,
            '{rule.kind}' AS kind, {value} AS text, CAST({rule.confidence} AS DOUBLE) AS confidence,
            {rule.order} AS rule, CAST(i - 1 AS INTEGER) AS seq
     FROM o WHERE {keep})"""


def card_hits_cte(src: str) -> str:
    """Card hits in two passes.  RE2 checks the closing boundary after a kept
    separator by consuming the next character, which blocks a card starting
    right there.  Pass 2 reruns on the text with the pass-1 values masked by a
    word character (length preserved, boundaries unchanged) and recovers
    exactly those blocked matches."""
    rid = "structured:credit_card"
    p1 = hits_cte(rid, src)
    prev = "(CASE WHEN i = 1 THEN 0 ELSE L[i - 1].e END)"
    mask = (f"array_to_string(list_transform(range(1, len(L) + 1), lambda i: "
            f"substring(norm, {prev} + 1, L[i].s - {prev}) || repeat('a', L[i].e - L[i].s)), '') "
            f"|| substring(norm, (CASE WHEN len(L) = 0 THEN 0 ELSE L[len(L)].e END) + 1)")
    masked = f"""SELECT s0.doc_id, s0.text, {mask} AS masked FROM
        (SELECT doc_id, text, translate(text, '{AR_DIGITS}', '{R.ASCII_DIGITS}') AS norm FROM ({src})) s0
        LEFT JOIN (SELECT doc_id, list(struct_pack(s := start, e := core_end) ORDER BY start) AS L0
                   FROM {p1} GROUP BY doc_id) h USING (doc_id),
        LATERAL (SELECT coalesce(h.L0, []) AS L)"""
    p2 = hits_cte(rid, masked, norm_col="masked")
    cols = 'doc_id, doc_text, start, "end", kind, text, confidence, rule'
    return f"""
    (SELECT {cols}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS seq
     FROM (SELECT {cols} FROM {p1} UNION ALL SELECT {cols} FROM {p2}))"""


def rule_sql(rule_id: str, source: str) -> str:
    src = DOCS_SRC if source == "documents" else CORPUS_SRC
    h = card_hits_cte(src) if rule_id == "structured:credit_card" else hits_cte(rule_id, src)
    return f"SELECT doc_id, start, \"end\", kind, text, confidence FROM {h}"


# -- per-line labels -------------------------------------------------------------------

def _phrases(phrases: list[str]) -> str:
    return "|".join(either_order(p, str, f"{WS}+") for p in phrases)


def _strip_side(x: str) -> str:
    cls = "[" + R.LINE_SIDE_STRIP.replace("-", "\\-").replace("\t", "\\t") + "]"
    return f"regexp_replace({x}, '^{cls}+|{cls}+$', '', 'g')"


def line_hits_sql(src: str) -> str:
    cols, picks = [], []
    for k, (kind, phrases) in enumerate(R.LINE_LABEL_SPECS, 1):
        rx = _phrases(phrases)
        full = f"^(.*?)(?:{rx})(.*)$"
        cols.append(f"""regexp_matches(line, '{rx}') AS m{k},
            regexp_extract(line, '{full}', 1) AS b{k}, regexp_extract(line, '{full}', 2) AS a{k}""")
    sel = ",\n            ".join(cols)
    vals = []
    for k in range(1, len(R.LINE_LABEL_SPECS) + 1):
        side = f"CASE WHEN length({_strip_side(f'a{k}')}) >= length({_strip_side(f'b{k}')}) THEN a{k} ELSE b{k} END"
        vals.append(f"{clean_sql(side)} AS v{k}")
    vsel = ",\n            ".join(vals)
    oks = [f"(m{k} AND length(v{k}) >= 3 AND strpos(line, v{k}) > 0)" for k in range(1, 7)]
    kind = "CASE " + " ".join(f"WHEN {oks[k-1]} THEN '{R.LINE_LABEL_SPECS[k-1][0]}'" for k in range(1, 7)) + " END"
    val = "CASE " + " ".join(f"WHEN {oks[k-1]} THEN v{k}" for k in range(1, 7)) + " END"
    return f"""
    (WITH s0 AS ({src}),
     sp AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM s0),
     l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM sp),
     l1 AS (SELECT doc_id, line, ln,
                   coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lstart FROM l0),
     l2 AS (SELECT *, {sel} FROM l1),
     l3 AS (SELECT *, {vsel} FROM l2),
     l4 AS (SELECT doc_id, ln, lstart, line, {kind} AS kind, {val} AS v FROM l3)
     SELECT doc_id, CAST(lstart + strpos(line, v) - 1 AS INTEGER) AS start,
            CAST(lstart + strpos(line, v) - 1 + length(v) AS INTEGER) AS "end",
            kind, v AS text, CAST({R.LINE_CONFIDENCE} AS DOUBLE) AS confidence,
            {R.LINE_RULE_ORDER} AS rule, CAST(ln AS INTEGER) AS seq
     FROM l4 WHERE kind IS NOT NULL)"""


def line_sql(kind: str) -> str:
    return (f"SELECT doc_id, start, \"end\", kind, text, confidence FROM {line_hits_sql(CORPUS_SRC)} "
            f"WHERE kind = '{kind}'")


# -- e-mail span working set, decisions, redaction, proof --------------------------------

def spans_cte(resolved: str) -> str:
    """Working set: resolved spans of the contract corpus, with ids."""
    return f"""espans AS (
        SELECT doc_id, {DOC_ID} AS document_id, start, "end", kind, text, confidence, lang,
               concat('pii_', substr(sha256(concat_ws('|', {DOC_ID}, start, "end", kind, text)), 1, 10)) AS span_id
        FROM {resolved})"""


DECISIONS_CTE = """dec AS (
        SELECT e.document_id, e.span_id, l.quality = 1 AS approved, 1 AS decided_at FROM espans e JOIN labels l USING (doc_id)
        UNION ALL
        SELECT e.document_id, e.span_id, false, 2 FROM espans e JOIN labels l USING (doc_id) WHERE l.toxic = 1
        UNION ALL
        SELECT e.document_id, e.span_id, true, 3 FROM espans e JOIN labels l USING (doc_id) WHERE doc_id % 7 = 0
        UNION ALL
        SELECT e.document_id, 'pii_nowhere', false, 9 FROM espans e JOIN labels l USING (doc_id)),
    latest AS (SELECT document_id, span_id, arg_max(approved, decided_at) AS approved FROM dec GROUP BY ALL),
    decided AS (SELECT e.*, coalesce(l.approved, true) AS approved FROM espans e LEFT JOIN latest l USING (document_id, span_id))"""


def bar_sql(kind: str, text: str) -> str:
    return (f"concat('[', upper({kind}), ' ', repeat('{R.BAR_CHAR}', "
            f"greatest({R.BAR_MIN}, least(length({text}), {R.BAR_MAX}))), ']')")


def splice_sql(text: str, spans: str) -> str:
    """Rebuild text with approved spans (list of structs s, e, k, t, a sorted
    by s) replaced by their bars."""
    prev = f"(CASE WHEN i = 1 THEN 0 ELSE {spans}[i - 1].e END)"
    piece = (f"substring({text}, {prev} + 1, {spans}[i].s - {prev}) || "
             f"CASE WHEN {spans}[i].a AND {spans}[i].e > {spans}[i].s THEN {bar_sql(f'{spans}[i].k', f'{spans}[i].t')} "
             f"ELSE substring({text}, {spans}[i].s + 1, {spans}[i].e - {spans}[i].s) END")
    last = f"(CASE WHEN len({spans}) = 0 THEN 0 ELSE {spans}[len({spans})].e END)"
    return (f"(array_to_string(list_transform(range(1, len({spans}) + 1), lambda i: {piece}), '') "
            f"|| substring({text}, {last} + 1))")


def _released_cte(docs: str = f"SELECT doc_id, {DOC_ID} AS document_id, text FROM documents",
                  issued: int = FIXED_ISSUED_AT) -> str:
    ipad, opad = _pads(DEMO_KEY)
    items = ("list(CASE WHEN approved THEN concat('{\"confidence\": ', CAST(round(confidence, 2) AS VARCHAR), "
             "', \"kind\": \"', kind, '\", \"lang\": \"', lang, '\", \"length\": ', CAST(length(text) AS VARCHAR), '}') END "
             "ORDER BY start) FILTER (WHERE approved)")
    iso = f"strftime(to_timestamp({issued}), '%Y-%m-%dT%H:%M:%SZ')"
    return f"""
    per AS (SELECT document_id,
                   list(struct_pack(s := start, e := "end", k := kind, t := text, a := approved) ORDER BY start) AS L,
                   count(*) FILTER (WHERE approved) AS cnt, {items} AS items
            FROM decided GROUP BY document_id),
    rel AS (SELECT d.doc_id, d.document_id, d.text,
                   coalesce(p.L, []) AS L, coalesce(p.cnt, 0) AS cnt, coalesce(p.items, []) AS items
            FROM ({docs}) d
            LEFT JOIN per p USING (document_id)),
    red AS (SELECT *, {splice_sql('text', 'L')} AS redacted FROM rel),
    body AS (SELECT *, concat('{{"document_id": "', document_id, '", "issued_at": {issued}, "issued_at_iso": "',
                    {iso}, '", "original_sha256": "', sha256(text), '", "product": "{R.PRODUCT}", "redacted_sha256": "',
                    sha256(redacted), '", "redaction_count": ', CAST(cnt AS VARCHAR), ', "redactions": [',
                    array_to_string(items, ', '), ']}}') AS body_json, {iso} AS issued_at_iso FROM red),
    sealed AS (SELECT *, sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(body_json)))) AS seal FROM body)"""


def candidates_sql(src: str, families: tuple[str, ...], lines: bool) -> str:
    """Valid hits of the chosen rule families after O01 (first rule wins an
    exact offset), plus the unchecked line hits."""
    cols = 'doc_id, start, "end", kind, text, confidence, rule, seq'
    parts = [f"SELECT {cols} FROM {card_hits_cte(src) if rid == 'structured:credit_card' else hits_cte(rid, src)}"
             for rid, r in _RULE_OBJ.items() if r.family in families]
    dedup = (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, \"end\" "
             f"ORDER BY rule, seq) AS rn FROM ({' UNION ALL '.join(parts)})) WHERE rn = 1")
    if lines:
        dedup += f" UNION ALL SELECT {cols} FROM {line_hits_sql(src)}"
    return dedup


def resolved_sql(cand: str) -> str:
    """Rank by (confidence desc, length desc, emission order); greedily
    keep spans overlapping no kept span; number kept spans by start."""
    greedy = ("list_reduce(list_transform(L, lambda x: [x]), lambda acc, x: CASE WHEN "
              "len(list_filter(acc, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN acc "
              "ELSE list_concat(acc, x) END)")
    return f"""
    (WITH c AS ({cand}),
     r AS (SELECT doc_id, list(struct_pack(s := start, e := "end", k := kind, t := text, c := confidence)
                  ORDER BY confidence DESC, "end" - start DESC, rule, seq) AS L FROM c GROUP BY doc_id),
     g AS (SELECT doc_id, unnest({greedy}) AS x FROM r)
     SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x.s) - 1 AS INTEGER) AS n,
            x.s AS start, x.e AS "end", x.k AS kind, x.t AS text, x.c AS confidence, {lang_sql('x.t')} AS lang
     FROM g)"""


def approved_values_sql(resolved: str, approved: str) -> str:
    """Stripped text of approved spans, length >= 3, first-seen order."""
    return f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS n, value, kind
        FROM (SELECT doc_id, n, value, kind, row_number() OVER (PARTITION BY doc_id, value ORDER BY n) AS first
              FROM (SELECT doc_id, n, {strip_sql('text')} AS value, kind FROM {resolved} WHERE {approved}))
        WHERE first = 1 AND length(value) >= {R.MIN_VALUE_LEN}"""


def value_redaction_sql(vals: str, docs: str) -> str:
    """Each place where an approved value or a fragment of one stands (no
    fragment of these data overlaps itself); overlapping places are one island,
    replaced by one bar of the kind that starts it (the longest there)."""
    frag_list = (f"list_concat([value], list_filter(list_transform(regexp_split_to_array(value, '{R.FRAGMENT_SPLIT}'), "
                 f"lambda p: {strip_sql('p')}), lambda p: length(p) >= 3))")
    return f"""
        WITH vals AS ({vals}),
        fr AS (SELECT doc_id, f, arg_min(kind, n) AS kind FROM
               (SELECT doc_id, n, kind, unnest({frag_list}) AS f FROM vals) WHERE f <> '' GROUP BY ALL),
        docs AS ({docs}),
        parts AS (SELECT d.doc_id, d.text, fr.f, fr.kind, list_transform(string_split(d.text, fr.f), lambda x: length(x)) AS l
                  FROM docs d JOIN fr USING (doc_id) WHERE contains(d.text, fr.f)),
        places AS (SELECT doc_id, text, f, kind, unnest(list_transform(range(1, len(l)),
                   lambda i: list_sum(list_slice(l, 1, i)) + (i - 1) * length(f))) AS s FROM parts),
        o AS (SELECT doc_id, text, kind, CAST(s AS BIGINT) AS s, CAST(s + length(f) AS BIGINT) AS e FROM places),
        b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM o),
        g AS (SELECT *, sum(CASE WHEN far IS NULL OR s >= far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS island FROM b),
        u AS (SELECT doc_id, island, any_value(text) AS text, min(s) AS s, max(e) AS e,
                     first(kind ORDER BY s, e DESC) AS kind FROM g GROUP BY doc_id, island),
        per AS (SELECT doc_id, list(struct_pack(s := s, e := e, k := kind, t := substring(text, s + 1, e - s), a := true) ORDER BY s) AS L
                FROM u GROUP BY doc_id)
        SELECT d.doc_id, {splice_sql('d.text', 'coalesce(p.L, [])')} AS redacted
        FROM docs d LEFT JOIN per p USING (doc_id)"""


def redact_rule_sql(rule_id: str, src: str) -> str:
    """Hits of one structured rule on ``src`` (doc_id, text) replaced by bars."""
    h = card_hits_cte(src) if rule_id == "structured:credit_card" else hits_cte(rule_id, src)
    return f"""SELECT s.doc_id, {splice_sql('s.text', 'coalesce(p.L, [])')} AS text FROM ({src}) s
        LEFT JOIN (SELECT doc_id, list(struct_pack(s := start, e := "end", k := kind, t := text, a := true)
                   ORDER BY start) AS L FROM {h} GROUP BY doc_id) p USING (doc_id)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n    ".join(c.strip() for c in ctes)


def build() -> dict[str, str]:
    q: dict[str, str] = {
        "d01_email": rule_sql("structured:email", "documents"),
        "d02_iban": rule_sql("structured:iban", "corpus"),
        "d03_credit_card": rule_sql("structured:credit_card", "documents"),
        "d03_credit_card_corpus": rule_sql("structured:credit_card", "corpus"),
        "d04_national_id": rule_sql("structured:national_id", "corpus"),
        "d05_phone": rule_sql("structured:phone", "documents"),
        "d05_phone_corpus": rule_sql("structured:phone", "corpus"),
        "d06_ip_address": rule_sql("structured:ip_address", "documents"),
        "d07_name_en": rule_sql("label_en:name", "corpus"),
        "d08_address_en": rule_sql("label_en:address", "corpus"),
        "d09_dob_en": rule_sql("label_en:dob", "documents"),
        "d09_dob_en_corpus": rule_sql("label_en:dob", "corpus"),
        "d10_iban_en": rule_sql("label_en:iban", "corpus"),
        "d11_name_ar": rule_sql("label_ar:name", "corpus"),
        "d12_address_ar": rule_sql("label_ar:address", "corpus"),
        "d13_dob_ar": rule_sql("label_ar:dob", "corpus"),
        "d14_national_id_ar": rule_sql("label_ar:national_id", "corpus"),
        "d15_phone_ar": rule_sql("label_ar:phone", "corpus"),
        "d16_iban_ar": rule_sql("label_ar:iban", "corpus"),
    }
    for i, (kind, _) in enumerate(R.LINE_LABEL_SPECS):
        q[f"d{17 + i}_{kind}_line"] = line_sql(kind)

    docs_all = (f"SELECT {DOC_ID} AS document_id, text FROM documents UNION ALL "
                f"SELECT {C.DOCUMENT_ID} AS document_id, {C.TEXT} AS text FROM customer")
    q["t05_document_language"] = (
        f"SELECT document_id, CASE WHEN regexp_matches(text, '[\\x{{600}}-\\x{{6FF}}]') AND regexp_matches(text, '[A-Za-z]') "
        f"THEN 'mixed' WHEN regexp_matches(text, '[\\x{{600}}-\\x{{6FF}}]') THEN 'ar' ELSE 'en' END AS lang, "
        f"CAST(length(text) AS INTEGER) AS char_count FROM ({docs_all})")
    q["t01_fold_digits"] = (
        f"SELECT doc_id, translate(text, '{AR_DIGITS}', '{R.ASCII_DIGITS}') AS folded, "
        f"length(translate(text, '{AR_DIGITS}', '{R.ASCII_DIGITS}')) = length(text) AS same_length FROM ({CORPUS_SRC})")
    lines = (f"SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no "
             f"FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({CORPUS_SRC}))")
    q["t03_clean_value"] = f"SELECT doc_id, line_no, {clean_sql('line')} AS cleaned FROM ({lines})"
    q["t02_strip_bidi"] = f"SELECT doc_id, line_no, translate(line, '{BIDI}', '') AS stripped FROM ({lines})"
    q["t04_either_order"] = " UNION ALL ".join(
        f"SELECT doc_id, line_no, '{kind}' AS kind FROM ({lines}) WHERE regexp_matches(line, "
        f"'{_phrases(phrases)}')" for kind, phrases in R.LINE_LABEL_SPECS)
    q["t06_span_language"] = f"SELECT doc_id, line_no, {lang_sql('line')} AS lang FROM ({lines})"
    q["t15_char_count"] = "SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count FROM documents"
    q["t11_text_preview"] = f"SELECT {DOC_ID} AS document_id, substring(text, 1, {R.PREVIEW_CHARS}) AS preview FROM documents"
    guess = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(label), '{w}')" for w in words) + f" THEN '{kind}'"
        for kind, words in R.GUESS_KIND_KEYWORDS) + f" ELSE '{R.GUESS_KIND_DEFAULT}' END"
    q["t08_guess_kind"] = (f"SELECT doc_id, line_no, label, {guess} AS kind FROM (SELECT doc_id, line_no, "
                           f"split_part(line, ': ', 1) AS label FROM ({lines}) WHERE contains(line, ': '))")
    frag = (f"list_concat([text], list_filter(list_transform(regexp_split_to_array(text, '{R.FRAGMENT_SPLIT}'), "
            f"lambda p: {strip_sql('p')}), lambda p: length(p) >= 3))")
    q["t09_fragments"] = (
        f"SELECT doc_id, start, CAST(pos - 1 AS INTEGER) AS pos, fragment FROM ("
        f"SELECT doc_id, start, unnest(f) AS fragment, unnest(range(1, len(f) + 1)) AS pos FROM ("
        f"SELECT doc_id, start, list_filter(l, lambda x, i: list_position(l, x) = i) AS f FROM ("
        f"SELECT doc_id, start, {frag} AS l FROM {line_hits_sql(CORPUS_SRC)})))")
    q["t12_sha256"] = f"SELECT {DOC_ID} AS document_id, sha256(text) AS sha256 FROM documents"
    q["t13_iso_utc"] = (f"SELECT o_orderkey, {FIXED_ISSUED_AT} + o_orderkey * 3601 AS epoch, "
                        f"strftime(to_timestamp({FIXED_ISSUED_AT} + o_orderkey * 3601), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
    lspans = (f"SELECT {C.DOCUMENT_ID.replace('c_custkey', 'doc_id')} AS document_id, "
              f"concat('pii_', substr(sha256(concat_ws('|', {C.DOCUMENT_ID.replace('c_custkey', 'doc_id')}, start, \"end\", kind, text)), 1, 10)) AS span_id, "
              f"kind, text, confidence, {lang_sql('text')} AS lang FROM {line_hits_sql(CORPUS_SRC)}")
    labels = "CASE " + " ".join(
        f"WHEN ui = '{lang}' AND kind = '{k}' THEN '{v}'" for lang, t in R.KIND_LABELS.items() for k, v in t.items()
    ) + " ELSE replace(kind, '_', ' ') END"
    q["t17_kind_label"] = (f"SELECT document_id, span_id, kind, lang, {labels} AS label FROM "
                           f"(SELECT *, CASE WHEN lang = 'ar' THEN 'ar' ELSE 'en' END AS ui FROM ({lspans}))")

    allfam = ("structured", "label_en", "label_ar")
    corpus_docs = f"SELECT c_custkey AS doc_id, {C.DOCUMENT_ID} AS document_id, {C.TEXT} AS text FROM customer"
    es = spans_cte(resolved_sql(candidates_sql(CORPUS_SRC, allfam, True)))
    q["t10_value_preview"] = _with(es) + f"""
        SELECT document_id, span_id, CASE WHEN length(v) <= {R.VALUE_PREVIEW_CHARS} THEN v
               ELSE concat(substring(v, 1, {R.VALUE_PREVIEW_CHARS}), '…') END AS preview
        FROM (SELECT document_id, span_id, {strip_sql("replace(text, chr(10), ' ')")} AS v FROM espans)"""
    q["t07_span_id"] = _with(es) + " SELECT document_id, start, span_id FROM espans"
    q["t18_redaction_bar"] = _with(es) + f" SELECT document_id, span_id, {bar_sql('kind', 'text')} AS bar FROM espans"
    q["o06_latest_decision"] = _with(es, DECISIONS_CTE) + " SELECT document_id, span_id, approved FROM latest"
    q["o05_apply_decisions"] = _with(es, DECISIONS_CTE) + " SELECT document_id, span_id, start, approved FROM decided"
    q["o04_approved"] = _with(es, DECISIONS_CTE) + ' SELECT document_id, span_id, start, "end" FROM decided WHERE approved'
    counts = """ SELECT d.document_id, coalesce(c.items_found, 0) AS items_found, coalesce(c.redacted_count, 0) AS redacted_count
        FROM (SELECT {doc_id} AS document_id FROM customer) d LEFT JOIN
             (SELECT document_id, count(*) AS items_found, count(*) FILTER (WHERE {flag}) AS redacted_count
              FROM decided GROUP BY document_id) c USING (document_id)"""
    q["o08_counts"] = _with(es, DECISIONS_CTE) + counts.format(doc_id=C.DOCUMENT_ID, flag="approved")
    q["o20_reject_all"] = _with(es, DECISIONS_CTE) + counts.format(doc_id=C.DOCUMENT_ID, flag="false")
    q["o07_unknown_documents"] = (
        f"SELECT concat('doc_', lpad(lower(hex(doc_id * 7)), 10, '0')) AS document_id, 'pii_0000000000' AS span_id, "
        f"toxic = 0 AS approved FROM labels WHERE concat('doc_', lpad(lower(hex(doc_id * 7)), 10, '0')) NOT IN "
        f"(SELECT {DOC_ID} FROM documents)")
    raw = "decided AS (SELECT *, true AS approved FROM espans)"
    q["o03_redact"] = _with(es, raw) + f"""
        , per AS (SELECT document_id, list(struct_pack(s := start, e := "end", k := kind, t := text, a := approved)
                  ORDER BY start) AS L FROM decided GROUP BY document_id)
        SELECT d.doc_id, {splice_sql('d.text', 'coalesce(p.L, [])')} AS redacted
        FROM ({corpus_docs}) d LEFT JOIN per p USING (document_id)"""
    rel = _with(es, DECISIONS_CTE, _released_cte(corpus_docs))
    q["o09_proof"] = rel + """ SELECT document_id, CAST(cnt AS INTEGER) AS redacted_count, sha256(text) AS original_sha256,
        sha256(redacted) AS redacted_sha256, issued_at_iso, body_json FROM sealed"""
    q["o10_seal"] = rel + f" SELECT document_id, seal, '{key_id(DEMO_KEY)}' AS key_id FROM sealed"
    q["o18_verify"] = rel + f""" SELECT document_id, true AS valid, issued_at_iso, CAST(cnt AS INTEGER) AS redaction_count,
        '{R.VERIFY_OK}' AS detail FROM sealed"""
    ways = ", ".join(f"'{w}'" for w in ("count", "text_field", "time", "null_field", "added", "added_null", "dropped"))
    q["o19_tamper"] = rel + f""" SELECT document_id, false AS valid, '{R.VERIFY_BAD}' AS detail, way
        FROM sealed, unnest([{ways}]) t(way)"""
    q["o18_verify_requests"] = rel + f""" , req AS (SELECT DISTINCT doc_id, {DOC_ID} AS id, concat('../doc_', doc_id) AS bad FROM labels)
        SELECT id AS document_id, s.seal IS NOT NULL AS found, s.seal IS NOT NULL AS valid,
               CASE WHEN s.seal IS NOT NULL THEN '{R.VERIFY_OK}' ELSE 'Not found.' END AS detail
        FROM req LEFT JOIN sealed s ON s.document_id = req.id
        UNION ALL SELECT bad, false, false, 'Invalid document id.' FROM req"""
    q["o18_verify_key_ring"] = rel + f""" SELECT document_id, doc_id % 3 <> 2 AND doc_id % 5 <> 0 AS valid,
        CASE WHEN doc_id % 3 = 2 THEN 'Unknown key.' WHEN doc_id % 5 = 0 THEN '{R.VERIFY_BAD}' ELSE '{R.VERIFY_OK}' END AS detail FROM sealed"""
    q["st2_stream_decisions"] = rel + """ SELECT document_id, CAST(cnt AS INTEGER) AS redacted_count, seal
        FROM sealed WHERE document_id IN (SELECT document_id FROM dec)"""
    q["t19_verify_message"] = rel + f""" SELECT document_id, true AS valid, '{R.VERIFY_OK}' AS detail, 'stored' AS copy FROM sealed
        UNION ALL SELECT document_id, false, '{R.VERIFY_BAD}', 'tampered' FROM sealed"""
    q["s10_proof_lookup"] = rel + f""" SELECT document_id, seal FROM sealed WHERE document_id IN
        (SELECT {DOC_ID} FROM labels WHERE quality = 1)"""
    q["s10_stored_proofs"] = q["s10_proof_lookup"]              # the sink = the table
    q["o22_release_changes"] = q["o10_seal"]                    # step by step = all at once

    q["o01_dedupe"] = (f"SELECT doc_id, start, \"end\", kind, text, confidence FROM "
                       f"({candidates_sql(CORPUS_SRC, allfam, False)})")
    q["o02_resolve"] = (f"SELECT doc_id, start, \"end\", kind, text, confidence FROM "
                        f"{resolved_sql(candidates_sql(CORPUS_SRC, allfam, False))}")
    q["d25_detect_corpus"] = f"SELECT * FROM {resolved_sql(candidates_sql(CORPUS_SRC, allfam, True))}"
    docs_resolved = resolved_sql(candidates_sql(DOCS_SRC, allfam, True))
    q["d25_detect_documents"] = f"SELECT * FROM {docs_resolved}"
    q["st1_stream_detect"] = q["d25_detect_documents"]          # stream = batch
    docs_decided = (f"decided AS (SELECT {DOC_ID} AS document_id, start, \"end\", kind, text, confidence, lang, "
                    f"true AS approved FROM {docs_resolved})")
    q["o22_release"] = (_with(docs_decided, _released_cte())
                        + f" SELECT document_id, CAST(cnt AS INTEGER) AS redacted_count, "
                          f"substring(redacted, 1, {R.PREVIEW_CHARS}) AS redacted_preview, seal FROM sealed")

    from .catalog import RESPONSE_SQL
    shape = ('{"output": {"markdown": "VARCHAR", "elements": [{"type": "VARCHAR", "text": "VARCHAR", '
             '"pairs": [{"key": {"value": "VARCHAR"}, "value": {"value": "VARCHAR"}, "confidence": "VARCHAR"}]}]}}')
    resp = (f"SELECT c_custkey AS doc_id, {RESPONSE_SQL} AS response FROM customer")
    parsed = f"SELECT doc_id, json_valid(response) AS ok, CASE WHEN json_valid(response) THEN from_json(response, '{shape}') END AS j FROM ({resp})"
    kv = ("list_filter(flatten(list_transform(list_filter(coalesce(j.output.elements, []), "
          "lambda e: e.type = 'keyValueRegion'), lambda e: coalesce(e.pairs, []))), "
          "lambda p: coalesce(length(p.value.value), 0) > 0)")
    el_text = ("array_to_string(list_transform(coalesce(j.output.elements, []), lambda e: CASE WHEN e.type = 'keyValueRegion' "
               "THEN array_to_string(list_transform(list_filter(coalesce(e.pairs, []), lambda p: coalesce(length(p.value.value), 0) > 0), "
               "lambda p: concat(coalesce(p.key.value, ''), ': ', p.value.value, chr(10))), '') "
               "WHEN e.type IN ('paragraph', 'text') AND coalesce(length(e.text), 0) > 0 THEN concat(e.text, chr(10)) ELSE '' END), '')")
    q["s06_parse"] = (f"SELECT doc_id, ok AS valid_json, concat(coalesce(j.output.markdown, ''), {el_text}) AS ext_text "
                      f"FROM ({parsed})")
    guess_p = guess.replace("label", "coalesce(p.key.value, '')")
    q["o11_external_candidates"] = f"""
        SELECT doc_id, concat('ext_', CAST(n - 1 AS VARCHAR)) AS span_id, {guess_p} AS kind, p.value.value AS text,
               0 AS start, 0 AS "end", coalesce(nullif(try_cast(p.confidence AS DOUBLE), 0), {R.EXTERNAL_DEFAULT_CONFIDENCE}) AS confidence
        FROM (SELECT doc_id, unnest(P) AS p, unnest(range(1, len(P) + 1)) AS n
              FROM (SELECT doc_id, {kv} AS P FROM ({parsed}) WHERE ok))"""
    # Own-text detection, detection on the external text (when non-empty
    # and different), then external candidates; B-side spans are kept only if
    # their (kind, text) is new.  Malformed JSON → own spans, local-fallback.
    ext = f"SELECT p.doc_id, p.valid_json, p.ext_text FROM ({q['s06_parse']}) p"
    own_text = f"SELECT c_custkey AS doc_id, {C.TEXT} AS text FROM customer"
    ext_src = (f"SELECT e.doc_id, e.ext_text AS text FROM ({ext}) e JOIN ({own_text}) o USING (doc_id) "
               f"WHERE e.valid_json AND length(e.ext_text) > 0 AND e.ext_text <> o.text")
    own_sp = resolved_sql(candidates_sql(CORPUS_SRC, allfam, True))
    ext_sp = resolved_sql(candidates_sql(ext_src, allfam, True))
    cands = f"SELECT doc_id, CAST(substr(span_id, 5) AS INTEGER) AS n, kind, text, start, \"end\", confidence FROM ({q['o11_external_candidates']})"
    merged = f"""
        WITH parts AS (
            SELECT doc_id, 0 AS part, n AS idx, kind, text, start, "end", confidence FROM {own_sp}
            UNION ALL SELECT doc_id, 1, n, kind, text, 0, 0, confidence FROM {ext_sp}
            UNION ALL SELECT doc_id, 2, n, kind, text, start, "end", confidence FROM ({cands})),
        valid AS (SELECT doc_id, valid_json FROM ({ext})),
        kept AS (SELECT p.* FROM parts p JOIN valid v USING (doc_id)
                 WHERE p.part = 0 OR v.valid_json),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, text ORDER BY part, idx) AS rn FROM kept)
        SELECT r.doc_id, CASE WHEN v.valid_json THEN 'external' ELSE 'local-fallback' END AS engine,
               CAST(row_number() OVER (PARTITION BY r.doc_id ORDER BY part, idx) - 1 AS INTEGER) AS n,
               kind, text, start, "end", confidence
        FROM ranked r JOIN valid v USING (doc_id) WHERE part = 0 OR rn = 1"""
    q["o13_extract_external"] = merged
    q["o12_merge"] = f"SELECT doc_id, kind, text, count(*) AS n FROM ({merged}) GROUP BY ALL"
    q["t14_round_length"] = f"SELECT doc_id, n, round(confidence, 2) AS confidence, CAST(length(text) AS INTEGER) AS length FROM ({merged})"
    q["t16_review_flags"] = (f"SELECT doc_id, n, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS pct, "
                             f"confidence < {R.LOW_CONFIDENCE} AS low FROM ({merged})")
    q["s09_clean_copy"] = (
        f"SELECT r.document_id, CASE WHEN d.lang = 'en' THEN 'signed' WHEN d.doc_id IS NOT NULL THEN 'redacted' "
        f"ELSE 'not_found' END AS source FROM "
        f"(SELECT {DOC_ID} AS document_id FROM labels UNION ALL "
        f"SELECT concat('doc_', lpad(lower(hex(doc_id * 7 + 3)), 10, '0')) AS document_id FROM labels) r LEFT JOIN "
        f"(SELECT doc_id, lang, {DOC_ID} AS document_id FROM documents) d USING (document_id)")

    cdoc = C.DOCUMENT_ID.replace("c_custkey", "doc_id")
    resolved = resolved_sql(candidates_sql(CORPUS_SRC, allfam, True))
    span_id = f"concat('pii_', substr(sha256(concat_ws('|', {cdoc}, start, \"end\", kind, text)), 1, 10))"
    en_label = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in R.KIND_LABELS["en"].items()) \
        + " ELSE replace(kind, '_', ' ') END"
    q["o21_review_list"] = f"""
        SELECT {cdoc} AS document_id, {span_id} AS span_id, start, kind, {en_label} AS kind_label, text, lang,
               true AS approved, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS confidence_pct,
               confidence < {R.LOW_CONFIDENCE} AS low_confidence
        FROM {resolved}"""
    q["o14_approved_values"] = approved_values_sql(resolved, "NOT (kind = 'email' AND doc_id % 5 = 0)")
    frags_v = (f"list_concat([v], list_filter(list_transform(regexp_split_to_array(v, '{R.FRAGMENT_SPLIT}'), "
               f"lambda p: {strip_sql('p')}), lambda p: length(p) >= 3))")
    pv = strip_sql("replace(v, chr(10), ' ')")
    preview_v = (f"CASE WHEN length({pv}) <= {R.VALUE_PREVIEW_CHARS} THEN {pv} "
                 f"ELSE concat(substring({pv}, 1, {R.VALUE_PREVIEW_CHARS}), '…') END")
    q["o17_operation_log"] = f"""
        WITH vals AS ({q["o14_approved_values"]}),
        per AS (SELECT doc_id, list(value ORDER BY n) AS V FROM vals GROUP BY doc_id),
        docs AS ({CORPUS_SRC})
        SELECT d.doc_id, list_concat(list_transform(list_filter(coalesce(p.V, []),
                   lambda v: len(list_filter({frags_v}, lambda f: strpos(d.text, f) > 0)) > 0),
                   lambda v: concat('stage_value «', {preview_v}, '»')),
               ['apply_redactions', 'seal (hmac-sha256)']) AS ops
        FROM docs d LEFT JOIN per p USING (doc_id)"""
    q["o15_value_redaction"] = value_redaction_sql(q["o14_approved_values"], CORPUS_SRC)
    docs_vals = approved_values_sql(docs_resolved, "true")
    net = f"SELECT doc_id, redacted AS text FROM ({value_redaction_sql(docs_vals, DOCS_SRC)})"
    for rid in ("structured:email", "structured:credit_card", "structured:phone"):
        net = redact_rule_sql(rid, net)
    q["o16_safety_net"] = f"SELECT doc_id, text AS redacted FROM ({net})"
    corpus_decided = (f"decided AS (SELECT {cdoc} AS document_id, start, \"end\", kind, text, confidence, lang, "
                      f"true AS approved FROM {resolved})")
    q["o22_release_corpus"] = (_with(corpus_decided, _released_cte(corpus_docs))
                               + " SELECT document_id, CAST(cnt AS INTEGER) AS redacted_count, "
                                 "redacted AS redacted_text, seal FROM sealed")

    released = _with(corpus_decided, _released_cte(corpus_docs))
    later = _with(corpus_decided, _released_cte(corpus_docs, FIXED_ISSUED_AT + 3600))
    q["s07_clean_text"] = released + """ SELECT document_id, CASE WHEN doc_id % 7 = 0 THEN concat('revised: ', redacted)
        ELSE redacted END AS text FROM sealed"""
    q["s08_proofs"] = (f"SELECT document_id, body_json, seal FROM ({released} SELECT * FROM sealed) WHERE doc_id % 7 <> 0 "
                       f"UNION ALL SELECT document_id, body_json, seal FROM ({later} SELECT * FROM sealed) WHERE doc_id % 7 = 0")
    q["s11_state"] = _with(es) + """ SELECT document_id, span_id, NOT (doc_id % 7 = 0 AND kind = 'email') AS approved FROM espans"""
    q["s11_erased"] = _with(es) + """ SELECT document_id, span_id, kind FROM espans WHERE doc_id % 11 <> 0
        AND (doc_id % 7 <> 0 OR kind IN ('email', 'iban', 'credit_card', 'ip_address'))"""

    # O22, external path: values of all approved merged spans relocated in the own
    # text; documents with unusable responses are released locally
    keep = "NOT (kind = 'email' AND doc_id % 5 = 0)"
    outside = "SELECT doc_id, n, kind, text FROM mg WHERE engine = 'external'"
    vals = approved_values_sql(f"({outside})", keep)
    own_decided = (f"decided AS (SELECT {cdoc} AS document_id, start, \"end\", kind, text, confidence, lang, "
                   f"{keep} AS approved FROM {own_sp})")
    q["o22_release_external"] = f"""
        WITH mg AS MATERIALIZED ({merged}),
        counts AS (SELECT doc_id, count(*) FILTER (WHERE {keep}) AS cnt FROM mg GROUP BY doc_id),
        ok AS (SELECT doc_id, valid_json FROM ({ext})),
        ex AS ({value_redaction_sql(vals, CORPUS_SRC)}),
        loc AS ({_with(own_decided, _released_cte(corpus_docs))} SELECT doc_id, redacted FROM sealed),
        pv AS (SELECT doc_id, list(value ORDER BY n) AS V FROM ({vals}) GROUP BY doc_id),
        ops AS (SELECT d.doc_id, list_concat(list_transform(list_filter(coalesce(p.V, []),
                   lambda v: len(list_filter({frags_v}, lambda f: strpos(d.text, f) > 0)) > 0),
                   lambda v: concat('stage_value «', {preview_v}, '»')),
               ['apply_redactions', 'seal (hmac-sha256)']) AS ops
               FROM ({CORPUS_SRC}) d LEFT JOIN pv p USING (doc_id))
        SELECT {cdoc} AS document_id, CASE WHEN valid_json THEN 'external' ELSE 'local-fallback' END AS engine,
               CAST(coalesce(cnt, 0) AS INTEGER) AS redacted_count,
               CASE WHEN valid_json THEN ex.redacted ELSE loc.redacted END AS redacted_text,
               CASE WHEN valid_json THEN ops.ops ELSE [] END AS operations, true AS signature_valid
        FROM ok JOIN ex USING (doc_id) JOIN loc USING (doc_id) JOIN ops USING (doc_id) LEFT JOIN counts USING (doc_id)"""

    exts = ["'.txt'", "'.TXT'", "'.pdf'", "'.html'", "''"]
    ext = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exts)) + " END"
    irows = (f"SELECT doc_id, concat('/corpus/', source, '/doc', CAST(doc_id AS VARCHAR), {ext}) AS path, "
             f"encode(coalesce(text, '')) AS content FROM documents")
    fname = "CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '' THEN 'document.txt' ELSE regexp_extract(path, '([^/]*)$', 1) END"
    q["s03_intake_guards"] = f"""
        SELECT path, filename, length, reject_reason, reject_reason IS NULL AS has_id FROM (
          SELECT path, filename, length,
                 CASE WHEN length = 0 THEN 'empty' WHEN length > {R.MAX_UPLOAD_BYTES} THEN 'too_large'
                      WHEN NOT (lower(filename) LIKE '%.pdf' OR lower(filename) LIKE '%.txt') THEN 'unsupported_type'
                      WHEN lower(filename) LIKE '%.pdf' THEN 'pdf_text_required' END AS reject_reason
          FROM (SELECT path, {fname} AS filename, CAST(octet_length(content) AS BIGINT) AS length FROM ({irows})))"""
    q["s01_intake_files"] = """SELECT doc_id, n AS length, CASE WHEN n > 4096 THEN 'too_large' END AS reject_reason,
        CASE WHEN n <= 4096 THEN sha256(concat(text, chr(10))) END AS text_sha256
        FROM (SELECT doc_id, text, CAST(strlen(coalesce(text, '')) AS BIGINT) + 1 AS n FROM documents)"""
    q["s02_decode"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    q["s04_document_id"] = (f"SELECT path, concat('doc_', substr(sha256(encode(path) || content), 1, 10)) AS document_id "
                            f"FROM ({irows})")
    cand = (f"CASE WHEN doc_id % 3 = 0 THEN concat('../', {DOC_ID}) WHEN doc_id % 3 = 1 THEN upper({DOC_ID}) "
            f"ELSE {DOC_ID} END")
    q["s05_valid_id"] = (f"SELECT doc_id, candidate, regexp_full_match(candidate, 'doc_[0-9a-f]{{10}}') AS valid "
                         f"FROM (SELECT doc_id, {cand} AS candidate FROM documents)")
    return q
