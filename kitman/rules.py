"""Rule registry: the detection rules, label lists and limits.

FIXED VALUES. Everything in the first block below must equal the behaviour
being reproduced (patterns, label phrases, confidences, limits, labels,
messages).  They are written in the Python ``re`` dialect, in their natural
order; ``kitman.functions.dialect`` derives the Java-regex forms Spark runs.
"""
from __future__ import annotations

from dataclasses import dataclass

# ----------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; do not reorder)
# ----------------------------------------------------------------------------

# Structured identifiers: (kind, Python regex, confidence), run in this order on
# the digit-normalised text.
STRUCTURED_PATTERNS: list[tuple[str, str, float]] = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0.98),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b", 0.97),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b", 0.80),
    ("national_id", r"(?<![\dA-Za-z])[12]\d{9}(?!\d)", 0.85),
    ("phone", r"(?<![A-Za-z])(?:\+?\d[\d\s\-()]{7,}\d)", 0.70),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.80),
]

# Label-driven values, English then Arabic, in this order; case-insensitive,
# run on the original text; group 1 is the value.
LABELS_EN: list[tuple[str, str]] = [
    ("name", r"(?:name|full name|client|applicant|patient|tenant)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("address", r"(?:address|residence)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("dob", r"(?:date of birth|dob|born)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("iban", r"(?:iban|account\s*(?:no\.?|number)|acct)[^\S\n]*[:\-]?[^\S\n]*([A-Z0-9][A-Z0-9 ]{10,40})"),
]
LABELS_AR: list[tuple[str, str]] = [
    ("name", r"(?:الاسم|الإسم|اسم العميل|اسم المريض|المتقدم)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("address", r"(?:العنوان|السكن|محل الإقامة)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("dob", r"(?:تاريخ الميلاد|المولد)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("national_id", r"(?:رقم الهوية|الهوية الوطنية|السجل المدني)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("phone", r"(?:الهاتف|الجوال|رقم الجوال|رقم الهاتف)[^\S\n]*[:\-]?[^\S\n]*(.+)"),
    ("iban", r"(?:رقم الآيبان|الآيبان|الايبان|رقم الحساب|الحساب البنكي)[^\S\n]*[:\-]?[^\S\n]*([A-Z0-9][A-Z0-9 ]{10,40})"),
]
LABEL_CONFIDENCE = 0.75

# Order-agnostic per-line labels: (kind, phrases); first kind that yields a
# value wins, one span per line.
LINE_LABEL_SPECS: list[tuple[str, list[str]]] = [
    ("national_id", ["رقم الهوية", "الهوية الوطنية", "السجل المدني"]),
    ("iban", ["رقم الآيبان", "الآيبان", "الايبان", "رقم الحساب"]),
    ("phone", ["رقم الجوال", "رقم الهاتف", "الجوال", "الهاتف"]),
    ("dob", ["تاريخ الميلاد", "المولد"]),
    ("name", ["اسم العميل", "اسم المستأجر", "اسم المريض"]),
    ("address", ["العنوان", "محل الإقامة", "السكن"]),
]
LINE_CONFIDENCE = 0.72
LINE_SIDE_STRIP = " \t:،؛-"          # stripped before comparing side lengths
MIN_VALUE_LEN = 3                    # structured raw text and line values

ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"   # folded to 0-9, length preserving
ASCII_DIGITS = "0123456789"
ARABIC_RANGE = "\u0600-\u06ff"                   # language test (Arabic block)
# Bidi / zero-width marks removed from captured values.
BIDI_CONTROLS = ("\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
                 "\u2066\u2067\u2068\u2069\ufeff")
VALUE_EDGE_SEPARATORS = ".,;:،؛"     # stripped (with whitespace) from value edges

# Redaction bar.
BAR_CHAR = "█"
BAR_MIN, BAR_MAX = 4, 12

# Intake guards.
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
ALLOWED_EXTENSIONS = (".pdf", ".txt")
DEFAULT_FILENAME = "document.txt"
DOC_ID_PREFIX = "doc_"
SPAN_ID_PREFIX = "pii_"
ID_HEX_WIDTH = 10

# Review.
LOW_CONFIDENCE = 0.6
PREVIEW_CHARS = 1200
VALUE_PREVIEW_CHARS = 14

# External extraction response.
EXTERNAL_DEFAULT_CONFIDENCE = 0.6
EXTERNAL_PAIR_TYPE = "keyValueRegion"
EXTERNAL_TEXT_TYPES = ("paragraph", "text")
# Label text -> kind, tested in this order, case-insensitive substring match.
GUESS_KIND_KEYWORDS: list[tuple[str, list[str]]] = [
    ("email", ["email", "بريد"]),
    ("phone", ["phone", "mobile", "هاتف", "جوال"]),
    ("national_id", ["id", "هوية", "سجل"]),
    ("iban", ["iban", "account", "حساب"]),
    ("address", ["address", "عنوان"]),
    ("name", ["name", "اسم", "عميل", "مريض"]),
]
GUESS_KIND_DEFAULT = "field"
FRAGMENT_SPLIT = r"[،؛;,\-–—]"       # value fragments for exact-value redaction
SAFETY_NET_PRESETS = ["email-address", "credit-card-number", "international-phone-number"]

# Localised kind labels (review list badge).
KIND_LABELS = {
    "ar": {"name": "اسم", "national_id": "هوية", "email": "بريد", "iban": "آيبان",
           "phone": "جوال", "address": "عنوان", "credit_card": "بطاقة", "dob": "ميلاد",
           "ip_address": "IP", "field": "حقل"},
    "en": {"name": "Name", "national_id": "National ID", "email": "Email", "iban": "IBAN",
           "phone": "Phone", "address": "Address", "credit_card": "Card", "dob": "DOB",
           "ip_address": "IP", "field": "Field"},
}

# Proof / verification.
TAMPER_COUNT = 9999
VERIFY_OK = "Signature valid — the proof is intact and untampered."
VERIFY_BAD = "Signature INVALID — the proof was altered after signing."
TAMPER_DETAIL = "Proof body was altered — verification now fails, as it should."

# ----------------------------------------------------------------------------
# Own choices (not reproduced values)
# ----------------------------------------------------------------------------
PRODUCT = "kitman"                   # proof "product" field
PROOF_VERSION = 1                    # canonical-JSON form version
SENTINEL_OPEN = "\ue000"           # private-use marks around regex hits
SENTINEL_CLOSE = "\ue001"
PUA_REPLACEMENT = "\ufffd"


@dataclass(frozen=True)
class Rule:
    """One span-generating rule, in emission order."""
    order: int          # emission slot (ties in overlap ranking)
    kind: str
    python_pattern: str
    confidence: float
    family: str         # 'structured' | 'label_en' | 'label_ar'


def rules() -> list[Rule]:
    out: list[Rule] = []
    for kind, pat, conf in STRUCTURED_PATTERNS:
        out.append(Rule(len(out), kind, pat, conf, "structured"))
    for kind, pat in LABELS_EN:
        out.append(Rule(len(out), kind, pat, LABEL_CONFIDENCE, "label_en"))
    for kind, pat in LABELS_AR:
        out.append(Rule(len(out), kind, pat, LABEL_CONFIDENCE, "label_ar"))
    return out


LINE_RULE_ORDER = len(STRUCTURED_PATTERNS) + len(LABELS_EN) + len(LABELS_AR)
