"""Derived bilingual contract corpus, built from ``customer`` inside the query.

The driver's ``documents`` table has no Arabic, no name/address labels and no
IBANs, so label, IBAN and Arabic rules would only ever compare empty with
empty.  This corpus gives them data at every scale factor and grows with
``customer``.  The column expressions are plain SQL accepted verbatim by both
Spark (``F.expr``) and DuckDB, so the oracle reads exactly the same text.

With k = c_custkey, layout k % 4: 0 ``label: value`` lines, 1 labels glued to
values, 2 value before a word-reversed label, 3 English labels only.  When
k % 8 = 0 every digit is written as an Arabic-Indic digit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"


def _pick(options: list[str]) -> str:
    """Choose by floor(k / 4) % 4 without integer division (dialect-neutral)."""
    o = [s.replace("'", "''") for s in options]
    return ("CASE WHEN c_custkey % 16 < 4 THEN '{0}' WHEN c_custkey % 16 < 8 THEN '{1}' "
            "WHEN c_custkey % 16 < 12 THEN '{2}' ELSE '{3}' END").format(*o)


NAMES_AR = ["عمر بن صالح الغامدي", "سارة محمد القحطاني", "فهد عبدالله الدوسري", "نورة علي الشهري"]
ADDRESSES_AR = ["حي المروج، تبوك", "حي الروضة، جدة", "حي الشاطئ، الدمام", "حي العليا، الخبر"]


def _reversed_words(s: str) -> str:
    return " ".join(reversed(s.split()))


K = "cast(c_custkey as string)"
DOCUMENT_ID = "concat('doc_', lpad(lower(hex(c_custkey)), 10, '0'))"
FILENAME = f"concat('contract_', {K}, '.txt')"
NATIONAL_ID = "cast(1000000000 + c_custkey as string)"
PHONE = ("concat('+966 55 ', lpad(cast(c_custkey % 1000 as string), 3, '0'), ' ', "
         "lpad(cast(c_custkey % 10000 as string), 4, '0'))")
EMAIL = f"concat('c', {K}, '@example.com')"
IBAN = f"concat('SA03', lpad({K}, 20, '0'))"
CARD = "concat('4111 1111 1111 ', lpad(cast(c_custkey % 10000 as string), 4, '0'))"
DOB = ("concat('19', cast(60 + c_custkey % 40 as string), '-0', cast(1 + c_custkey % 9 as string), "
       "'-1', cast(c_custkey % 10 as string))")
IP = ("concat('10.', cast(c_custkey % 256 as string), '.', cast(c_custkey % 100 as string), '.1')")
NAME_AR = _pick(NAMES_AR)
NAME_AR_REV = _pick([_reversed_words(s) for s in NAMES_AR])
ADDRESS_AR = _pick(ADDRESSES_AR)
ADDRESS_AR_REV = _pick([_reversed_words(s) for s in ADDRESSES_AR])


def _lines(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


LAYOUT_0 = _lines(
    "'وثيقة تعاقد'", NL,
    "'اسم العميل: '", NAME_AR, NL,
    "'رقم الهوية: '", NATIONAL_ID, NL,
    "'الجوال: '", PHONE, NL,
    "'البريد الإلكتروني: '", EMAIL, NL,
    "'رقم الآيبان: '", IBAN, NL,
    "'العنوان: '", ADDRESS_AR, "'  '", NL,
    "'تاريخ الميلاد: '", DOB, NL)
LAYOUT_1 = _lines(
    "':اسم العميل'", NAME_AR, NL,
    "':رقم الهوية'", NATIONAL_ID, NL,
    "':رقم الآيبان'", IBAN, NL,
    "':العنوان'", ADDRESS_AR, NL)
LAYOUT_2 = _lines(
    NAME_AR_REV, "' :العميل اسم'", NL,
    ADDRESS_AR_REV, "' :العنوان'", NL,
    "'Tenant: '", "c_name", NL)
LAYOUT_3 = _lines(
    "'Contract record'", NL,
    "'Applicant: '", "c_name", NL,
    "'Email: '", EMAIL, NL,
    "'IBAN: '", IBAN, NL,
    "'Card: '", CARD, "' exp 12/29'", NL,
    "'Address: '", K, "' Palm Street, Abha'", NL,
    "'Date of birth: '", DOB, NL,
    "'Phone: '", PHONE, NL,
    "'Server '", IP, "' ok'", NL)

_TEXT = (f"CASE WHEN c_custkey % 4 = 0 THEN {LAYOUT_0} WHEN c_custkey % 4 = 1 THEN {LAYOUT_1} "
         f"WHEN c_custkey % 4 = 2 THEN {LAYOUT_2} ELSE {LAYOUT_3} END")
TEXT = (f"CASE WHEN c_custkey % 8 = 0 THEN translate({_TEXT}, '0123456789', '٠١٢٣٤٥٦٧٨٩') "
        f"ELSE {_TEXT} END")

# The same projection as SQL (DuckDB oracle side).
CORPUS_SQL = (f"SELECT c_custkey, {DOCUMENT_ID} AS document_id, {FILENAME} AS filename, "
              f"{TEXT} AS text FROM customer")


def contract_corpus(customer: DataFrame) -> DataFrame:
    return customer.select(
        "c_custkey",
        F.expr(DOCUMENT_ID).alias("document_id"),
        F.expr(FILENAME).alias("filename"),
        F.expr(TEXT).alias("text"),
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_corpus_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_corpus(load(spark, sf_dir, "customer"))
