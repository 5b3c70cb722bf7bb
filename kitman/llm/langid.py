"""Language identification with a bit-sliced Bloom filter of letter trigrams.

A trigram's ``HASHES`` slots each hold one bit per language; the AND of the
slots is the set of all languages whose profile contains the trigram, in one
lookup.  Over a whole text the bits are counted per language, the counts are
corrected for that language's false-positive rate, and the largest decides.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, save

#: Bound of the fit: about so many documents of a language give its profile.
SAMPLE_DOCS = 2000
#: A profile keeps trigrams of at least this share of its language's, so at most 1 / MIN_SHARE.
MIN_SHARE = 2e-5
SLOTS, HASHES, BLOCK, UNKNOWN = 1 << 19, 3, 1 << 20, "und"
#: A text is of no learned language if the share of its trigrams in the best profile
#: is below MIN_SCORE by more than MIN_SIGMAS deviations of a share of so many trigrams.
MIN_SCORE, MIN_SIGMAS = 0.5, 2.0
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Trigrams of the lower-cased letters, other characters as one space; blocks
    of a whole text of any length.  Three code points of 21 bits make a long."""
    carry = np.array([32], np.uint64)
    low = text.lower() + " "
    for at in range(0, len(low), BLOCK):
        cp = np.frombuffer(low[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.concatenate([carry, np.where(_LETTER[cp], cp, 32)])
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
        if len(cp) >= 3:
            g = (cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:]
            yield g[cp[1:-1] != 32]
        carry = cp[-2:]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(mix(grams, i + 1) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    """``bits[slice, slot]``: bit b of slice s stands for language 8 s + b."""

    langs: list[str]
    bits: np.ndarray

    def rates(self) -> np.ndarray:
        """False-positive rate of each language: its share of set slots to the power HASHES."""
        set_ = np.array([np.bincount(s, minlength=256) for s in self.bits]).reshape(-1, 256)
        fill = (set_ @ _BIT_OF).reshape(-1)[:len(self.langs)] / SLOTS
        return np.minimum(fill ** HASHES, 0.999)

    def predict(self, text: str | None, wrong: np.ndarray) -> tuple[str, float, int]:
        """Language, share of the trigrams that its profile holds, and their number."""
        n, counts = 0, np.zeros((len(self.bits), 8), np.int64)
        for g in trigrams(text or ""):
            at = _slots(g)
            n += len(g)
            for s, table in enumerate(self.bits):
                m = table[at[0]]
                for a in at[1:]:
                    m = m & table[a]
                counts[s] += np.bincount(m, minlength=256) @ _BIT_OF
        if not n or not self.langs:
            return UNKNOWN, 0.0, n
        own = np.maximum((counts.reshape(-1)[:len(self.langs)] - n * wrong) / (1 - wrong), 0)
        best = int(np.argmax(own))
        return self.langs[best], float(min(1.0, own[best] / n)), n


def most_share(share: float, n: int, sigmas: float = MIN_SIGMAS) -> float:
    """Upper Wilson bound of a share seen in ``n`` draws; 0 if nothing was seen."""
    if not n or share <= 0:
        return 0.0
    z = sigmas * sigmas / n
    return (share + z / 2 + (z * share * (1 - share) + z * z / 4) ** 0.5) / (1 + z)


_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fit(docs: DataFrame, learn: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Profiles of the languages named in ``docs.lang`` (rows with a null lang or
    text, or not in ``learn``, teach nothing)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn is None else learn))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    slices = -(-len(langs) // 8)
    model = Model(langs, np.zeros((slices, SLOTS), np.uint8))
    if not langs:
        return model
    share = F.create_map(*(F.lit(x) for l in langs for x in (l, min(1.0, sample_docs / sizes[l]))))
    number = F.create_map(*(F.lit(x) for i, l in enumerate(langs) for x in (l, i)))
    picked = (rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))
              .select(F.element_at(number, F.col("lang")).alias("l"), "text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ls = np.array(b.column(0).to_pylist())
            for l in np.unique(ls).tolist():
                parts = [g for t in b.column(1).filter(pa.array(ls == l)) for g in trigrams(t.as_py())]
                g, n = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), l, np.int32)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["l", "g", "n"])

    counts = save(picked.mapInArrow(grams, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "grams")
    least = counts.groupBy("l").agg((F.sum("n") * MIN_SHARE).alias("least"))
    kept = counts.join(F.broadcast(least), "l").where("n >= least").select("l", "g")   # one row a language

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l = np.asarray(b.column(0), dtype=np.int32)
            for at in _slots(np.asarray(b.column(1)).astype(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(l // 8), pa.array(at), pa.array((1 << (l % 8)).astype(np.int32))],
                                                 names=["s", "slot", "bit"])

    filled = (kept.mapInArrow(slots, "s int, slot long, bit int").groupBy("s", "slot").agg(F.bit_or("bit").alias("bits"))
              .toPandas())                                # at most SLOTS rows a slice, whatever the corpus
    model.bits[filled["s"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint8)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: a learned language, or ``und`` if
    the text is null or has no letter (or nothing was learned).  score: the share
    of trigrams that the language's profile holds.  Ties go to the first language
    by name; repeated rows repeat; further columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        wrong = m.rates()
        for b in batches:
            got = [m.predict(t.as_py(), wrong) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs``, all columns, without the rows whose text is of no learned language:
    no letter, no trigram in any profile, or a share of trigrams in the best profile
    that is below ``min_score`` even at the upper bound for their number."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        wrong = m.rates()
        for b in batches:
            got = (m.predict(t.as_py(), wrong) for t in b.column(at))
            yield b.filter(pa.array([l != UNKNOWN and most_share(s, n) >= min_score for l, s, n in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
