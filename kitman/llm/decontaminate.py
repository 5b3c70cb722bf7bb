"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two).  Within
a partition every item is represented by its bottom-k MinHash sketch, with k one
more than the shingles an item of that partition may miss at the threshold.  A
document that contains an item at the threshold must then hold at least one
sketch value (it misses fewer than k), so probing the sketch index loses no
pair however long the document; a document with fewer shingles than the least
item of a partition needs skips it.  Candidates are verified by exact shingle
containment on the words themselves.

Items of up to ``BLOCK_SHINGLES`` shingles in all (counted in Spark) travel to the
tasks as one index.  A larger benchmark stays in Spark: its sketches are joined with
the documents' distinct shingle hashes, and the candidates are verified by a join on
the shingles, so neither the driver nor a broadcast grows with the benchmark.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, save, set_aside, sized, word_hashes

WIDTH, THRESHOLD = 5, 0.8
#: Shingles of all items up to which they are broadcast as one index.
BLOCK_SHINGLES = 500_000
_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_FILTER_BITS = 20
#: Leading bits of a hash by which the joined path tells what no sketch holds.
_SKETCH_BITS = 27


def words(text: str | None) -> list[bytes]:
    """Lower-cased maximal runs of characters other than ASCII non-alphanumerics."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACE).split()


def _count(n_words: int, width: int) -> int:
    return 0 if not n_words else max(1, n_words - width + 1)


def _strings(ws: list[bytes], at, width: int) -> set[bytes]:
    return {b" ".join(ws[i:i + width]) for i in at}


def _hashes(ws: list[bytes], width: int) -> np.ndarray:
    """Hash of each shingle; fewer words than ``width`` make one shingle of all."""
    h = word_hashes(ws)
    w = min(width, len(ws))
    out = np.zeros(_count(len(ws), width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(w if len(ws) else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(out)]
    return mix(out, w)


def _sketch(hs: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Bottom-k of the distinct hashes, and the least size in the item's partition."""
    k, least = _kept(len(hs), threshold)
    return hs[:k], least


@dataclass
class _Block:
    """Items indexed by their sketches."""

    width: int
    threshold: float
    ids: list[int] = field(default_factory=list)
    sets: list[set[bytes]] = field(default_factory=list)
    sketches: dict[int, list[tuple[int, int]]] = field(default_factory=dict)   # hash -> [(item, least size of its partition)]
    all_hashes: set[int] = field(default_factory=set)

    def add(self, item_id: int, ws: list[bytes]) -> None:
        hs = np.unique(_hashes(ws, self.width))
        some, least = _sketch(hs, self.threshold)
        for h in some.tolist():
            self.sketches.setdefault(h, []).append((len(self.ids), least))
        self.ids.append(item_id)
        self.sets.append(_strings(ws, range(_count(len(ws), self.width)), self.width))
        self.all_hashes.update(hs.tolist())

    def seal(self) -> _Block:
        self.keys = np.array(sorted(self.sketches), np.uint64)
        self.every = np.array(sorted(self.all_hashes), np.uint64)
        self.all_hashes = set()
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        return self

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, how many the text contains) at the threshold."""
        ws = words(text)
        hs = _hashes(ws, self.width)
        some = hs[self.maybe[hs >> np.uint64(64 - _FILTER_BITS)]] if len(self.keys) else hs[:0]
        hits = np.unique(some[np.isin(some, self.keys)])
        if not len(hits):
            return []
        found = {item for h in hits.tolist() for item, least in self.sketches[h] if len(hs) >= self.threshold * least}
        own = _strings(ws, np.flatnonzero(np.isin(hs, self.every)).tolist(), self.width)
        out = []
        for i in sorted(found):
            n = len(self.sets[i] & own)
            if n >= self.threshold * len(self.sets[i]) - 1e-9:
                out.append((i, len(self.sets[i]), n))
        return out


def _mapped(rows: DataFrame, each, schema: str) -> DataFrame:
    """rows(key, text) → the columns that ``each(key, words)`` gives for a row."""
    types = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                cols = each(key, words(t.as_py()))
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=names)

    return rows.mapInArrow(run, schema)


def _items(items: DataFrame, width: int, most: int, threshold: float) -> tuple[DataFrame, _Block | None]:
    """(item, i, t), numbered and written once, and their index if it is small."""
    held = save(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("i"),
                             F.col("text").alias("t")), "items")
    size = _mapped(held.select("item", "t"), lambda _, ws: ([_count(len(ws), width)],), "n long").agg(F.sum("n")).first()[0] or 0
    if size > most:
        return held, None
    block = _Block(width, threshold)
    for row in held.select("i", "t").toLocalIterator():
        if ws := words(row["t"]):
            block.add(row["i"], ws)
    return held, block.seal()


def _kept(sizes: int, threshold: float) -> tuple[int, int]:
    """How many hashes the sketch of an item of so many shingles holds, and the least
    size in its partition."""
    part = sizes.bit_length() - 1                           # sizes 2^part .. 2^(part+1) - 1
    return int((1 - threshold) * (2 ** (part + 1) - 1) + 1e-9) + 1, 2 ** part


def _sketches(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(h, item, least), written: of each item the hashes that fewest items have (ties:
    the least).  Any fixed order of the hashes loses no pair; this one keeps what
    many items share, a heading say, out of the sketches."""
    def hashed(item: int, ws: list[bytes]):
        hs = np.unique(_hashes(ws, width)).view(np.int64)
        k, least = _kept(len(hs), threshold) if len(hs) else (0, 0)
        return hs, np.full(len(hs), item), np.full(len(hs), k), np.full(len(hs), least)

    every = save(_mapped(texts, hashed, "h long, item long, k long, least long"), "item-hashes")
    often = every.groupBy("h").agg(F.count("*").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "h"))
    return save(every.join(often, "h").withColumn("rank", rank).where("rank <= k").select("h", "item", "least"), "sketches")


def _filter(sketches: DataFrame) -> np.ndarray:
    """A bit for the leading ``_SKETCH_BITS`` bits of every hash in a sketch: 16 MB at
    most, whatever the number of items."""
    top = F.shiftrightunsigned("h", 64 - _SKETCH_BITS)
    bits = sketches.select(F.shiftright(top, 6).alias("word"), top.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    got = bits.toPandas()
    out = np.zeros(1 << (_SKETCH_BITS - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _pairs(docs: DataFrame, held: DataFrame, width: int, threshold: float) -> DataFrame:
    """docs(row, text) and numbered items → (row, item, q, c): c of the item's q
    distinct shingles are in the document, at the threshold.  Of the documents'
    hashes only those that a sketch may hold are shuffled."""
    texts = held.select("item", "t")
    sketches = sized(_sketches(texts, width, threshold))
    maybe = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(sketches)))

    def hashed(row: int, ws: list[bytes]):
        hs = np.unique(_hashes(ws, width))
        n, top = len(hs), (hs >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)
        hs = hs[(maybe.value[top >> 3] >> (7 - (top & 7))) & 1 > 0].view(np.int64)
        return hs, np.full(len(hs), row), np.full(len(hs), n)

    def shingles(key: int, ws: list[bytes]):
        g = list(_strings(ws, range(_count(len(ws), width)), width))
        return g, [key] * len(g), [len(g)] * len(g)

    found = save(_mapped(docs, hashed, "h long, row long, size long").join(sketches, "h")
                 .where(F.col("size") >= F.col("least") * threshold - 1e-9).select("row", "item").distinct(), "candidates")
    own = _mapped(docs.join(found.select("row").distinct(), "row", "left_semi"), shingles, "g binary, row long, size long")
    wanted = found.join(_mapped(texts, shingles, "g binary, item long, q long"), "item")
    return (wanted.join(own.select("g", "row"), ["row", "g"]).groupBy("row", "item", "q").agg(F.count("*").alias("c"))
            .where(F.col("c") >= F.col("q") * threshold - 1e-9))


PAIRS = "doc_id long, item_id long, item_shingles int, contained int, containment double"


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
          block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, item_shingles, contained, containment): every pair of a
    document and an item of which at least ``threshold`` of the distinct shingles
    occur in the document.  Items without words match nothing; an item of fewer
    words than ``width`` is one shingle and matches a document of just these
    words; null texts count as empty, null ids are kept; repeated rows give
    repeated pairs; empty tables give no pair; further columns are ignored."""
    base = docs.select(F.col("doc_id").cast("long"), "text")
    items, block = _items(items, width, block_shingles, threshold)
    if block is None:
        rows = save(base.withColumn("row", F.monotonically_increasing_id()), "numbered")
        return (_pairs(rows.select("row", "text"), items, width, threshold).join(rows.select("row", "doc_id"), "row")
                .join(items.select("item", F.col("i").alias("item_id")), "item")
                .select("doc_id", "item_id", F.col("q").cast("int").alias("item_shingles"), F.col("c").cast("int").alias("contained"),
                        (F.col("c") / F.col("q")).alias("containment")))
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            rows = [(d, b.ids[i], q, n, n / q) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))
                    for i, q, n in b.find(t.as_py())]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))],
                names=["doc_id", "item_id", "item_shingles", "contained", "containment"])

    return base.mapInArrow(run, PAIRS)


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
                  block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs``, all columns, without the rows whose text contains an item (``leaks``).
    Null and empty texts contain none; rows that repeat go or stay together; columns
    of any name are kept; without items all documents stay; texts are read whole."""
    items, block = _items(items, width, block_shingles, threshold)
    if block is None:
        docs, named = set_aside(docs, "row")
        rows = save(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        gone = _pairs(rows.select("row", "text"), items, width, threshold).select("row").distinct()
        return named(rows.join(gone, "row", "left_anti").select(*docs.columns))
    held, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not held.value.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
