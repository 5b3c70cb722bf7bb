"""SimHash near-dedup by covering locality-sensitive hashing.

Bit ``i`` of a fingerprint gets a non-zero code ``m(i)`` of ``radius + 1`` bits.
Table ``t`` (1 .. 2^(radius+1) - 1) keys a fingerprint by the bits with an odd
``popcount(m(i) & t)`` and masks out the rest.  At most ``radius`` differing bits
give at most ``radius`` linear conditions on ``t``, so some non-zero ``t`` masks
them all: every pair within the radius meets in some table, none is missed.

Members of a shared bucket are verified without forming pairs: within distance
2 two fingerprints have a common neighbour at distance at most 1 from both, and
whatever shares such a neighbour is within distance 2.  A fingerprint therefore
sends itself and its one-bit flips of the masked bits to the neighbour's key;
a neighbour is met by at most 65 fingerprints, which bounds every group.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, save, set_aside, sized
from .components import components

BITS, BLOCK = 64, 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles: A-Z lower-cased, words split at
    ASCII white space, XXH64 per shingle; a bit is 1 if set in over half of them.
    Fewer words than ``width``: one shingle of all; none (or null): 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:min(at + BLOCK, n) + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(seed))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit long, one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Key masks of the covering tables, as signed 64-bit values."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    out = []
    for t in range(1, 2 ** (radius + 1)):
        m = sum(1 << i for i, c in enumerate(codes) if (c & t).bit_count() % 2)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps(fp) distinct → edges (u, v) that connect exactly the fingerprints that
    are linked by steps of at most ``radius`` (1 or 2) differing bits."""
    if radius not in (1, 2):
        raise ValueError("the shared-neighbour check covers a radius of 1 or 2")
    keyed = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"), F.lit(~m).alias("free"))
        for t, m in enumerate(masks(radius))))).alias("k")).select("fp", "k.*")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    cand = save(keyed.join(sized(save(shared, "buckets")), ["t", "key"]).groupBy("fp")
                .agg(F.bit_or("free").alias("free")), "candidates")
    flips = [b - (1 << BITS) if b >> (BITS - 1) else b for b in (1 << i for i in range(BITS))]
    near = F.filter(F.transform(F.lit(flips), lambda b: F.when(F.col("free").bitwiseAND(b) != 0, F.col("fp").bitwiseXOR(b))),
                    lambda x: x.isNotNull())
    if radius == 1:          # one differing bit: a flip equals the other member itself
        hubs = cand.select("fp", F.explode(near).alias("hub")).join(
            cand.select(F.col("fp").alias("hub")), "hub")
        return hubs.select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    met = (cand.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("hub"))
           .groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    return met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u != v").select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Equal fingerprints are one node, so a text copied into a third of all rows is
    one node too.  Null or empty texts have fingerprint 0 and link like any other;
    a null ``doc_id`` never names a component (null only where no id is in it);
    repeated rows give repeated rows; an empty table gives an empty one; further
    columns are ignored."""
    rows = save(fingerprints(docs, width), "simhash")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    classed = nodes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = save(classed.join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(sized(named), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their
    component.  A document is its ``doc_id``: rows that repeat an id stay or go
    together; rows without an id stay; null and empty texts are copies of each other;
    columns of any name are kept; an empty table gives an empty one."""
    docs, named = set_aside(docs, "__gone")
    gone = save(near_duplicates(docs, width, radius).where("doc_id != component_id")
                .select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return named(docs.join(sized(gone, BROADCAST_ROWS), F.col("doc_id") == F.col("__gone"), "left_anti"))
