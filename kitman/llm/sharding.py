"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, salt), so equal texts lie
together.  The salt is a number of its own for each row, written once with the
rows: rows equal in text and id are drawn by their bytes and divided like any
other run of copies.  A size-weighted sample of these keys gives quantile
splitters of many small ranges; the ranges are measured exactly, overfull ones
are subdivided at quantiles of a denser sample of just them (a key of copies is
divided by doc_id, then by salt), and the shard boundaries are then placed by
exact running bytes inside the few ranges they fall into.  Only splitters and
counts of ranges, whose number follows ``rows_per_range``, pass through the
driver; only (hash, doc_id, salt, size) rows are shuffled to plan, never texts.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, set_aside

ROW_BYTES = 8
RANGES_PER_SHARD = 8
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 40
#: A run of copies up to this share of a shard is not cut by a shard boundary.
WHOLE_GROUP = 0.04
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KEY = ("__h", "__d", "__salt")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def keyed(docs: DataFrame, *own: str | Column) -> DataFrame:
    """``own`` columns of ``docs`` (default: all but shard and slot) with each row's
    key and size, written once: what is planned and what is dealt are the same rows."""
    own = own or [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return save(docs.select(*own, F.xxhash64("text").alias("__h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("__d"),
                            F.monotonically_increasing_id().alias("__salt"), size_of().alias("__size")), "keyed")


def _rank(bounds: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted bounds are at most each key, column by column."""
    out, right = np.searchsorted(bounds[0], keys[0], "left"), np.searchsorted(bounds[0], keys[0], "right")
    if len(bounds) == 1:
        return right
    tied = np.flatnonzero(right > out)                     # rows whose first column is itself a bound
    tied = tied[np.argsort(out[tied], kind="stable")]
    for at in np.split(tied, np.flatnonzero(np.diff(out[tied])) + 1) if len(tied) else []:
        lo, hi = out[at[0]], right[at[0]]
        out[at] += _rank([b[lo:hi] for b in bounds[1:]], [k[at] for k in keys[1:]])
    return out


@dataclass
class Splitters:
    """Sorted lower bounds of ranges 1, 2, ...; range 0 starts at the least key."""

    columns: list[np.ndarray]

    @classmethod
    def of(cls, keys) -> Splitters:
        keys = sorted({tuple(map(int, k)) for k in keys})
        return cls([np.array([k[i] for k in keys], np.int64) for i in range(len(_KEY))])

    def keys(self) -> list[tuple[int, int, int]]:
        return list(zip(*(c.tolist() for c in self.columns)))

    def find(self, *key: np.ndarray) -> np.ndarray:
        """How many lower bounds are at most each key: the range of each row."""
        return _rank(self.columns, list(key)).astype(np.int32)


def _ranged(keys: DataFrame, split: Splitters) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(split)

    @F.pandas_udf("int")
    def part(h: pd.Series, d: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(held.value.find(h.to_numpy(), d.to_numpy(), salt.to_numpy()))

    return keys.withColumn("__part", part(*_KEY))


def _sample(keys: DataFrame, chance: Column) -> list[tuple[int, int, int]]:
    """Keys drawn with the given chance by a hash of the key itself (the same on a retry)."""
    u = F.pmod(F.xxhash64(*_KEY, F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    return sorted(tuple(r) for r in keys.where(u < chance).select(*_KEY).collect())


def _quantiles(keys: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """n - 1 bounds that cut the sorted sample evenly; a bound lies at the first
    copy of its text unless the copies alone span several parts, and then at the
    first row of its id unless these rows do."""
    at = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    texts = {k[0] for k, m in zip(at, at[1:]) if k[0] == m[0]}
    ids = {k[:2] for k, m in zip(at, at[1:]) if k[:2] == m[:2]}
    return [k if k[:2] in ids else (*k[:2], _LEAST) if k[0] in texts else (k[0], _LEAST, _LEAST) for k in at]


def _measure(ranged: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range, in order; empty ranges are absent."""
    got = ranged.groupBy("__part").agg(F.sum("__size").alias("b"), F.count("*").alias("n")).collect()
    return {r["__part"]: (r["b"], r["n"]) for r in sorted(got, key=lambda r: r["__part"])}


@dataclass
class Plan:
    """Bounds of the final ranges, and the shard and first slot of each."""

    split: Splitters
    shard: list[int]
    first: list[int]


def _ranges(keys: DataFrame, n: int, total: int) -> Splitters:
    """About ``n`` ranges of equal bytes, none much over twice the mean unless one row is."""
    per_byte = SAMPLES_PER_RANGE * n / max(total, 1)
    split = Splitters.of(_quantiles(_sample(keys, F.least(F.lit(1.0), F.col("__size") * per_byte)), n))
    aim = total / n
    over = {p: int(b / aim) + 1 for p, (b, _) in _measure(_ranged(keys, split)).items() if b > 2 * aim}
    if over:
        dense = _ranged(keys, split).where(F.col("__part").isin(list(over)))
        more = _sample(dense, F.least(F.lit(1.0), F.col("__size") * (4 * per_byte)))
        part = split.find(*(np.array([k[i] for k in more], np.int64) for i in range(len(_KEY))))
        cuts = [k for p, m in over.items() for k in _quantiles([x for x, q in zip(more, part) if q == p], m)]
        split = Splitters.of([*split.keys(), *cuts])
    return split


def _boundaries(keys: DataFrame, split: Splitters, n_shards: int, total: int) -> list[tuple[int, int, int]]:
    """First key of each shard but the least: rows go to the shard that holds the
    middle of their bytes in the running total; so do whole runs of copies up to
    ``WHOLE_GROUP`` of a shard."""
    ranged = _ranged(keys, split)
    before, running = {}, 0
    for p, (b, _) in _measure(ranged).items():
        before[p] = running
        running += b
    goals = [total * s / n_shards for s in range(1, n_shards)]
    cut = sorted({max(p for p in before if before[p] <= g) for g in goals}) if before else []
    if not cut:
        return []
    start = F.element_at(F.create_map(*(F.lit(x) for p in cut for x in (p, float(before[p])))), F.col("__part"))
    order, copies = Window.partitionBy("__part").orderBy(*_KEY), Window.partitionBy("__part", "__h")
    rows = (ranged.where(F.col("__part").isin(cut)).select("__part", *_KEY, "__size")
            .withColumn("end", start + F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("from", F.col("end") - F.col("__size"))
            .withColumn("g0", F.min("from").over(copies)).withColumn("g1", F.max("end").over(copies)))
    whole = F.col("g1") - F.col("g0") <= WHOLE_GROUP * total / n_shards
    middle = F.when(whole, F.col("g0") + F.col("g1")).otherwise(F.col("from") + F.col("end")) / 2
    starts = [(tuple(r["k"]), r["s"]) for r in
              rows.withColumn("s", F.size(F.filter(F.lit(goals), lambda g: g < middle)))
              .groupBy("__part", "s").agg(F.min(F.struct(*_KEY)).alias("k")).collect()]
    lows = split.keys()
    starts += [(lows[p - 1], sum(g <= before[p] for g in goals)) for p in before if p and p not in cut]
    return [min(k for k, s in starts if s >= want) for want in range(1, max(s for _, s in starts) + 1)]


def _undivided(keys: DataFrame, bounds: list[tuple[int, int, int]], most: float) -> list[tuple[int, int, int]]:
    """``bounds`` moved out of runs of rows equal in text and id, to their nearer end
    by bytes, if all rows of the run have at most ``most`` bytes."""
    if not bounds:
        return []
    at = keys.sparkSession.createDataFrame(sorted(set(bounds)), "h long, d long, s long")
    met = keys.join(F.broadcast(at), (F.col("__h") == F.col("h")) & (F.col("__d") == F.col("d")))   # a row a shard
    size = {(r["h"], r["d"], r["s"]): (r["b"], r["all"]) for r in met.groupBy("h", "d", "s").agg(
        F.sum(F.when(F.col("__salt") < F.col("s"), F.col("__size")).otherwise(0)).alias("b"), F.sum("__size").alias("all")).collect()}
    out = []
    for k in bounds:
        b, every = size.get(k, (0, 0))
        out.append(k if every > most else (*k[:2], _LEAST if 2 * b <= every else _MOST))
    return sorted(out)


def plan(keys: DataFrame, n_shards: int, rows_per_range: int = ROWS_PER_RANGE) -> Plan:
    """Ranges of the ``keyed`` rows and the shards they make up."""
    keys = keys.select(*_KEY, "__size")
    rows, total, most = keys.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0)), F.coalesce(F.max("__size"), F.lit(0))).first()
    split = _ranges(keys, n_shards * max(RANGES_PER_SHARD, -(-rows // (n_shards * rows_per_range))), total)
    bounds = _undivided(keys, _boundaries(keys, split, n_shards, total), max(most, WHOLE_GROUP * total / n_shards))
    split = Splitters.of([*split.keys(), *bounds])
    held = _measure(_ranged(keys, split))
    shard = [0] + [bisect_right(bounds, k) for k in split.keys()]
    first, used = [], {}
    for p, s in enumerate(shard):
        first.append(used.get(s, 0))
        used[s] = first[-1] + held.get(p, (0, 0))[1]
    return Plan(split, shard, first)


def assign(keys: DataFrame, made: Plan) -> DataFrame:
    """The ``keyed`` rows' own columns with ``shard`` and ``slot`` (gapless from 0 in
    each shard, in key order)."""
    own = [c for c in keys.columns if c not in (*_KEY, "__size")]
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*_KEY))
    return _ranged(keys, made.split).select(
        *own, F.get(F.lit(made.shard), F.col("__part")).alias("shard"),
        (F.get(F.lit(made.first).cast("array<bigint>"), F.col("__part")) + rank - 1).alias("slot"))


def shard(docs: DataFrame, n_shards: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``docs`` dealt to ``n_shards`` shards of nearly equal bytes (UTF-8 bytes of
    the text plus 8): its columns, shard, slot (input columns of these names are
    replaced; others of any name are kept).  A shard is off the mean by at most a document or a run of copies of
    ``WHOLE_GROUP`` of a shard.  Null texts count 8 bytes, null ids come first; rows
    equal in text and id are interchangeable, and a shard boundary divides them only
    if they are more than that; an empty table gives an empty one."""
    docs, named = set_aside(docs, *_KEY, "__size", "__part")
    keys = keyed(docs)
    return named(assign(keys, plan(keys, n_shards, rows_per_range)))


def write(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files a shard."""
    sharded.write.partitionBy("shard").parquet(path)
