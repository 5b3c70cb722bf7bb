"""Small helpers shared by the operators: reading tables, tables in the shared
folder, size-checked joins, word hashing."""
from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kitman.session import ensure_checkpoint_dir

#: Rows of (id) or (key, value) up to which a join side is broadcast; counted
#: before, and beyond it the join is left to Spark (sort-merge, AQE skew split).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kitman-{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it
    again, so a lost executor never costs more than the stage that runs."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted),
    else as it is.  Hand in a saved table: the count reads only footers."""
    return F.broadcast(df) if df.count() <= rows else df


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit hash of two 64-bit values (multiply, xor-shift), per element."""
    with np.errstate(over="ignore"):
        x = (a ^ (np.uint64(b) if np.isscalar(b) else b) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def fold(doc_id: str, mod: int):
    """crc32 of the id's decimal text modulo ``mod`` (fixed train/held-out folds)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


#: Bound of the number of stretches that ids are cut into (their bounds are sent to the tasks).
MOST_STRETCHES = 20_000
LEAST_ID = -(1 << 63)               # stands for a null id: first in order


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LEAST_ID))


def stretches(docs: DataFrame, rows_each: int) -> list[int]:
    """Lower bounds that cut the ids into stretches of about equal rows."""
    ids = docs.select(id_key().alias("d"))
    parts = min(MOST_STRETCHES, -(-ids.count() // rows_each))
    if parts < 2:
        return []
    at = ids.agg(F.percentile_approx("d", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(at or []))


def stretch_of(key: Column, lows: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``, by binary search."""
    if not lows:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(lows).bit_length()))]
    bounds = F.lit(lows).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda a, st: F.when(F.get(bounds, a + st - 1) <= key, a + st).otherwise(a))


def dealt(held: DataFrame, visits: DataFrame, key: str, salt: str, most: int) -> tuple[DataFrame, DataFrame]:
    """``held`` and ``visits`` (written) to be grouped by (key, part): the visits of a key are
    dealt by a hash of ``salt`` to parts of about ``most`` rows, and each part gets
    all held rows of its key."""
    parts = sized(save(visits.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "parts"))
    copies = held.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return copies, visits.join(parts, key).withColumn("part", F.pmod(F.xxhash64(salt), F.col("parts")).cast("int")).drop("parts")


def set_aside(df: DataFrame, *names: str):
    """``df`` with other names for its columns that are called like ``names``, and a
    function that gives them back their own."""
    taken = {c.lower() for c in (*df.columns, *names)}
    other = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"own_{len(other)}"
            while new in taken:
                new += "_"
            taken.add(new)
            other[c] = new
    back = {new: c for c, new in other.items()}
    return (df.withColumnsRenamed(other), lambda out: out.withColumnsRenamed(back)) if other else (df, lambda out: out)
