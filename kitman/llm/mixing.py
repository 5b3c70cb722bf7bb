"""Mixing sources to target weights by Poisson replication, in DataFrame functions.

Each source has a mean repetition rate: its share of the target over its share
of the corpus.  Each document draws its count by inverting the Poisson
distribution of its source at a uniform number hashed from (seed, doc_id), is
exploded that many times, and the copies are shuffled globally by a hashed key.
Counts depend on nothing but the id, the seed and the rate: retries and re-runs
draw the same, and no source is capped or cut.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, set_aside, sized

#: Largest rate drawn at once; larger ones are sums of independent draws.
RATE_PART = 500.0
#: Copies of one document up to which the task that reads it writes them.
MANY = 1_000
HEX_DIGITS = 13                     # 52 bits: exact in a double and in a long


def uniform52(*parts) -> Column:
    """A long of 52 bits hashed from the parts joined by ``:`` (null: empty)."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, rate, parts, cdf) for every source, null included.

    The mean output of a source is ``total`` bytes (default: as many as come in)
    times its weight over all weights; without ``weights`` all sources weigh the
    same, and sources that ``weights`` leaves out weigh 0.  A source without
    bytes keeps rate 1 if it weighs anything."""
    by = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")).alias("size"))
    if weights is None:
        by = by.withColumn("w", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()), "s string, w double")
        by = by.join(named, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = save(by, "sources")
    agg = whole.agg(F.sum("size").alias("all"), F.sum("w").alias("ws")).first()
    out = float(total if total is not None else agg["all"] or 0.0)
    ws = float(agg["ws"] or 1.0)
    rate = F.when(F.col("w") == 0, F.lit(0.0)).when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.lit(out) * (F.col("w") / F.lit(ws)) / F.col("size"))
    parts = F.greatest(F.ceil(F.col("rate") / RATE_PART), F.lit(1)).cast("int")
    lam = F.col("rate") / F.col("parts")
    # P(X <= 0), P(X <= 1), ... by the recurrence p(k) = p(k-1) * lam / k, until the tail is below a double's grain
    upto = F.ceil(lam + 12 * F.sqrt(lam) + 30).cast("int")
    cdf = F.aggregate(
        F.sequence(F.lit(1), upto),
        F.struct(F.exp(-lam).alias("p"), F.array(F.exp(-lam)).alias("c")),
        lambda a, k: F.struct((a["p"] * lam / k).alias("p"),
                              F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * lam / k)).alias("c")),
        lambda a: a["c"])
    return save(whole.select("source", rate.alias("rate")).withColumn("parts", parts)
                .withColumn("cdf", cdf), "rates")


def _drawn(cdf: Column, parts: Column, seed: int) -> Column:
    """A document's count: for each part its uniform number, hashed once, is looked for in ``cdf``."""
    uniform = F.transform(F.sequence(F.lit(1), parts), lambda j: uniform52(F.lit(seed), F.col("doc_id"), j) / F.lit(float(1 << 4 * HEX_DIGITS)))
    return F.aggregate(F.transform(uniform, lambda u: F.size(F.filter(cdf, lambda c: c <= u))), F.lit(0), lambda a, x: a + x)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None,
                seed: int = 7) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled: its columns, then
    copy_no (1..n_copies), n_copies and shuffle_key (input columns of these names
    are replaced).  Null sources are a source; null or empty texts are drawn like
    any other; rows that repeat a doc_id draw the same count; an empty table
    gives an empty one; columns of any other name are kept.

    A document of which very many copies may be drawn is first dealt out in about as
    many pieces as each piece then has copies, so that no task writes them all."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("copy_no", "n_copies", "shuffle_key")))
    docs, named = set_aside(docs, "mix_source", "mix_parts", "mix_cdf", "mix_piece")
    own = docs.columns
    by = rates(docs, weights, total).select(
        F.col("source").alias("mix_source"), F.col("parts").alias("mix_parts"), F.col("cdf").alias("mix_cdf"))
    # the greatest count that a source's documents can draw
    many = F.col("mix_parts") * F.size("mix_cdf") > MANY

    def drawn(sources: DataFrame) -> DataFrame:
        return (docs.join(sized(sources), F.col("source").eqNullSafe(F.col("mix_source")))
                .select(*own, _drawn(F.col("mix_cdf"), F.col("mix_parts"), seed).alias("n_copies")).where("n_copies > 0"))

    copies = drawn(by.where(~many)).select(*own, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), "n_copies")
    if not by.where(many).isEmpty():
        step = F.ceil(F.sqrt(F.col("n_copies").cast("double"))).cast("int")
        pieces = (drawn(by.where(many)).select(*own, "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1, step)).alias("mix_piece"))
                  .repartition("doc_id", "mix_piece"))
        copies = copies.unionByName(pieces.select(*own, F.explode(F.sequence(
            F.col("mix_piece") + 1, F.least(F.col("mix_piece") + step, F.col("n_copies")))).alias("copy_no"), "n_copies"))
    keyed = copies.withColumn("shuffle_key", uniform52(F.lit("shuffle"), F.lit(seed), F.col("doc_id"), F.col("copy_no")))
    return named(keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", "doc_id"))
