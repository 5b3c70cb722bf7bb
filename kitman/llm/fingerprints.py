"""Document fingerprints by one-permutation MinHash, in DataFrame functions.

Every shingle is hashed once; the top bits name its bin and a bin keeps its
least hash.  An empty bin borrows from the first non-empty bin of its own hashed
probe sequence (optimal densification), so equal occupancy borrows alike.  The
low ``BITS`` bits of each bin are packed as hex, and the share of equal bins is
corrected for values that agree by chance, 2^-BITS.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, stretch_of, stretches

WIDTH, BIN_BITS, BITS, PROBES = 5, 7, 8, 12
BINS = 1 << BIN_BITS
#: Rows of a stretch of neighbouring ids.
STRETCH_ROWS = 2000


def _with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: array of the low bits per bin (null for a text without words).

    Each step is its own projection: a column that a lambda reads several times
    is then computed once a row, not once an element."""
    s = "__s"
    words = F.filter(F.split(F.lower(F.col(text)), "[ \\t-\\r]+"), lambda w: w != "")
    df = df.withColumn(s, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(s)
    gram = lambda x, i: F.xxhash64(x, *(F.get(F.col(s), i + j) for j in range(1, WIDTH)))
    whole = F.xxhash64(F.col(s))
    shingles = (F.when(n >= WIDTH, F.transform(F.slice(s, 1, F.greatest(n - WIDTH + 1, F.lit(0))), gram))
                .when(n > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__h", F.sort_array(shingles))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")
    # sorted hashes hold each bin's values together: its least comes first
    df = df.withColumn("__m", F.filter("__h", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("__h"), i - 1)))))
    df = df.withColumn("__b", F.transform("__m", bin_of))
    df = df.withColumn("__v", F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda j: F.get(F.col("__m"), F.array_position("__b", j).cast("int") - 1).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
    probe = lambda j, a: F.pmod(F.xxhash64(j, F.lit(a)), F.lit(BINS)).cast("int")
    walk = lambda j: F.get(F.filter(F.transform(                                    # noqa: E731
        F.sequence(F.lit(0), F.lit(BINS - 1)),   # an odd stride visits every bin
        lambda a: F.get(F.col("__v"), F.pmod(probe(j, PROBES + 1) + a * (probe(j, PROBES + 2).bitwiseOR(F.lit(1))), F.lit(BINS)))),
        lambda x: x.isNotNull()), 0)
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.coalesce(
        F.get(F.col("__v"), j), *(F.get(F.col("__v"), probe(j, a)) for a in range(1, PROBES + 1)), walk(j)))
    return df.withColumn(out, F.when(F.size("__m") > 0, dense)).drop(s, "__h", "__m", "__b", "__v")


def packed(bins: Column) -> Column:
    """Hex of the packed bins; a text without words is all zeros."""
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), ""),
                      F.lit("0" * (BINS * BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles: the share of equal
    bins without the share equal by chance; 1 for two texts without words."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return (F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance))))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row; null texts count as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    return _with_bins(rows, "__t", "__f").select("doc_id", packed(F.col("__f")).alias("fingerprint"))


def edited(docs: DataFrame, rows_each: int = STRETCH_ROWS) -> DataFrame:
    """(doc_id, text, bins, next_bins, edited_text): beside each text its edit, the
    last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document by ascending doc_id, the first following the last.

    Ids are cut into stretches; the first document of each also ends the stretch
    before it, so neighbours meet in one window per stretch and the text is
    shuffled once.  Null texts are empty, null ids come first, rows that repeat an
    id are ordered by text; a single document follows itself."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    key = id_key()
    part = stretch_of(key, stretches(rows, rows_each))
    heads = {r["p"]: r["d"] for r in rows.select(part.alias("p"), key.alias("d")).groupBy("p").agg(F.min("d").alias("d")).collect()}
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}     # head id -> the stretch it follows
    own = F.struct(part.alias("p"), F.lit(0).alias("guest"))
    if before:
        guest = F.element_at(F.create_map(*(F.lit(x).cast(t) for d, p in before.items() for x, t in ((d, "long"), (p, "int")))), key)
        is_head = key.isin(list(before))
        places = F.when(is_head, F.array(own, F.struct(guest.alias("p"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    else:
        places = F.array(own)
    marked = _with_bins(rows, "text", "bins").select("doc_id", "text", "bins", F.explode(places).alias("w")).select("doc_id", "text", "bins", "w.*")
    w = Window.partitionBy("p").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    paired = (marked.withColumn("next_text", F.lead("text").over(w)).withColumn("next_bins", F.lead("bins").over(w))
              .where("guest = 0").drop("p", "guest"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    return paired.withColumn("edited_text", F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))).drop("next_text")


def compare(docs: DataFrame, rows_each: int = STRETCH_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness."""
    both = _with_bins(edited(docs, rows_each), "edited_text", "edited_bins")
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
