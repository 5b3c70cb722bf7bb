"""In-row array helpers built only from Spark higher-order functions.

Everything here stays on the JVM and runs inside the row, so per-document
work never needs a shuffle.  The helpers are written to be near-linear in the
array length: a running total is a log-step (Hillis–Steele) scan, never an
``aggregate`` that appends to a growing array (which would copy O(n²)).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_rounds(n: Column) -> Column:
    """[0, 1, …, ceil(log2 n) - 1] as array<int>; empty when n <= 1."""
    k = F.ceil(F.log2(n.cast("double"))).cast("int")
    return F.when(n > 1, F.sequence(F.lit(0), k - 1)).otherwise(
        F.array().cast("array<int>"))


#: Length up to which a running total is taken element by element.
SHORT = 16


def inclusive_scan(arr: Column, op: str = "sum") -> Column:
    """Running sum / max of an array of ints or longs, O(n log n) per row; a short
    array is summed up anew for each element, which takes fewer steps."""
    def combine(a: Column, b: Column) -> Column:
        return a + b if op == "sum" else F.greatest(a, b)

    def one_round(acc: Column, r: Column) -> Column:
        d = F.pow(F.lit(2), r).cast("int")
        return F.transform(
            acc, lambda x, i: F.when(i >= d, combine(x, acc[i - d])).otherwise(x))

    def each(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.aggregate(F.slice(a, 1, i), x, combine))

    return let(arr, lambda a: F.when(F.size(a) <= SHORT, each(a)).otherwise(
        F.aggregate(search_rounds(F.size(a)), a, one_round)))


def exclusive_scan_sum(arr: Column) -> Column:
    return let(arr, lambda a: F.transform(
        inclusive_scan(a, "sum"), lambda x, i: x - a[i]))


def empty_like(arr: Column) -> Column:
    """Typed empty array with the element type of ``arr``."""
    return F.filter(arr, lambda x: F.lit(False))


def index_range(n: Column) -> Column:
    """[0 .. n-1] as array<int>; empty for n <= 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>"))


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a lambda variable.

    Catalyst's CollapseProject inlines a projected column that is referenced
    once, even when that single reference sits inside a lambda and is thus
    evaluated per element.  Binding through a one-element ``transform`` keeps
    it a single evaluation.
    """
    return F.transform(F.array(expr), body)[0]


def sorted_lookup(table: Column, key: Column) -> Column:
    """Value for ``key`` in an array<struct<k, v>> sorted by ``k`` (null when
    absent), by binary search: O(log n) per lookup.  Spark's map lookup scans
    every key, which makes per-element lookups into a big map quadratic."""
    def search(B: Column) -> Column:
        T, key = B["t"], B["k"]
        n = F.size(T)

        def step(acc: Column, _r: Column) -> Column:
            lo, hi = acc["lo"], acc["hi"]
            mid = F.floor((lo + hi) / 2).cast("int")
            go_right = F.when(lo < hi, T[mid]["k"] < key).otherwise(F.lit(False))
            return F.when(lo >= hi, acc).otherwise(F.struct(
                F.when(go_right, mid + 1).otherwise(lo).alias("lo"),
                F.when(go_right, hi).otherwise(mid).alias("hi")))

        found = F.aggregate(search_rounds(n + 1), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step,
                            lambda acc: acc["lo"])
        return F.when(found < n, F.when(T[found]["k"] == key, T[found]["v"]))

    return let(F.struct(table.alias("t"), key.alias("k")), search)


def exploded(df: DataFrame, array: Column | str, *keep: str, item: str = "s", position: str = "n") -> DataFrame:
    """``keep``, ``position`` and ``item``: a row per element of ``array``.

    The plain ``explode`` lets Spark infer a filter on the array's size and push it
    below the projection that computes the array: a computed array (a detection) is
    then evaluated twice, the first time before the rows are spread.  The outer form
    has no such filter; its rows for empty arrays have no position and go here."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, item)).filter(F.col(position).isNotNull())
