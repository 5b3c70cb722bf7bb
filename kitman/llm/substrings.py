"""Substring dedup by recompression.

Rounds rename the word sequence: maximal runs of a symbol become one symbol
(named by symbol and length), and neighbours whose names fall left and right in
a round's split of all names become one symbol (named by the pair).  Names are
hashes of what they stand for, so they are global: equal substrings get the same
symbols wherever they stand, except at their ends, where the context decides.

What a window keeps in every context is its core: a round takes the first
symbol off if it could join one before it, and the last if it could join one
after it.  The anchor of a window is the symbol of least name in its core, in the
last round that leaves it ``CORE`` symbols.  It depends on the window's words alone, so equal
windows have equal anchors, and no repeat is missed.

Occurrences of an anchor carry a digest of all the windows anchored there.
Equal digests verify the whole stretch at once; occurrences whose anchor occurs
with several digests (the ends of repeats) are compared window by window.  Both
tables are grouped with map-side minimum; nothing gathers a group.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, mix, save, sized, word_hashes

WINDOW, ROUNDS, RUN_ROUNDS, CORE = 50, 14, (0, 4), 1
#: Words parsed at once; longer texts and batches are cut with an overlap that keeps every window whole.
SEGMENT = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _spans(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash of the words start .. stop - 1, for each pair."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_BASE, len(h))[:-1], dtype=np.uint64)])
        return mix((sums[stop] - sums[start]) * _powers(_INVERSE, len(h))[start], (stop - start).astype(np.uint64))


def _least(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position of the least name among lo .. hi, the first of equals."""
    pos, best = lo.copy(), name[lo]
    for j in range(1, int((hi - lo).max(initial=0)) + 1):
        k = np.minimum(lo + j, hi)
        less = name[k] < best
        pos, best = np.where(less, k, pos), np.where(less, name[k], best)
    return pos


def anchors(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one document: its first word, the name of its
    anchor and the anchor's first word.  ``doc`` is the document of each word."""
    n = len(h)
    p = np.flatnonzero(doc[:max(n - window + 1, 0)] == doc[window - 1:]) if n >= window else np.zeros(0, np.int64)
    name, at = mix(h, 1), np.arange(n)
    lo, hi, left = p.copy(), p + window - 1, np.arange(len(p))
    best, where = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)

    def settle(which: np.ndarray) -> None:
        pos = _least(name, lo[which], hi[which])
        best[left[which]], where[left[which]] = name[pos], at[pos]

    for r in range(ROUNDS):
        if r in RUN_ROUNDS:
            head = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[at[1:]] != doc[at[:-1]])])
            to, first = np.cumsum(head) - 1, np.flatnonzero(head)
            length = np.diff(np.append(first, len(name))).astype(np.uint64)
            name2, at2 = np.where(length > 1, mix(mix(name[first], length), 2 * r + 2), name[first]), at[first]
            lo2, hi2 = to[lo] + 1, to[hi] - 1               # either end may go on outside
        else:
            right = (mix(name, 2 * r + 3) & np.uint64(1)).astype(bool)
            joins = ~right[:-1] & right[1:] & (doc[at[:-1]] == doc[at[1:]])
            kept = np.concatenate([[True], ~joins])
            to = np.cumsum(kept) - 1
            pair = mix(mix(name, np.append(name[1:], np.uint64(0))), 2 * r + 3)
            name2, at2 = np.where(np.append(joins, False), pair, name)[kept], at[kept]
            lo2, hi2 = lo + right[lo], hi - ~right[hi]      # a right half may join one before, a left half one after
            some = lo2 <= hi2
            lo2, hi2 = np.where(some, to[np.minimum(lo2, hi)], 1), np.where(some, to[hi2], 0)
        few = hi2 - lo2 + 1 < CORE
        settle(few)
        name, at, lo, hi, left = name2, at2, lo2[~few], hi2[~few], left[~few]
        if not len(left):
            break
    settle(np.ones(len(left), bool))
    return p, best, where


def _segments(ids: list, texts: list, window: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, word hashes, document number, position in the document) of about
    SEGMENT words each; a longer text goes on in the next one, overlapping."""
    held, docs, n = [], [], 0

    def flush():
        size = [len(x) for _, x in held]
        return (list(docs), np.concatenate([x for _, x in held]), np.repeat(np.arange(len(held)), size),
                np.concatenate([np.arange(a, a + s) for (a, _), s in zip(held, size)]))

    for i, t in zip(ids, texts):
        ws = words(t)
        if len(ws) < window:
            continue
        for a in range(0, len(ws) - window + 1, SEGMENT):
            part = word_hashes(ws[a:a + SEGMENT + window - 1])
            held.append((a, part))
            docs.append(i)
            n += len(part)
            if n >= SEGMENT:
                yield flush()
                held, docs, n = [], [], 0
    if held:
        yield flush()


_KEY = "doc_id long, version long"          # version: a hash of the text, so that rows that reuse an id stay apart


def _occurrences(window: int):
    """Rows (name, digest, key, a, b): windows a .. b of a document have this anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for ids, h, doc, pos in _segments(keys, (t.as_py() for t in batch.column(2)), window):
                p, name, where = anchors(h, doc, window)
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 0) | (np.diff(name) != 0) | (np.diff(p) != 1)]))
                a, b = p[cut], p[np.append(cut[1:], len(p)) - 1]
                digest = mix(_spans(h, a, b + window), (where[cut] - a).astype(np.uint64))
                own = [ids[d] for d in doc[a].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[cut].view(np.int64)), pa.array(digest.view(np.int64)),
                     pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()),
                     pa.array(pos[a].astype(np.int32)), pa.array(pos[b].astype(np.int32))],
                    names=["name", "digest", "doc_id", "version", "a", "b"])
    return run


def _windows(window: int):
    """Rows (name, digest, key, a) of the single windows asked for in ``asked``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v, t, asked in zip(*(batch.column(k) for k in range(4))):
                h = word_hashes(words(t.as_py()))
                rows = asked.as_py()
                size = [x["b"] - x["a"] + 1 for x in rows]
                p = np.concatenate([np.arange(x["a"], x["b"] + 1) for x in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([x["name"] for x in rows], np.int64), size)),
                     pa.array(_spans(h, p, p + window).view(np.int64)), pa.array(np.full(len(p), i.as_py(), np.int64)),
                     pa.array(np.full(len(p), v.as_py(), np.int64)), pa.array(p.astype(np.int32))],
                    names=["name", "digest", "doc_id", "version", "a"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted union of each document's ranges, flat: a1, b1, a2, b2, ..."""
    for batch in batches:
        out = []
        for ranges in batch.column(2):
            got: list[int] = []
            for x in sorted((r["a"], r["b"]) for r in ranges.as_py()):
                if got and x[0] <= got[-1]:
                    got[-1] = max(got[-1], x[1])
                else:
                    got += x
            out.append(got)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))],
                                         names=["doc_id", "version", "ranges"])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, version, ranges): the words of each document that lie in windows
    which also start in a document with a smaller id, as merged ranges a1, b1, ...
    (b excluded).  Documents without any are absent."""
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").where("doc_id is not null")
    seen = save(base.mapInArrow(_occurrences(window), f"name long, digest long, {_KEY}, a int, b int"), "anchors")
    names = (seen.groupBy("name").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1"),
                                      F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("least < most").select("name", "least", (F.col("d0") != F.col("d1")).alias("open")))
    mine = save(seen.join(save(names, "names"), "name"), "shared")
    one = mine.where("not open and doc_id > least").select("doc_id", "version", "a", (F.col("b") + window).alias("b"))
    # anchors with several stretches: the least document of each stretch, the rest is verified by it
    many = mine.where("open").drop("least")
    least = save(many.groupBy("name", "digest").agg(F.min("doc_id").alias("least")), "least")
    many = save(many.join(least, ["name", "digest"]), "stretches")
    whole = many.where("doc_id > least").select("doc_id", "version", "a", (F.col("b") + window).alias("b"))
    asked = save(many.where("doc_id = least").groupBy("doc_id", "version")     # bounded by the document's own windows
                 .agg(F.collect_list(F.struct("name", "a", "b")).alias("asked")), "asked")
    some = base.join(sized(save(asked.select("doc_id").distinct(), "asked-ids")), "doc_id")   # texts of these documents only
    single = save(some.join(asked, ["doc_id", "version"]).select("doc_id", "version", "text", "asked")
                  .mapInArrow(_windows(window), f"name long, digest long, {_KEY}, a int"), "windows")
    first = (single.groupBy("name", "digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("most > least").select("name", "digest", "least"))
    edge = (single.join(save(first, "first"), ["name", "digest"]).where("doc_id > least")
            .select("doc_id", "version", "a", (F.col("a") + window).alias("b")))
    found = one.unionAll(whole).unionAll(edge)
    return save(found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
                .mapInArrow(_merge, f"{_KEY}, ranges array<int>"), "ranges")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept = [], [], []
        for t, ranges in zip(batch.column(1), batch.column(2)):
            ws, last, out = words(t.as_py()), 0, []
            for a, b in zip(*(iter(ranges.as_py() or ()),) * 2):
                out += ws[last:a]
                last = b
            out += ws[last:]
            n.append(len(ws))
            gone.append(len(ws) - len(out))
            kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: the words (split at ASCII
    white space) that no window of ``window`` words repeated from a smaller id
    covers, joined by one space.

    Windows are judged on the input.  Null or empty texts have no words; texts
    shorter than a window and rows without an id lose nothing (and are no source);
    rows that repeat an id are one document: they do not remove each other.  An
    empty table gives an empty one; further columns are ignored."""
    found = repeats(docs, window)
    total = found.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
    if total <= 2 * BROADCAST_ROWS:                        # counted: so many numbers at most are sent
        found = F.broadcast(found)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    return (rows.join(found, ["doc_id", "version"], "left").select("doc_id", "text", "ranges")
            .mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string"))
