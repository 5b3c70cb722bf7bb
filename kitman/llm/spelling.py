"""Spelling variant grouping with a frequency-vector trie.

A word's vector counts its letters in each of ``LEVELS`` letter groups.  Words
sorted by vector are a trie: level after level, a node is the range of rows
that share the counts so far.  Two words within one inserted, deleted or
replaced letter have vectors that differ by at most one surplus and one deficit,
so a depth-first search that may spend one of each meets every near word; the
words of the leaves it ends in are verified letter by letter.

The trie is cut into blocks of ``BLOCK_WORDS`` consecutive rows, inside a leaf
too.  The first vectors of the blocks are a trie as well: the same search in it
tells which blocks a word must visit.  Blocks with many visitors are given to
several tasks, so neither a crowded leaf nor a crowded block is one task's work.
What passes through the driver is one vector a block.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, save

#: Least code points and occurrences of a word; how much more frequent a form is.
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: One run in so many is damaged (0: none).
DAMAGE = 199
LEVELS = 16
BLOCK_WORDS, BLOCK_VISITS = 50_000, 50_000
#: States that a step of the search holds; more are searched in halves, one after the other.
STATES = 1 << 18
#: Distinct words after which a task hands on its counts.
HELD_WORDS = 1_000_000


def damaged(run: bytes, doc: int, every: int) -> bytes:
    """A lower-cased UTF-8 run, less one code point where its hash says so.
    ``doc``: crc32 of the UTF-8 text ``<doc_id>:``."""
    h = zlib.crc32(run, doc)
    if h % every:
        return run
    s = run.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1:]).encode()


def counted(docs: DataFrame, letters: int = MIN_LETTERS, times: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): words of at least ``letters`` code points that occur ``times``
    times in the texts.  Shorter runs never become such a word.  A null id is
    written as nothing, a null text holds no word."""
    pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{letters},}}")

    def batch_of(held: Counter) -> pa.RecordBatch:
        words = [w.decode() for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                runs = "\n".join(pattern.findall(t.as_py() or "")).encode().lower().split(b"\n")
                if runs == [b""]:
                    continue
                if damage:
                    doc = zlib.crc32(f"{'' if d is None else d}:".encode())
                    for w, n in Counter(runs).items():
                        held[damaged(w, doc, damage)] += n
                else:
                    held.update(runs)
                if len(held) > HELD_WORDS:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= times) & (F.char_length("word") >= letters)))


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter-group counts, a row a word (Latin-1): a letter's group is its code
    point modulo ``LEVELS``."""
    which = np.repeat(np.arange(len(words)), [len(w) for w in words])
    group = np.frombuffer(b"".join(words), np.uint8) % LEVELS
    return np.bincount(which * LEVELS + group, minlength=len(words) * LEVELS).reshape(-1, LEVELS)


class Trie:
    """Sorted vectors; a node at level l is a range of rows equal in l counts."""

    def __init__(self, rows: np.ndarray):
        self.n, self.most = len(rows), int(rows.max(initial=0)) + 1
        self.prefix, self.keys = [], []
        at = np.zeros(self.n, np.int64)                     # which prefix, numbered in order
        for level in range(LEVELS):
            key = at * (self.most + 2) + rows[:, level] + 1
            self.prefix.append(at)
            self.keys.append(key)
            at = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if self.n else at

    def search(self, wanted: np.ndarray, between: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, from, to): rows from..to-1 whose vector differs from the query's
        by at most one surplus and one deficit.  ``between``: also where such a
        vector would stand if no row has its counts (from = to)."""
        every = np.arange(len(wanted))
        whole = np.full(len(wanted), self.n)
        budget = np.ones(len(wanted), bool)
        stack = [(0, every, np.zeros_like(whole), whole, budget, budget)] if self.n else []
        if between and not self.n:
            yield every, whole, whole
        while stack:
            level, q, low, high, surplus, deficit = stack.pop()
            if not len(q):
                continue
            if len(q) > STATES:
                half = len(q) // 2
                for part in (slice(0, half), slice(half, None)):
                    stack.append((level, *(x[part] for x in (q, low, high, surplus, deficit))))
                continue
            if level == LEVELS:
                yield q, low, high
                continue
            at, count = self.prefix[level][low] * (self.most + 2) + 1, wanted[q, level]
            for step, may in ((1, surplus), (-1, deficit & (count > 0)), (0, None)):
                some = slice(None) if may is None else np.flatnonzero(may)
                key = at[some] + np.minimum(count[some] + step, self.most)
                a = np.searchsorted(self.keys[level], key, "left")
                b = np.searchsorted(self.keys[level], key, "right")
                full = a < b
                if between and not full.all():
                    yield q[some][~full], a[~full], a[~full]
                stack.append((level + 1, q[some][full], a[full], b[full], surplus[some][full] & (step != 1), deficit[some][full] & (step != -1)))


def near(a: bytes, b: bytes) -> bool:
    """Do two Latin-1 words differ by just one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b[:len(a)], "big")
    p = len(a) - (differ.bit_length() + 7) // 8             # common first letters
    if len(a) == len(b):
        return p < len(a) and a[p + 1:] == b[p + 1:]
    return len(b) == len(a) + 1 and a[p:] == b[p + 1:]


def ends(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last ``size`` (up to 8) letters of each word, as numbers."""
    return tuple(np.frombuffer(b"".join(x.ljust(8, b"\0") for x in part), np.uint64)
                 for part in ((w[:size] for w in words), (w[len(w) - size:] for w in words)))


def near_pairs(asked: list[bytes], words: list[bytes], trie: Trie) -> Iterator[tuple[int, int]]:
    """(i, j) for every word j of the trie near the asked word i.  One edit leaves the
    first or the last half of the shorter word as it is, so pairs of a leaf that
    share neither are passed over before they are read letter by letter."""
    if not asked or not words:
        return
    half = min(8, min(map(len, asked)) // 2, min(map(len, words)) // 2)
    (first, last), (head, tail) = ends(asked, half), ends(words, half)
    for q, low, high in trie.search(vectors(asked)):
        size = np.cumsum(high - low)
        for at in np.split(np.arange(len(q)), np.flatnonzero(np.diff(size // STATES)) + 1):
            i, j = _spread(q[at], low[at], high[at])
            some = np.flatnonzero((first[i] == head[j]) | (last[i] == tail[j]))
            for i, j in zip(i[some].tolist(), j[some].tolist()):
                if near(asked[i], words[j]):
                    yield i, j


def _latin(words) -> list[bytes]:
    return [w.encode("latin-1") for w in words]


def indexed(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """words(word, n) → (word, n, block), written: blocks of at most ``block_words``
    rows in the order of vector and word."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(_latin(b.column(0).to_pylist())).astype(">u4")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in v], pa.binary())], names=["word", "n", "key"])

    rows = save(words.mapInArrow(keyed, "word string, n long, key binary"), "words")
    in_order = rows.repartitionByRange(max(1, -(-rows.count() // block_words)), "key", "word").sortWithinPartitions("key", "word")
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))      # its low bits: the row in its partition
    return save(in_order.select("word", "n", F.monotonically_increasing_id().alias("at"))
                .withColumn("block", F.col("at") - row % block_words), "trie")


def _routes(index: DataFrame) -> DataFrame:
    """(block, word): every word once for each block that its search must visit."""
    firsts = sorted(tuple(r) for r in index.groupBy("block").agg(F.min_by("word", "at")).collect())
    blocks = np.array([b for b, _ in firsts], np.int64)
    held = index.sparkSession.sparkContext.broadcast((blocks, vectors(_latin(w for _, w in firsts[1:]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, bounds = held.value
        directory = Trie(bounds)
        for b in batches:
            met = []
            for q, low, high in directory.search(vectors(_latin(b.column(0).to_pylist())), between=True):
                # what lies among bounds low..high-1 may be in the blocks low..high
                query, block = _spread(q, low, high + 1)
                met.append(np.unique(query * len(blocks) + block))
            met = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[met % len(blocks)]), b.column(0).take(pa.array(met // len(blocks)))],
                                             names=["block", "word"])

    return index.select("word").mapInArrow(run, "block long, word string")


def _spread(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (q, i) with low <= i < high."""
    size = high - low
    return np.repeat(q, size), np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


_VISITED = "word string, n_near long, n long, form string"


def _visited(rows: pa.Table, visits: pa.Table) -> pa.Table:
    """What the words that visit a block find in it: how many near words, and the
    best of them (most occurrences, then first in order)."""
    words = _latin(rows["word"].to_pylist())
    counts = vectors(words)
    order = np.lexsort(counts.T[::-1])
    words, n, trie = [words[i] for i in order], rows["n"].to_numpy()[order].tolist(), Trie(counts[order])
    asked = _latin(visits["word"].to_pylist())
    found: dict[int, list] = {}
    for i, j in near_pairs(asked, words, trie):
        best = found.setdefault(i, [0, 0, b""])
        best[0] += 1
        if (-n[j], words[j]) < (-best[1], best[2]):
            best[1:] = n[j], words[j]
    near_ones, most, forms = ([x[k] for x in found.values()] for k in range(3))
    return pa.table([pa.array([asked[i].decode("latin-1") for i in found], pa.string()), pa.array(near_ones, pa.int64()),
                     pa.array(most, pa.int64()), pa.array([w.decode("latin-1") for w in forms], pa.string())], names=["word", "n_near", "n", "form"])


def nearest(index: DataFrame, block_visits: int = BLOCK_VISITS) -> DataFrame:
    """(word, n_near, form, form_n) for the words that have near words; ``form`` is
    the near word of most occurrences, the first in code-point order of equal ones."""
    visits = save(_routes(index), "visits")
    held, asked = dealt(index.select("block", "word", "n"), visits, "block", "word", block_visits)
    met = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_visited, _VISITED)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("form").alias("form")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) → (word, root): the last form of the chain that starts at
    the word.  A form is several times as frequent as its word, so chains end; each
    round doubles the steps taken."""
    at = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = save(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.select("word", "root")


def group(words: DataFrame, ratio: float = FORM_RATIO, block_words: int = BLOCK_WORDS, block_visits: int = BLOCK_VISITS) -> DataFrame:
    """words(word, n) distinct, of letters up to U+00FF → (word, form, root, n, n_near,
    form_n).  A word's form is its near word of most occurrences (of equal ones the
    first in code-point order) if that has ``ratio`` times the word's; its root ends
    the chain of forms."""
    index = indexed(words, block_words)
    best = nearest(index, block_visits)
    formed = save(index.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *(F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n"))), "forms")
    return formed.join(_roots(formed.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, letters: int = MIN_LETTERS, times: int = MIN_COUNT, ratio: float = FORM_RATIO,
             damage: int = DAMAGE) -> DataFrame:
    """The words of ``docs`` (doc_id, text) grouped by ``group``.

    Null and empty texts hold no word; a null id counts as an empty one in the
    damage rule; repeated rows count as often as they are there; ties go to the
    first in code-point order; an empty table gives an empty one; further columns
    are ignored.  Words of any length are compared whole."""
    return group(counted(docs, letters, times, damage), ratio)
