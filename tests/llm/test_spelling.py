"""Spelling variants against all pairs of words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kitman.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, form string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs, letters, times, every):
    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= letters and c >= times}


def brute_groups(n, ratio=5):
    out = {}
    for w, c in n.items():
        around = sorted((-n[x], x) for x in n if near(w, x))
        form = around[0][1] if around and n[around[0][1]] >= ratio * c else None
        out[w] = (form, c, len(around), n[form] if form else None)
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (x[0], root(w), *x[1:]) for w, x in out.items()}


def collected(df):
    rows = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def invented(n, seed):
    """Words of few syllables, so that many are near, anagrams or rotations."""
    r = random.Random(seed)
    words = {"".join(r.choice(["an", "na", "ab", "é", "ÿ", "x", "À"]) for _ in range(r.randrange(3, 7))) for _ in range(n)}
    return {w: int(r.paretovariate(0.5)) % 4000 + 1 for w in words if len(w) >= 4}


@pytest.mark.parametrize("block, visits", [(50_000, 200_000), (37, 50)])
def test_groups_equal_all_pairs(spark, block, visits):
    words = invented(900, 1) | {"a" * 5000: 100, "a" * 4999: 3, "a" * 2500 + "b" + "a" * 2499: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert collected(S.group(df, block_words=block, block_visits=visits)) == brute_groups(words)


def test_search_meets_just_the_budget():
    r = np.random.default_rng(2)
    rows = np.unique(r.integers(0, 2, (400, S.LEVELS)) * r.integers(0, 2, (400, S.LEVELS)), axis=0)
    asked = np.vstack([rows[:50], rows[:50] + np.eye(S.LEVELS, dtype=int)[r.integers(0, S.LEVELS, 50)]])
    found = {(i, j) for q, low, high in S.Trie(rows).search(asked) for i, j in zip(*(x.tolist() for x in S._spread(q, low, high)))}
    gap = rows[None] - asked[:, None]
    want = {tuple(x) for x in np.argwhere((np.maximum(gap, 0).sum(axis=2) <= 1) & (np.maximum(-gap, 0).sum(axis=2) <= 1)).tolist()}
    assert found == want


def test_near_words():
    for a, b in [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "abcc"), ("abc", "acb"), ("abc", "bc"), ("ab", "abcd"), ("aab", "aaab"), ("xbc", "abx")]:
        assert S.near(a.encode(), b.encode()) == near(a, b) == S.near(b.encode(), a.encode())


def texts():
    r = random.Random(7)
    words = list(invented(150, 3)) + ["Information", "information", "informaton", "STRASSE", "Äpfel×÷", "ÉCOLE", "école"]
    docs = [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=300))) for i in range(60)]
    return docs + [(None, "information " * 9), (100, None), (101, ""), (102, "12 !? \n"), (103, docs[3][1]), (3, docs[3][1]),
                   (104, "word" * 100_000 + " " + "information,Information;" * 20_000)]


def test_variants_of_texts(spark):
    docs = texts()
    df = spark.createDataFrame([(d, t, "clash", 1, "clash") for d, t in docs], SCHEMA).repartition(4)
    for every in (7, 0):
        n = brute_words(docs, 6, 5, every)
        assert len(n) > 50 and collected(S.variants(df, damage=every)) == brute_groups(n)
    assert S.variants(spark.createDataFrame([], SCHEMA)).count() == 0
