"""Quality by a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of the transformed statistics, shrunk
towards a scaled identity so that it is always invertible.  A text's score is
the logistic of the difference of the classes' log densities: Mahalanobis
distances by triangular solves with Cholesky factors that are made once and sent
to the tasks.  Fitting needs only per-class sums, made by Spark.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

SHRINK, PRIOR_WEIGHT = 0.1, 1.0
#: The log-density difference is spread over so many effective statistics before the logistic.
TEMPERATURE = 4.0
NAMES = ("length", "word_length", "upper", "digits", "marks", "symbols", "pipes", "distinct", "top_word", "line_words",
         "repeated_lines", "ended_lines")
_CLASS = bytes(1 if chr(c).isupper() and c < 128 else 2 if chr(c).isdigit() and c < 128 else 3 if chr(c) in ".,;:!?'\"()-"
               else 4 if c < 128 and c > 32 and not chr(c).isalnum() else 5 if c <= 32 else 0 for c in range(256))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty one has finite values too."""
    t = text or ""
    raw = t.encode("utf-8", "replace")
    kinds = np.bincount(np.frombuffer(raw.translate(_CLASS), np.uint8), minlength=6)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w, ln = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda k: float(np.sqrt(k / n))  # noqa: E731  variance is steadier for roots of shares
    counts = Counter(words)
    return [
        float(np.log1p(len(words))), float(np.log1p(sum(map(len, words)) / w)), share(kinds[1]), share(kinds[2]), share(kinds[3]),
        share(kinds[4]), share(raw.count(b"|")), float(np.log1p(len(counts)) / np.log1p(w + 1)),
        float(np.sqrt(max(counts.values(), default=0) / w)), float(np.log1p(w / ln)),
        float(np.sqrt(1 - len(set(lines)) / ln)), float(np.sqrt(sum(x.rstrip()[-1:] in b".!?" for x in lines) / ln)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row: the statistics of its whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class (0, 1): mean, lower Cholesky factor, log of prior over root determinant."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    offset: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.mean) == 1:
            return np.full(len(x), self.offset[0])
        logs = []
        for m, c, o in zip(self.mean, self.factor, self.offset):
            z = np.linalg.solve(c, (x - m).T)
            logs.append(o - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / TEMPERATURE, -700, 700)))


def fit(rows: DataFrame, shrink: float = SHRINK) -> Model:
    """rows(x, y) with y 0 or 1 → model.  Rows with another or a null label teach
    nothing.  With one class only, that class is certain; with none, scores are 0.5."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = rows.where("y in (0, 1)").groupBy("y").agg(
        F.count("*").alias("n"), F.array(*(F.sum(x[i]) for i in range(d))).alias("s"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("q")).collect()
    got = {r["y"]: r for r in sums}
    if len(got) < 2:
        return Model([np.zeros(d)], [np.eye(d)], [float(next(iter(got), 0.5))])
    n_all = sum(r["n"] for r in got.values())
    model = Model([], [], [])
    pooled = np.zeros(d)
    moments = {}
    for y, r in got.items():
        mean = np.array(r["s"]) / r["n"]
        q = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["q"]):
            q[i, j] = q[j, i] = v / r["n"]
        moments[y] = mean, q - np.outer(mean, mean)
        pooled += np.diag(moments[y][1]) * r["n"] / n_all
    for y in (0, 1):
        mean, cov = moments[y]
        scale = np.diag(np.maximum(pooled, 1e-4))             # each statistic's own spread, never zero
        c = np.linalg.cholesky((1 - shrink) * cov + shrink * scale + 1e-6 * np.eye(d))
        prior = np.log((got[y]["n"] + PRIOR_WEIGHT) / (n_all + 2 * PRIOR_WEIGHT))
        model.mean.append(mean)
        model.factor.append(c)
        model.offset.append(float(prior - np.log(np.diag(c)).sum()))
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows(doc_id, x) → (doc_id, score)."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``: how likely ``labels.quality``
    is 1.  ``learn``: condition on doc_id of the rows to learn from (default all).
    Several labels of a document all count; null or empty texts are scored by
    their statistics; rows without an id are scored and teach nothing; repeated
    rows repeat; further columns are ignored."""
    rows = save(features(docs), "statistics")
    taught = rows if learn is None else rows.where(learn)
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").alias("y"))
    model = fit(taught.join(marks, "doc_id"))
    return score(rows, model).select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
