"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, each run of white space becomes one space and a space is
put at both ends. Features are the distinct n-grams of `SIZES` characters,
hashed to `2 ** BITS` buckets. Each is scaled by the log ratio of how often it
occurs in toxic and in other texts, and a ridge-penalised logistic regression is
fitted on the scaled features. Buckets of little weight are then left out and
the curve is fitted anew, so that scoring a text touches few buckets. Whole
texts are scored, in slices, whatever their length.

Defined results: a null text counts as empty and gets the score of the
intercept; repeated rows get equal scores; an empty table gives an empty table;
`score` passes other columns through and replaces one named ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomgraph.llm.quality_classifier import labelled_sample, logistic, remainder
from loomgraph.ship import ship

SIZES, BITS = (3, 4, 5, 6), 20
#: Labelled rows of each class that a fit uses at most, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 60_000
FEATURES, ALPHA, RIDGE, ROUNDS = 30_000, 0.5, 2e-4, 40
PART = 1 << 20


def codes(text: str) -> np.ndarray:
    """Code points of the text as it is looked at."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), "<u4")


def grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of each n-gram of `c`, size by size, in parts of bounded length."""
    top = max(SIZES)
    for lo in range(0, max(1, len(c)), PART):
        x = c[lo : lo + PART + top - 1].astype(np.uint32)
        h = np.full(len(x), 0x811C9DC5, np.uint32)
        for n in range(1, top + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in SIZES:
                yield h[:PART] & np.uint32((1 << BITS) - 1)


def present(text: str) -> np.ndarray:
    got = [np.unique(g) for g in grams(codes(text))]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margins(self):
        """A function from a text to the sum of the weights of its distinct n-grams."""
        table = np.zeros(1 << BITS, np.float32)
        table[self.buckets] = self.weights
        used = table != 0

        def margin(text: str) -> float:
            hits = [g[used[g]] for g in grams(codes(text))]
            hits = np.concatenate(hits) if hits else np.zeros(0, np.uint32)
            return float(table[np.unique(hits)].sum(dtype=np.float64)) if len(hits) else 0.0

        return margin


def fit_texts(texts: list[str], labels: list[int]) -> ToxicityModel:
    y = np.asarray(labels, float)
    rows = [present(t) for t in texts]
    if not len(y) or y.min() == y.max():
        slope, offset = logistic(np.zeros(len(y)), y)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), slope, offset)
    col = np.concatenate(rows).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    size = 1 << BITS
    pos = np.bincount(col, weights=y[row], minlength=size)
    neg = np.bincount(col, minlength=size) - pos
    ratio = np.log((ALPHA + pos) / (ALPHA + y.sum())) - np.log((ALPHA + neg) / (ALPHA + (1 - y).sum()))
    # n-grams seen in one text only say nothing about another
    keep = np.flatnonzero((pos + neg >= 2) & (np.abs(ratio) > 0.1))
    number = np.full(size, -1, np.int32)
    number[keep] = np.arange(len(keep), dtype=np.int32)
    ok = number[col] >= 0
    row, col = row[ok], number[col[ok]]
    scale = ratio[keep]
    w, b = _regression(row, col, scale, y, len(rows))
    weight = w * scale
    best = np.sort(np.argsort(-np.abs(weight), kind="stable")[:FEATURES])
    model = ToxicityModel(keep[best], weight[best].astype(np.float32), 1.0, float(b))
    margin = model.margins()
    slope, offset = logistic(np.array([margin(t) for t in texts]), y)
    return ToxicityModel(model.buckets, model.weights, slope, offset)


def _regression(row, col, scale, y, n) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled presence features by accelerated gradient steps; both classes weigh the same."""
    value = scale[col].astype(np.float32)
    d = len(scale)
    sample = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    norm = np.bincount(row, value * value, n)
    lip = 0.25 * float((sample * (norm + 1)).sum()) + RIDGE
    w, b, vw, vb, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * vw[col], n) + vb, -50, 50)))
        g = sample * (p - y)
        nw = vw - (np.bincount(col, value * g[row], d) + RIDGE * vw) / lip
        nb = vb - g.sum() / lip
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / s * (nw - w), nb + (t - 1) / s * (nb - b)
        w, b, t = nw, nb, s
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "toxic", per_class: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that satisfy `rows` (default: all)."""
    got = labelled_sample(docs, labels, label, F.lit(True) if rows is None else rows, per_class, max_bytes)
    return fit_texts([t for _, t, _ in got], [y for _, _, y in got])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """`docs` with ``score``, the probability of label 1."""
    ship(docs.sparkSession)

    @pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margin = model.margins()
        for part in texts:
            z = np.array([margin(t or "") for t in part], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -50, 50))))

    return docs.withColumn("score", probability(F.col(text_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, remainder(5) != 0)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
