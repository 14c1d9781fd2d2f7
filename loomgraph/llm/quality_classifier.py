"""Compression classifier for document quality.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is cut into blocks, each block is compressed with
either dictionary, and the difference of the two sums over the text's bytes
(the normalised compressed-size difference) is turned into a probability by a
logistic curve fitted on labelled texts that neither dictionary has seen. Each
text is thought to stand beside `PULL` bytes with the usual difference of good
texts. The curve gives either class the same weight, whatever their shares.

Defined results: a null text counts as empty; the empty text has the usual
difference and gets the curve's value there; a text of any length is compressed
whole; a score of exactly one half counts as good; repeated rows get equal scores,
and of texts that share a labelled id the smallest is learnt from; an empty
table gives an empty table. Other columns of `docs` are passed through by
`score`, except ``score`` and ``size_difference``, which it replaces; `stage`
leaves every column of its documents as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomgraph.ship import ship

#: Labelled rows of each class that a fit uses at most, and the longest text among them.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 50_000
DICT_BYTES, BLOCK, LEVEL = 524_288, 512, 3
#: Bytes of usual good text that stand beside each text, so that a few words alone don't decide.
PULL = 64


def _blocks(b: bytes, size: int) -> list[bytes]:
    return [b[i : i + size] for i in range(0, len(b), size)]


@dataclass(frozen=True)
class CompressionClassifier:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    block: int = BLOCK
    level: int = LEVEL
    usual: float = 0.0

    def differ(self):
        """A function from bytes to the normalised compressed-size difference."""
        made = []
        for d in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(d) if d else None
            if d:
                d.precompute_compress(level=self.level)
            more = {} if d is None else {"dict_data": d}
            made.append(zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **more).compress)
        good, bad, size, usual = *made, self.block, self.usual

        def differ(b: bytes) -> float:
            total = 0
            for i in range(0, len(b), size):
                x = b[i : i + size]
                total += len(bad(x)) - len(good(x))
            return (total + PULL * usual) / (len(b) + PULL)

        return differ

    def probability(self, difference):
        z = np.clip(self.slope * np.asarray(difference, float) + self.offset, -50, 50)
        return 1 / (1 + np.exp(-z))


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """A trained dictionary, or the texts' own start where there is too little to train on."""
    pieces = [p for t in dict.fromkeys(texts) for p in _blocks(t, block)]
    try:
        return zstandard.train_dictionary(size, list(dict.fromkeys(pieces))).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:size] if sum(map(len, pieces)) >= 8 else b""


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps; classes weigh the same."""
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(x) else 0.5
        return 0.0, math.log(p / (1 - p))
    scale = x.std() or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        g = a.T @ (w * (p - y)) + ridge * beta * [1, 0]
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(h, g)
        beta -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
    return float(beta[0] / scale), float(beta[1])


def fit_texts(texts: list[bytes], labels: list[int], dict_bytes: int = DICT_BYTES, block: int = BLOCK, level: int = LEVEL) -> CompressionClassifier:
    """Fit on texts in hand; two thirds make the dictionaries, one third the curve."""
    y = np.asarray(labels, int)
    part = np.arange(len(texts)) % 3 == 2
    good, bad = ([t for t, one, p in zip(texts, y, part, strict=True) if one == k and not p] for k in (1, 0))
    raw = CompressionClassifier(_dictionary(good, dict_bytes, block), _dictionary(bad, dict_bytes, block), 1.0, 0.0, block, level)
    differ = raw.differ()
    x = np.array([differ(t) * (len(t) + PULL) for t, p in zip(texts, part, strict=True) if p])
    n = np.array([len(t) for t, p in zip(texts, part, strict=True) if p])
    best = (x / np.maximum(n, 1))[(y[part] == 1) & (n > 0)]
    usual = float(np.median(best)) if len(best) else 0.0
    slope, offset = logistic((x + PULL * usual) / (n + PULL), y[part])
    return CompressionClassifier(raw.good, raw.bad, slope, offset, block, level, usual)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: Column, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int]]:
    """Up to `per_class` labelled texts of each class, those with the smallest hash of their id.

    The ids are picked from the narrow label table first, so the join's small
    side is bounded by ``2 * per_class`` rows. Null ids and labels are left out.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & rows).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    picked = None
    for k in (0, 1):
        some = own.where(F.col("_y") == k).orderBy(key, id_col).limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where(F.octet_length("_t") <= max_bytes)
    got = texts.join(F.broadcast(picked), id_col).groupBy(id_col).agg(F.min("_t"), F.max("_y")).collect()
    return sorted(((r[0], r[1], r[2]) for r in got), key=lambda r: (hash_order(r[0]), r[0]))


def hash_order(i) -> int:
    import zlib

    return zlib.crc32(f"{i}/order".encode())


def remainder(by: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `by`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "quality", per_class: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> CompressionClassifier:
    """Fit on a bounded sample of the labelled rows that satisfy `rows` (default: all)."""
    got = labelled_sample(docs, labels, label, F.lit(True) if rows is None else rows, per_class, max_bytes)
    return fit_texts([t.encode() for _, t, _ in got], [y for _, _, y in got])


def score(docs: DataFrame, model: CompressionClassifier, text_col: str = "text") -> DataFrame:
    """`docs` with ``size_difference`` and ``score`` (probability of label 1)."""
    ship(docs.sparkSession)

    @pandas_udf("double")
    def difference(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        differ = model.differ()
        for part in texts:
            yield pd.Series([differ((t or "").encode("utf-8", "replace")) for t in part], dtype="float64")

    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(model.slope) * F.col("size_difference") + F.lit(model.offset)))
    return docs.withColumn("size_difference", difference(F.col(text_col))).withColumn("score", 1 / (1 + F.exp(-z)))


def train_rows() -> Column:
    return remainder(3) != 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, train_rows())
    return score(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half, with their own columns as they are, whatever their names."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_rows())
    whole = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"))
    return score(whole, model).where("score >= 0.5").select("__whole.*")
