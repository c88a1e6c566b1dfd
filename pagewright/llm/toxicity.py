"""Operator 4: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Labelled rows, at most SAMPLE_ROWS of them (chosen by a hash of the id), train one model in one task: each coordinate has its own learning
rate, and the L1 term keeps all but a few weights at zero. The weights, at most BUCKETS of them, are broadcast; every
row is then scored where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

#: Bound on labelled rows that training reads: the sample's texts and features fit one task (about 0.2 GB).
SAMPLE_ROWS = 15_000
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
THRESHOLD = 0.7
CACHE_WORDS = 500_000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_SHIFT = np.uint64(64 - BUCKET_BITS)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Features:
    """Buckets of a text's words, word pairs, and pairs with one word between, each bucket once."""

    def __init__(self):
        self.hashes: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        known = self.hashes
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))

    def buckets(self, text: str) -> np.ndarray:
        h = self.words(text)
        with np.errstate(over="ignore"):
            pairs = [(h[:-1] * _MIX[0] + h[1:]) * _MIX[1], (h[:-2] * _MIX[1] + h[2:]) * _MIX[2]]
        return np.concatenate([h, *pairs] if len(h) else [h]) >> _SHIFT


class Ftrl:
    """Per coordinate: z, the shifted sum of gradients, and n, the sum of their squares. The weight follows from both."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the bias, without L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == BUCKETS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(texts: list[str], labels: list[int], passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of the weights that aren't zero; bucket BUCKETS is the bias."""
    f, model = Features(), Ftrl()
    rows = [np.append(np.unique(f.buckets(t)).astype(np.int32), np.int32(BUCKETS)) for t in texts]
    for _ in range(passes):
        for at, y in zip(rows, labels):
            model.learn(at, y)
    w = model.weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def remainder(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled rows whose crc32(id) mod 3 isn't 1. Rows without a label or id don't count; null texts are empty. No labels: no weights.

    Rows that repeat a labelled id count once, by the text that sorts first, and so do labels, by the smaller one."""
    usable = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (remainder(id_column) != 1)).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    n = usable.count()
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    order = F.xxhash64(F.lit("toxicity"), F.col("id"))
    if n > sample_rows:  # 2 ** 20 cells of hash values; the share kept makes the sample no larger than the bound, but for chance
        usable = usable.where(F.pmod(order, F.lit(1 << 20)) < int((1 << 20) * 0.97 * sample_rows / n))
    sample = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(F.broadcast(usable), "id")
    # One row an id, whichever rows repeat it: the sample can't outgrow the number of ids.
    sample = sample.groupBy("id").agg(F.min(F.struct("text", "label")).alias("r")).select("r.text", "r.label", order.alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "text", "label"])
        at, w = train(all_rows["text"].tolist(), all_rows["label"].tolist())
        yield pd.DataFrame({"bucket": at, "weight": w})

    bounded_batches(docs.sparkSession)
    found = sample.repartition(1).mapInPandas(run, "bucket int, weight double").toPandas()
    return found["bucket"].to_numpy(), found["weight"].to_numpy()


def score_toxicity(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text_column: str = "text", out_column: str = "score") -> DataFrame:
    """docs with the probability of toxicity of each row; null and empty texts get the bias's. A column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1]))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w = sent.value
        dense = np.zeros(BUCKETS + 1)
        dense[at] = w
        f = Features()
        for batch in texts:
            total = []
            for t in batch:
                b = f.buckets(t if isinstance(t, str) else "")
                total.append(dense[BUCKETS] + dense[np.unique(b[dense[b] != 0])].sum())
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    return docs.withColumn(out_column, score(F.col(text_column)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted (1 from the threshold on)."""
    scored = score_toxicity(docs.select(id_column, text_column), fit(docs, labels, id_column, text_column), text_column)
    return scored.select(id_column, (remainder(id_column) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
