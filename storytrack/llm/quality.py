"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storytrack.llm.common import fit_in_task, fold, fresh, labelled_sample, replace_columns, ship, table

BUCKETS = 1 << 18
# Bound of the training sample, in labelled documents, and passes over it.
TRAIN_DOCS = 12_000
EPOCHS = 4
THRESHOLD = 0.3
# Per-coordinate learning rate and regularisation of the updates.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
PIECE = 1 << 17  # words that are hashed at a time

TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME, _UPPER = xxhash.xxh3_64_intdigest(b"\x00same"), xxhash.xxh3_64_intdigest(b"\x00upper")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's word 1- and 2-grams: square roots of shares, unit length.

    Words are runs of word characters or of punctuation. A word equal to the one before it
    and a word in capitals also count as a word of their own kind, so that repetition and
    shouting show whatever the words are. An empty text has the one bucket 0.
    """
    counts: dict[int, int] = {}
    digest = xxhash.xxh3_64_intdigest
    words = TOKEN.findall(text or "")
    for at in range(0, len(words), PIECE):
        part = words[max(0, at - 1):at + PIECE]
        h = np.fromiter((digest(w) for w in part), np.uint64, len(part))
        own = h[1:] if at else h
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        same = int((h[1:] == h[:-1]).sum())
        upper = sum(len(w) > 1 and w.isupper() for w in (part[1:] if at else part))
        every = np.concatenate([own, pairs, np.full(same, _SAME, np.uint64), np.full(upper, _UPPER, np.uint64)])
        every ^= every >> np.uint64(29)
        found, n = np.unique((every * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46), return_counts=True)
        for k, v in zip(found.tolist(), n.tolist(), strict=True) if len(words) > PIECE else ():
            counts[k] = counts.get(k, 0) + v
        if len(words) <= PIECE:
            return found.astype(np.int64), np.sqrt(n / n.sum()).astype(np.float32)
    if not counts:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    n = np.array(list(counts.values()))
    return np.array(list(counts), np.int64), np.sqrt(n / n.sum()).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    active = np.abs(z) > L1
    return np.where(active, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _train(frames) -> bytes:
    rows = [(*features(t), float(y)) for pdf in frames for t, y in zip(pdf["text"], pdf["label"], strict=True)]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last bucket is the bias
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return _weights(z, n).astype(np.float32).tobytes()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "label", train_docs: int = TRAIN_DOCS) -> bytes:
    """Weights learnt from the ``train_docs`` labels (id, 0/1) with the smallest id hashes.

    Null labels and ids without a document are left out; null texts count as ''. Without
    labelled rows all weights are 0 and every score is 0.5.
    """
    return fit_in_task(labelled_sample(docs, labels, id_col, text_col, label_col, train_docs), _train,
                       ["_place", "text", "label"])


def quality_score(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Probability of label 1 for a text column: logistic of a sparse dot product."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        w = np.frombuffer(shared.value, np.float32)
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            at, x = features(t)
            out[i] = w[at] @ x + w[BUCKETS]
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return run(text)


def score_quality(docs: DataFrame, model: bytes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (columns of these names are replaced).

    Every whole text is scored, null as ''; repeated rows score alike.
    """
    own = fresh(docs, "_q")
    scored = docs.withColumn(own, quality_score(docs.sparkSession, F.col(text_col), model))
    return replace_columns(scored, score=F.col(own), predicted=(F.col(own) >= threshold).cast("int")).drop(own)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
