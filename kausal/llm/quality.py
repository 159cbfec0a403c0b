"""Quality by hashed word n-gram logistic regression, trained with follow-the-regularised-leader (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, crc_mod, named, prepare
from .words import Rows, ShapeHashes, all_hashes, gathered, pairs_of, sampled, slots

#: Slots of the n-grams; most rows of each label that are learned from; passes over them.
BITS, PER_LABEL, EPOCHS = 18, 2500, 3
LEAST_SCORE = 0.3
REPEAT = 0x4F1BBCDCBFA53E0B


def quality_features():
    """Counts of words, word pairs, shapes, pairs of shapes, and words that repeat one of the two before, by slot, damped; each text has length 1."""
    words, shapes = WordHashes(), ShapeHashes()

    def f(text: str):
        raw = text.encode()
        w, s = all_hashes(raw, words), all_hashes(raw, shapes)
        again = [np.full(int((w[k:] == w[:-k]).sum()), REPEAT * k % (1 << 64), np.uint64) for k in (1, 2)]
        cols, n = slots(np.concatenate([w, pairs_of(w), s, pairs_of(s), *again]), BITS)
        v = np.sqrt(n)
        return cols, v / max(np.sqrt((v * v).sum()), 1e-12)

    return f


def ftrl(rows: Rows, y: np.ndarray, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal: each weight follows from its sums z and n when it is needed."""
    z, n, z0, n0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.RandomState(3)
    for _ in range(epochs):
        for k in rng.permutation(rows.n):
            at = slice(rows.starts[k], rows.starts[k + 1])
            cols, vals = rows.cols[at], rows.vals[at]
            w, b = weight(z[cols], n[cols]), -z0 / ((beta + np.sqrt(n0)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(vals @ w + b, -35, 35)))
            g, g0 = (p - y[k]) * vals, p - y[k]
            z[cols] += g - (np.sqrt(n[cols] + g * g) - np.sqrt(n[cols])) / alpha * w
            n[cols] += g * g
            z0 += g0 - (np.sqrt(n0 + g0 * g0) - np.sqrt(n0)) / alpha * b
            n0 += g0 * g0
    return weight(z, n), float(-z0 / ((beta + np.sqrt(n0)) / alpha))


def scorer(features, w: np.ndarray, bias: float):
    """An Arrow function from (id, text) to (id, score): the logistic of a sparse dot product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features()
        for x in batches:
            m = np.array([float(v @ w[c]) + bias for c, v in (f(t or "") for t in x.column(1).to_pylist())], np.float64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(1 / (1 + np.exp(-np.clip(m, -35, 35))))], ["id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows; at most per_label of each label, chosen by hashed id. An id with both labels counts
    as 0. Without labels all is zero; with one label only, every text scores alike."""
    known = labels.where(F.col(label).isin(0, 1)).select(named(id_col), F.col(label).cast("int").alias(label))
    keys, rows = gathered(docs, sampled(known, label, per_label, id_col), quality_features, id_col, text_col)
    y = np.array([float(k) for k in keys])
    return ftrl(rows, y, 1 << BITS) if len(set(keys)) > 1 else (np.zeros(1 << BITS), float(np.sign(y.sum() - 0.5)) * 2 if len(y) else 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1). Null and empty texts score by the bias alone; null ids stay null;
    repeated rows each give a row; very long texts are read in portions; empty tables give no rows; other columns are not
    looked at."""
    prepare(docs.sparkSession)
    w, bias = model
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scorer(quality_features, w.astype(np.float32), bias), "id long, score double").withColumnRenamed("id", id_col)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    prepare(spark)
    found = score(docs, fit(docs, labels.where(crc_mod("doc_id", 5) != 0)))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
