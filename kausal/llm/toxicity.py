"""Toxicity by non-negative positive-unlabelled learning (operator 10).

Confirmed toxic texts are the positives; other texts, whatever their labels, are unlabelled. The risk of the negative
class is what the unlabelled texts show less the share of positives among them (the class prior); when the estimate
falls below zero, its gradient is turned round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, named, prepare
from .quality import scorer
from .words import BareHashes, Rows, all_hashes, gathered, sampled, slots

#: Slots of the words; most positives and unlabelled texts; standard errors that a word's shares of them must differ by; steps.
BITS, POSITIVES, UNLABELLED, APART, STEPS = 18, 2500, 5000, 4.0, 250


def toxic_features():
    """Which words, and first four letters of words, a text has, in lower case and without the punctuation around them."""
    words, beginnings = BareHashes(), BareHashes(4)

    def f(text: str):
        raw = text.encode()
        cols, _ = slots(np.concatenate([all_hashes(raw, words), all_hashes(raw, beginnings)]), BITS)
        return cols, np.ones(len(cols), np.float32)

    return f


def telling(rows: Rows, positive: np.ndarray, size: int) -> np.ndarray:
    """Whether each slot's shares of the positive and of the unlabelled texts differ by over APART standard errors."""
    n = [max(1, int(m.sum())) for m in (positive, ~positive)]
    has = [np.bincount(rows.cols[m[rows.row]], minlength=size) for m in (positive, ~positive)]
    pool = (has[0] + has[1]) / sum(n)
    error = np.sqrt(pool * (1 - pool) * (1 / n[0] + 1 / n[1]))
    return np.abs(has[0] / n[0] - has[1] / n[1]) > APART * error


def nnpu(rows: Rows, positive: np.ndarray, prior: float, size: int, steps: int = STEPS, rate: float = 0.05, l1: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk with logistic loss; Adam with soft thresholds."""
    rows.vals = rows.vals * telling(rows, positive, size)[rows.cols]
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    for t in range(1, steps + 1):
        g = np.clip(rows.dot(w) + b, -35, 35)
        s = 1 / (1 + np.exp(-g))
        loss_neg = np.logaddexp(0, g)
        negative_risk = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        as_negative = np.where(positive, -prior / n_p, 1 / n_u) * s  # gradient of the negative class's risk
        d = np.where(positive, prior / n_p * (s - 1), 0.0) + as_negative if negative_risk >= 0 else -as_negative
        gw, gb = rows.back(d, size), d.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-4)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, unlabelled, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias. unlabelled: a condition on docs; prior: the share of toxic texts, by default that of the labels, at most a half.
    An id with both labels counts as toxic. At most POSITIVES and UNLABELLED texts, chosen by hashed id. Without confirmed toxic texts nothing is toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & named(id_col).isNotNull())
    if prior is None:
        toxic, total = known.agg(F.sum("toxic"), F.count("*")).first()
        prior = (toxic or 0) / max(1, total)
    prior = min(max(prior, 1e-3), 0.5)
    chosen = sampled(known.where("toxic = 1").select(named(id_col), F.lit(1).alias("part")), "part", POSITIVES, id_col)
    others = sampled(docs.where(unlabelled).select(named(id_col), F.lit(0).alias("part")), "part", UNLABELLED, id_col)
    (pos, rows_p), (neg, rows_u) = (gathered(docs, part, toxic_features, id_col, text_col) for part in (chosen, others))
    rows, positive = rows_p.then(rows_u), np.array([True] * len(pos) + [False] * len(neg))
    return nnpu(rows, positive, prior, 1 << BITS) if positive.any() and not positive.all() else (np.zeros(1 << BITS), -2.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1). Null and empty texts score by the bias alone; null ids stay null;
    repeated rows each give a row; very long texts are read in portions; empty tables give no rows; other columns are not
    looked at."""
    prepare(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scorer(toxic_features, model[0].astype(np.float32), model[1]), "id long, score double").withColumnRenamed("id", id_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    prepare(spark)
    found = score(docs, fit(docs, labels.where(crc_mod("doc_id", 5) != 0), crc_mod("doc_id", 5) != 0))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
