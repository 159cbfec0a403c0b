"""Scores of a graph against a reference graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names of the metrics, in the order of the report.
KEYS = ("Precision", "Recall_TPR", "F1", "FDR", "FPR", "SHD", "TP", "FP", "FN", "TN")


def confusion(pred: DataFrame, truth: DataFrame, n_vars: int, ordered: bool = True) -> DataFrame:
    """One row (TP, FP, FN, TN, SHD) over pairs of different variables: ordered entries, or unordered pairs.

    pred and truth are (src, dst) without repetition; self-pairs don't count.
    """
    a, b = ("src", "dst") if ordered else ("least(src, dst)", "greatest(src, dst)")
    side = lambda df, c: df.where("src <> dst").select(F.expr(a).alias("a"), F.expr(b).alias("b")).distinct().withColumn(c, F.lit(1))
    both = side(pred, "p").join(side(truth, "t"), ["a", "b"], "full_outer")
    total = n_vars * (n_vars - 1) // (1 if ordered else 2)
    counts = both.agg(F.expr("count_if(p = 1 and t = 1)").alias("TP"), F.expr("count_if(p = 1 and t is null)").alias("FP"), F.expr("count_if(t = 1 and p is null)").alias("FN"))
    return counts.withColumn("TN", F.lit(total).cast("long") - F.col("TP") - F.col("FP") - F.col("FN")).withColumn("SHD", F.col("FP") + F.col("FN"))


def ratios(counts: DataFrame) -> DataFrame:
    """Unrounded Precision, Recall_TPR, F1, FDR and FPR beside the counts; a zero denominator gives 0."""
    over = lambda a, b: F.coalesce(F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double")), F.lit(0.0))
    out = counts.withColumns({"Precision": over("TP", "TP + FP"), "Recall_TPR": over("TP", "TP + FN"), "FDR": over("FP", "TP + FP"), "FPR": over("FP", "FP + TN")})
    return out.withColumn("F1", over("2 * Precision * Recall_TPR", "Precision + Recall_TPR")).select(*KEYS)


def compute_metrics(arrows: DataFrame, truth: DataFrame, n_vars: int) -> dict[str, float]:
    """The ten directed metrics, ratios to four places as Python rounds."""
    row = ratios(confusion(arrows, truth, n_vars)).first()
    return {k: round(row[k], 4) if isinstance(row[k], float) else row[k] for k in KEYS}


def skeleton_metrics(edges: DataFrame, truth: DataFrame, n_vars: int) -> DataFrame:
    return ratios(confusion(edges.select(F.col("i").alias("src"), F.col("j").alias("dst")), truth, n_vars, ordered=False))


def pair_states(edges: DataFrame, arrows: DataFrame) -> DataFrame:
    """(a, b, state) of unordered pairs: '>', '<', 'x' for both ways, '-' for an edge without an arrow."""
    ways = arrows.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up")).groupBy("a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
    lines = edges.select(F.col("i").alias("a"), F.col("j").alias("b"))
    state = F.expr("case when up and down then 'x' when up then '>' when down then '<' else '-' end")
    return lines.join(ways, ["a", "b"], "full_outer").select("a", "b", state.alias("state"))


def shd_edges(edges: DataFrame, arrows: DataFrame, truth: DataFrame) -> DataFrame:
    """Structural distance by pairs: one for each unordered pair whose state differs."""
    t = pair_states(truth.where("src <> dst").select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct(), truth)
    both = pair_states(edges, arrows).join(t.withColumnRenamed("state", "want"), ["a", "b"], "full_outer")
    return both.agg(F.expr("count_if(state is distinct from want)").alias("SHD"))


def orientation_counts(edges: DataFrame, arrows: DataFrame, truth: DataFrame) -> DataFrame:
    """Among pairs adjacent in both graphs: same state, opposite single direction, undirected, anything else."""
    t = pair_states(truth.where("src <> dst").select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct(), truth)
    both = pair_states(edges, arrows).join(t.withColumnRenamed("state", "want"), ["a", "b"])
    turned = "(state = '>' and want = '<') or (state = '<' and want = '>')"
    return both.agg(
        F.expr("count_if(state = want)").alias("correct"), F.expr(f"count_if({turned})").alias("reversed"), F.expr("count_if(state <> want and state = '-')").alias("undirected"),
        F.expr(f"count_if(state <> want and state <> '-' and not ({turned}))").alias("other"),
    )


def align(truth_names: DataFrame, variables: DataFrame) -> DataFrame:
    """(src, dst) by the dataset's indices, of edges (src_name, dst_name) whose ends are both in it."""
    v = lambda n, i: variables.select(F.col("name").alias(n), F.col("idx").alias(i))
    return truth_names.join(v("src_name", "src"), "src_name").join(v("dst_name", "dst"), "dst_name").select("src", "dst").distinct()


def by_recovery(truth_names: DataFrame, variables: DataFrame) -> DataFrame:
    """(src_name, dst_name, recoverable): each edge of a reference graph, and whether both its ends are in the dataset."""
    v = lambda n, flag: variables.select(F.col("name").alias(n), F.lit(True).alias(flag)).distinct()
    both = truth_names.select("src_name", "dst_name").distinct().join(v("src_name", "_s"), "src_name", "left").join(v("dst_name", "_d"), "dst_name", "left")
    return both.select("src_name", "dst_name", (F.col("_s").isNotNull() & F.col("_d").isNotNull()).alias("recoverable"))


def missing_edges(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst) of the reference graph, by index, that the found arrows don't have."""
    return truth.where("src <> dst").select("src", "dst").distinct().join(found.select("src", "dst"), ["src", "dst"], "left_anti")


def dense_matrix(arrows: DataFrame, n_vars: int) -> np.ndarray:
    """The arrows as an n x n matrix of 0 and 1 on the driver."""
    out = np.zeros((n_vars, n_vars), int)
    for src, dst in arrows.select("src", "dst").collect():
        out[src, dst] = 1
    return out
