"""Connected components by rounds of hooking to the least neighbour and contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, cut, prepare, temporary


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) of the edges at hand, for nodes that aren't the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, left, right = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        least = label.copy()
        np.minimum.at(least, label[left], label[right])
        np.minimum.at(least, label[right], label[left])
        while not np.array_equal(least, least[least]):
            least = least[least]
        new = least[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, reduced to a forest in portions of bounded size."""
    held: list[np.ndarray] = []

    def out():
        a, b = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        u, v = forest(a, b)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["a", "b"])

    size = 0
    for x in batches:
        held.append(np.array([x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)], np.int64))
        size += x.num_rows
        if size >= 1 << 20:
            yield out()
            size = 0
    if size:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the least id that it reaches.

    Each round every node hooks to its least neighbour, pointers are doubled, and edges move to the roots; the
    number of nodes with edges at least halves. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    prepare(spark)
    with temporary(spark):
        left = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_local, "a long, b long"), "edges")
        labels = None
        while not left.isEmpty():
            ends = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
            up = cut(ends.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "hooks")
            while True:
                deeper = cut(_renamed(up, "p", up, "r").select("u", F.col("r").alias("p"), (F.col("p") != F.col("r")).alias("moved")), "hooks")
                more = not deeper.where("moved").isEmpty()
                up = deeper.select("u", "p")
                if not more:
                    break
            if labels is None:
                labels = up.select(F.col("u").alias("id"), F.col("p").alias("component"))
            else:
                labels = cut(_renamed(labels, "component", up, "p", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
            ends = _renamed(_renamed(left, "a", up, "a_root"), "b", up, "b_root").where("a_root <> b_root")
            left = cut(ends.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        if labels is None:
            return spark.createDataFrame([], "id long, component long")
        return cut(labels, "labels", keep=True)


def _renamed(rows: DataFrame, at: str, up: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """rows with `name`, the pointer of column `at` by up (u, p). A root that a third of all rows point to is one join key:
    rows are salted, and the pointers of the keys that rows have are first spread over the salts that they have there."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    wanted = dealt.select(F.col(at).alias("_k"), "_salt").distinct()
    to = up.select(F.col("u").alias("_k"), F.col("p").alias(name))
    if name in rows.columns:
        raise ValueError(f"a column {name} is there already")
    spread = wanted.join(to, "_k").select(F.col("_k").alias(at), "_salt", name)
    return dealt.join(spread, [at, "_salt"], how).drop("_salt")
