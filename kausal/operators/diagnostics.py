"""What the time order of the rows does to the tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import CLIP, TINY
from ..sources.shared import cut, ship, temporary
from .moments import Correlations, from_blocks, thinned_blocks


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt out by ranges of the order and sorted in them; rows that tie go by their other columns, so that any two
    rows that differ have one order. Columns of a type without an order (maps) don't break ties."""
    rest = [f.name for f in df.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString() and f.dataType.typeName() not in ("variant", "calendarinterval")]
    keys = [*order, *rest]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def ordered_index(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _row, its place in the order, from 0.

    Ranges are chosen once: the rows are written with the number of their range and their place in it, and read again.
    Only the sizes of the ranges meet, one number a task.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    held = cut(in_order(df, order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ordered")
    starts, at = [], 0
    for part, n in sorted(tuple(r) for r in held.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    first = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return held.join(F.broadcast(first), "_part").withColumn("_row", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and centred sums (n, mean x, mean y, xx, yy, xy) of two sets of pairs, column by column."""
    n = a[0] + b[0]
    with np.errstate(all="ignore"):
        dx, dy = b[1] - a[1], b[2] - a[2]
        w = np.where(n > 0, a[0] * b[0] / np.where(n > 0, n, 1), 0)
        share = np.where(n > 0, b[0] / np.where(n > 0, n, 1), 0)
        out = np.array([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])
    out = np.where(a[0] == 0, b, out)
    return np.where(b[0] == 0, a, out)


def _pairs(now: np.ndarray, before: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The same of rows of pairs, without those where known is false."""
    with np.errstate(all="ignore"):
        n = known.sum(axis=0).astype(float)
        x, y = np.where(known, now, 0), np.where(known, before, 0)
        mx, my = (np.where(n > 0, v.sum(axis=0) / np.where(n > 0, n, 1), 0) for v in (x, y))
        dx, dy = np.where(known, now - mx, 0), np.where(known, before - my, 0)
        return np.array([n, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)])


def _neighbours(p: int):
    """One row a task: its number, the sums over its neighbouring rows, its first and its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, last = np.zeros((6, p)), None, None
        for x in batches:
            if not x.num_rows:
                continue
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in x.columns])
            there = np.column_stack([np.asarray(c.is_valid()) for c in x.columns])
            if last is None:
                first = (values[0], there[0])
            else:
                values, there = np.vstack([last[0], values]), np.vstack([last[1], there])
            total = _merged(total, _pairs(values[1:], values[:-1], there[1:] & there[:-1]))
            last = (values[-1], there[-1])
        if last is not None:
            ends = [[float(v) if ok else None for v, ok in zip(*e, strict=True)] for e in (first, last)]
            kinds = [pa.int32(), *[pa.list_(pa.float64())] * 3]
            row = [TaskContext.get().partitionId(), total.ravel().tolist(), *ends]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "sums", "first", "last"])

    return run


def lag1_autocorrelation(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(name, n, r): correlation of each column with its row before, over the n neighbouring pairs without a NULL; a NaN
    gives NaN. One pass: each range of the order sums over its own pairs, and what meets at the driver is one row a task
    (its sums, first and last row), for the pairs across the ranges' edges."""
    ship(df.sparkSession)
    p = len(columns)
    ordered = in_order(df.select(*order, *[c for c in columns if c not in order]), order)
    rows = ordered.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).mapInArrow(_neighbours(p), "part int, sums array<double>, first array<double>, last array<double>")
    total, before = np.zeros((6, p)), None
    for r in sorted(rows.collect(), key=lambda r: r["part"]):
        total = _merged(total, np.array(r["sums"]).reshape(6, p))
        if before is not None:
            known = np.array([[a is not None and b is not None for a, b in zip(r["first"], before, strict=True)]])
            one = [np.array([[0.0 if v is None else v for v in e]]) for e in (r["first"], before)]
            total = _merged(total, _pairs(*one, known))
        before = r["last"]
    with np.errstate(all="ignore"):
        norms = np.sqrt(total[3]) * np.sqrt(total[4])
        r = np.where((total[0] < 2) | (norms <= TINY), 0.0, np.clip(total[5] / norms, -CLIP, CLIP))
    return df.sparkSession.createDataFrame([(c, int(total[0, k]), float(r[k])) for k, c in enumerate(columns)], "name string, n long, r double")


def thinned_matrices(df: DataFrame, columns: list[str], order: list[str], steps: Sequence[int]) -> list[Correlations]:
    """The matrices of the table thinned by each step. The rows are sorted once; one pass over them keeps an accumulator a step."""
    with temporary(df.sparkSession):
        blocks = thinned_blocks(ordered_index(df, order), "_row", columns, list(steps)).toArrow()
    at = np.asarray(blocks.column("part"))
    return [from_blocks(blocks.filter(pa.array(at == k)), columns) for k in range(len(steps))]


def thin(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every step-th row in the order, the first included. The ordered rows are written once to the shared folder."""
    return ordered_index(df, order).where(F.col("_row") % step == 0).drop("_row")
