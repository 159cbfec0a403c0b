"""Sufficient statistics: the only passes over the rows.

Centred sums of products are held in blocks of columns: a block is one (block of i, block of j), and blocks are merged apart from
each other, so no task and no row holds the whole matrix of a wide table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import guarded_corr
from ..sources.shared import ship

#: Columns of a block; parts that one task merges in the first of two rounds; bytes of a matrix that the driver takes at most.
BLOCK, FAN_IN, MATRIX_BYTES = 256, 64, 512 << 20
#: A block: its numbers, rows, and for the columns of each side their means and own centred sums, then the sums of products.
BLOCKS = "bi int, bj int, part int, n long, mi binary, mj binary, si binary, sj binary, sxy binary"
NUMBERS = ("mi", "mj", "si", "sj", "sxy")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(idx, name, n, mean, var) of each column, population variance."""
    parts = [F.struct(F.lit(i).alias("idx"), F.lit(c).alias("name"), F.count("*").alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")) for i, c in enumerate(columns)]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def spans(p: int) -> list[tuple[int, int]]:
    """Blocks of BLOCK columns."""
    return [(k, min(k + BLOCK, p)) for k in range(0, p, BLOCK)]


def _merge(a: tuple | None, b: tuple) -> tuple:
    """(n, means and own sums of both sides, centred products) of two sets of rows."""
    if a is None:
        return b
    n = a[0] + b[0]
    w = a[0] * b[0] / n
    with np.errstate(all="ignore"):
        di, dj = b[1] - a[1], b[2] - a[2]
        return n, a[1] + di * (b[0] / n), a[2] + dj * (b[0] / n), a[3] + b[3] + di * di * w, a[4] + b[4] + dj * dj * w, a[5] + b[5] + np.outer(di, dj) * w


def _row(bi: int, bj: int, part: int, total: tuple) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 5
    values = [bi, bj, part, total[0], *(np.ascontiguousarray(v).tobytes() for v in total[1:])]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def _unpacked(x: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    for k in range(x.num_rows):
        mi, mj, si, sj, sxy = (np.frombuffer(x.column(c)[k].as_buffer()) for c in NUMBERS)
        yield x.column("bi")[k].as_py(), x.column("bj")[k].as_py(), (x.column("n")[k].as_py(), mi, mj, si, sj, sxy.reshape(len(mi), len(mj)))


def _add(total: dict[tuple[int, int], tuple], m: np.ndarray) -> None:
    """Adds the rows of a matrix to blocks."""
    if not len(m):
        return
    with np.errstate(all="ignore"):
        mean = m.mean(axis=0)
        m = m - mean
        own = (m * m).sum(axis=0)
        for bi, (a, b) in enumerate(cuts := spans(m.shape[1])):
            for bj, (c, d) in enumerate(cuts[bi:], bi):
                new = (len(m), mean[a:b], mean[c:d], own[a:b], own[c:d], m[:, a:b].T @ m[:, c:d])
                total[bi, bj] = _merge(total.get((bi, bj)), new)


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows to its blocks: centred by the task's own means, batch by batch."""
    total: dict[tuple[int, int], tuple] = {}
    for x in batches:
        _add(total, np.column_stack([c.to_numpy(zero_copy_only=False) for c in x.columns]))
    part = TaskContext.get().partitionId()
    for (bi, bj), t in total.items():
        yield _row(bi, bj, part, t)


def _merged(by_part: bool = False):
    """Parts sorted by block to one row for each block, or each block and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for x in batches:
            for (bi, bj, t), part in zip(_unpacked(x), x.column("part").to_pylist(), strict=True):
                key = (bi, bj, part if by_part else 0)
                if now is not None and key != now:
                    yield _row(*now, total)
                    total = None
                now, total = key, _merge(total, t)
        if now is not None:
            yield _row(*now, total)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged blocks to (n, i, j, sxy, sxx, syy) for i <= j."""
    for x in batches:
        for bi, bj, (n, _, _, si, sj, sxy) in _unpacked(x):
            i, j = np.triu_indices(len(si)) if bi == bj else (v.ravel() for v in np.indices(sxy.shape))
            cols = [np.full(len(i), n, np.int64), (i + bi * BLOCK).astype(np.int32), (j + bj * BLOCK).astype(np.int32), sxy[i, j], si[i], sj[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["n", "i", "j", "sxy", "sxx", "syy"])


def moment_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """The blocks (see BLOCKS), one row each, in one pass over the rows.

    n counts all rows; a column with a NULL or NaN has NaN for every sum it is in, others are not touched by it; an empty
    table gives no rows. Each task leaves one row a block. These are merged by block; of tables of many files first in
    groups of FAN_IN parts, so that what a task merges grows with neither the number of columns nor that of parts.
    """
    ship(df.sparkSession)
    at = [df.columns.index(c) for c in columns]
    named = df.toDF(*[f"x{k}" for k in range(len(df.columns))])  # by place: names may differ in case only
    parts = named.select([F.col(f"x{k}").cast("double").alias(f"v{i}") for i, k in enumerate(at)]).mapInArrow(_of_rows, BLOCKS)
    blocks = len(spans(len(columns)))
    if len(df.inputFiles()) > FAN_IN:
        group = F.floor(F.col("part") / FAN_IN).alias("g")
        parts = parts.repartition("bi", "bj", group).sortWithinPartitions("bi", "bj").mapInArrow(_merged(), BLOCKS)
    return parts.repartition(blocks * (blocks + 1) // 2, "bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_merged(), BLOCKS)


def _of_steps(steps: list[int]):
    """Rows (place, values) to the blocks of each thinning; part is the step's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[dict[tuple[int, int], tuple]] = [{} for _ in steps]
        for x in batches:
            place = np.asarray(x.column(0))
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in x.columns[1:]])
            for blocks, step in zip(total, steps, strict=True):
                _add(blocks, m[place % step == 0])
        for k, blocks in enumerate(total):
            for (bi, bj), t in blocks.items():
                yield _row(bi, bj, k, t)

    return run


def thinned_blocks(df: DataFrame, place: str, columns: list[str], steps: list[int]) -> DataFrame:
    """The blocks of every step-th row by a column of places from 0, for all steps in one pass; part: the step's number."""
    ship(df.sparkSession)
    at = [df.columns.index(c) for c in (place, *columns)]
    named = df.toDF(*[f"x{k}" for k in range(len(df.columns))])
    values = [F.col(f"x{k}").cast("double" if i else "long").alias(f"v{i}") for i, k in enumerate(at)]
    keys, blocks = ["bi", "bj", "part"], len(spans(len(columns)))
    parts = named.select(values).mapInArrow(_of_steps(steps), BLOCKS)
    return parts.repartition(len(steps) * blocks * (blocks + 1) // 2, *keys).sortWithinPartitions(*keys).mapInArrow(_merged(True), BLOCKS)


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, i, j, sxy, sxx, syy) for i <= j: centred sums of products, and those of each column with itself. See moment_blocks."""
    return moment_blocks(df, columns).mapInArrow(_pairs, "n long, i int, j int, sxy double, sxx double, syy double")


def correlations(stats: DataFrame) -> DataFrame:
    """(n, i, j, r) for i < j from moments."""
    return stats.where("i < j").select("n", "i", "j", guarded_corr(F.col("n"), F.col("sxx"), F.col("syy"), F.col("sxy")).alias("r"))


@dataclass
class Correlations:
    """The p x p matrix and the number of rows."""

    n: int
    names: list[str]
    r: np.ndarray

    @property
    def p(self) -> int:
        return len(self.names)


def from_blocks(blocks: pa.Table, names: list[str]) -> Correlations:
    """The matrix of one table's merged blocks."""
    p, n = len(names), 0
    r, norm = np.zeros((p, p)), np.zeros(p)
    for x in blocks.to_batches():
        for bi, bj, (rows, _, _, si, sj, sxy) in _unpacked(x):
            n, i, j = rows, slice(bi * BLOCK, bi * BLOCK + len(si)), slice(bj * BLOCK, bj * BLOCK + len(sj))
            r[i, j], r[j, i] = sxy, sxy.T
            norm[i], norm[j] = np.sqrt(si), np.sqrt(sj)
    with np.errstate(all="ignore"):
        norms = np.outer(norm, norm)
        r = np.clip(r / norms, -0.999999999, 0.999999999)
    r[(norms <= 1e-8) | (n < 2)] = 0.0
    return Correlations(n, list(names), r)


def correlation_matrix(df: DataFrame, columns: list[str]) -> Correlations:
    """The matrix on the driver, which takes one of at most MATRIX_BYTES (8,192 columns); wider tables have moments()."""
    if 8 * len(columns) ** 2 > MATRIX_BYTES:
        raise ValueError(f"A matrix of {len(columns)} columns is over {MATRIX_BYTES} bytes; moments() and correlations() give it as a table")
    return from_blocks(moment_blocks(df, columns).toArrow(), columns)
