"""Embedding near dedup by an epsilon grid order join (operator 4).

Unit vectors with cosine >= c are at most eps = sqrt(2 - 2c) apart, and no farther on their leading principal dimensions.
Vectors are put in the order of their grid cells (side eps) on these and cut into intervals of the sequence. Intervals are
joined by halving both sequences until a part is provably distant or a leaf; the rows of a leaf that have a partner within
eps by their coordinates, a byte for each dimension, are then compared by their whole vectors. Whole vectors move for
those rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, groups_by_key, prepare, salted, salts_of, temporary, trimmed
from .components import components, forest

#: Leading principal dimensions, those of them that order the vectors; steps of a coordinate from 0 to 1.
AXES, ORDERING, STEPS = 32, 6, 127
#: Intervals that the sequence is cut into, but that none has over MOST_ROWS; rows of a leaf; bytes of coordinates that are broadcast at most.
INTERVALS, MOST_ROWS, LEAF, BROADCAST = 24, 1 << 17, 512, 48 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_dim_raw(dims: np.ndarray, raw: pa.Array, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors as doubles) for each length of vector."""
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield at, np.frombuffer(b"".join(raw[int(k)].as_buffer() for k in at), dtype).reshape(len(at), dim).astype(np.float64)


def by_dim(dims: np.ndarray, raw: pa.Array, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector."""
    for at, x in by_dim_raw(dims, raw, dtype):
        yield at, _unit(x)


def _valid(dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that are not null, zero, or hold null or non-finite components, as bytes (-0.0 as 0.0)."""
        for x in batches:
            ids, dims, raw = [], [], []
            for i, v in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                if not v.is_valid or not len(v) or v.values.null_count:
                    continue
                a = v.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)
                if np.isfinite(a).all() and a.any():
                    ids.append(i), dims.append(len(a)), raw.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "raw"])

    return run


def _times(basis: np.ndarray, dtype):
    """Each task's part of C b, where C is the sum of u u' over the unit vectors u, of any length up to the basis's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for x in batches:
            for _, u in by_dim(np.asarray(x.column("dim")), x.column("raw"), dtype):
                total[: u.shape[1]] += u.T @ (u @ basis[: u.shape[1]])
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def principal_axes(vectors: DataFrame, dim: int, dtype) -> np.ndarray:
    """Orthonormal columns near the leading principal dimensions, by two rounds of subspace iteration from a fixed start:
    dim * AXES sums reach the driver in each. Any orthonormal columns give right results; these prune well."""
    basis = np.linalg.qr(np.random.RandomState(17).normal(size=(dim, min(AXES, dim))))[0]
    for last in (False, True):
        y = np.zeros(basis.shape)
        for i, j, v in vectors.mapInArrow(trimmed(_times(basis, dtype), 4096), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
            y[i, j] = v
        if last:
            return basis @ np.linalg.eigh(basis.T @ y)[1][:, ::-1]
        basis = np.linalg.qr(y + 1e-12 * basis)[0]
    return basis


def _placed(axes: np.ndarray, eps: float, dtype):
    """Vectors to coordinates of a byte each, and the cells on the ordering axes."""
    names = [f"c{k}" for k in range(min(ORDERING, axes.shape[1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            q = np.zeros((x.num_rows, axes.shape[1]))
            for at, u in by_dim(np.asarray(x.column("dim")), x.column("raw"), dtype):
                q[at] = u @ axes[: u.shape[1]]
            cells = np.floor(q[:, : len(names)] / eps).astype(np.int32)
            q8 = np.rint(q * STEPS).astype(np.int8)
            yield pa.RecordBatch.from_arrays([x.column("node"), x.column("dim"), pa.array([r.tobytes() for r in q8], pa.binary()), *(pa.array(v) for v in cells.T)], ["node", "dim", "q", *names])

    return run, "node long, dim int, q binary, " + ", ".join(f"{c} int" for c in names), names


INTERVAL = "block long, dim int, nodes binary, q binary, lo array<int>, hi array<int>, cells array<long>"


def _intervals(rows: int, axes: int, eps: float):
    """Rows in order to intervals of one length of vector: nodes, coordinates, their bounds, cells on the first two axes."""

    def interval(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        raw = b"".join(v.as_buffer() for v in t.column("q"))
        q = np.frombuffer(raw, np.int8).reshape(-1, axes)
        first = [np.asarray(t.column(f"c{k}"), np.int64) for k in range(min(2, axes))]
        cells = np.unique(first[0] * (1 << 20) + (first[1] if len(first) > 1 else 0))
        values = [int(t.column("node")[0].as_py()), int(t.column("dim")[0].as_py()), np.asarray(t.column("node"), np.int64).tobytes(), raw, q.min(axis=0).tolist(), q.max(axis=0).tolist(), cells.tolist()]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in INTERVAL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            dims = np.asarray(x.column("dim"))
            for a, b in zip([0, *(np.flatnonzero(np.diff(dims)) + 1).tolist()], [*(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)], strict=True):
                part = x.slice(a, b - a)
                while part.num_rows:
                    if held and (size == rows or held[0].column("dim")[0] != part.column("dim")[0]):
                        yield interval(held)
                        held, size = [], 0
                    held.append(part.slice(0, rows - size))
                    size += held[-1].num_rows
                    part = part.slice(held[-1].num_rows)
        if held:
            yield interval(held)

    return run


def reach(eps: float, axes: int) -> float:
    """The most steps that the rounded coordinates of two vectors within eps are apart."""
    return float(STEPS * eps * (1 + 1e-9) + np.sqrt(axes) + 1e-3)


def near_leaves(qa: np.ndarray, qb: np.ndarray, most: float, same: bool, leaf: int = LEAF, seen: list[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, mask): the leaves, by their first rows, of two sequences of coordinates that hold pairs up to `most` apart, and
    which pairs these are. Both sequences are halved until two parts are provably distant, or leaves. With same, only
    pairs whose second row comes later. seen: gets the number of pairs that were compared by their coordinates."""
    begins = [np.arange(0, len(q), leaf) for q in (qa, qb)]
    low = [np.minimum.reduceat(q, b, axis=0) for q, b in zip((qa, qb), begins, strict=True)]
    high = [np.maximum.reduceat(q, b, axis=0) for q, b in zip((qa, qb), begins, strict=True)]
    fa, fb = qa.astype(np.float32), qb.astype(np.float32)
    na, nb = (fa * fa).sum(axis=1), (fb * fb).sum(axis=1)
    todo = [(0, len(begins[0]), 0, len(begins[1]))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        up = low[0][a0:a1].min(axis=0).astype(np.float64) - high[1][b0:b1].max(axis=0)
        down = low[1][b0:b1].min(axis=0).astype(np.float64) - high[0][a0:a1].max(axis=0)
        gap = np.maximum(0, np.maximum(up, down))
        if (gap * gap).sum() > most * most:
            continue  # provably distant
        if a1 - a0 > 1 or b1 - b0 > 1:
            if a1 - a0 >= b1 - b0:
                half = (a0 + a1) // 2
                todo += [(a0, half, b0, b1), (half, a1, b0, b1)]
            else:
                half = (b0 + b1) // 2
                todo += [(a0, a1, b0, half), (a0, a1, half, b1)]
            continue
        i, j = a0 * leaf, b0 * leaf
        apart = na[i : i + leaf, None] + nb[None, j : j + leaf] - 2 * (fa[i : i + leaf] @ fb[j : j + leaf].T)
        if seen is not None:
            seen.append(apart.size)
        mask = apart <= most * most
        if same and i == j:
            mask = np.triu(mask, 1)
        if mask.any():
            yield i, j, mask


NEEDED = "a long, b long, i int, j int, side int, node long"


def _needed(axes: int, eps: float):
    """Of each pair of intervals, the rows of its leaves that have to be compared; side 2 if both leaves are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                a, b = x.column("a")[k].as_py(), x.column("b")[k].as_py()
                ia, ib = (np.frombuffer(x.column(n)[k].as_buffer(), np.int64) for n in ("a_nodes", "b_nodes"))
                qa, qb = (np.frombuffer(x.column(n)[k].as_buffer(), np.int8).reshape(-1, axes) for n in ("a_q", "b_q"))
                for i, j, mask in near_leaves(qa, qb, reach(eps, axes), a == b):
                    rows, cols = ia[i : i + LEAF][mask.any(axis=1)], ib[j : j + LEAF][mask.any(axis=0)]
                    sides = [(2, np.union1d(rows, cols))] if a == b and i == j else [(0, rows), (1, cols)]
                    n = sum(len(v) for _, v in sides)
                    full = [np.full(n, v, t) for v, t in ((a, np.int64), (b, np.int64), (i, np.int32), (j, np.int32))]
                    side = np.concatenate([np.full(len(v), s, np.int32) for s, v in sides])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*full, side, np.concatenate([v for _, v in sides]))], [c.split()[0] for c in NEEDED.split(", ")])

    return run


def _compare(cosine: float, dtype):
    """Rows sorted by leaf pair and side: (node, null, number of links) and a forest (a, b, null) of the links."""

    def one(key, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        side, node, n = (np.asarray(t.column(c), np.int64) for c in ("side", "node", "n"))
        dim = t.column("dim")[0].as_py()
        u = _unit(np.frombuffer(b"".join(v.as_buffer() for v in t.column("raw")), dtype).reshape(-1, dim))
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        near = u[a] @ u[b].T >= cosine
        if side[0] == 2:
            near = np.triu(near, 1)
        if not near.any():
            return None
        counts = np.zeros(len(u), np.int64)
        counts[a] += near @ n[b]
        counts[b] += near.T @ n[a]
        i, j = np.nonzero(near)
        x, y = forest(node[a[i]], node[b[j]])
        has = counts > 0
        nulls = lambda m: pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[has], x])), pa.concat_arrays([nulls(int(has.sum())), pa.array(y)]), pa.concat_arrays([pa.array(counts[has]), nulls(len(x))])], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for x in batches:
            keys = np.array([x.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "i", "j")], np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), x.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[:, begin].tolist())
                if held and key != now:
                    if (found := one(now, held)) is not None:
                        yield found
                    held = []
                now = key
                held.append(x.slice(begin, end - begin))
        if held and (found := one(now, held)) is not None:
            yield found

    return run


def grid_join(vectors: DataFrame, cosine: float, dtype, interval_rows: int | None = None) -> DataFrame:
    """(a, b, n) over distinct vectors (node, dim, n, raw): n links at a where b is null, else an edge of a forest of the links."""
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    total, dim = vectors.agg(F.count("*"), F.max("dim")).first()
    if not total:
        return spark.createDataFrame([], "a long, b long, n long")
    axes = principal_axes(vectors, dim, dtype)
    k = axes.shape[1]
    rows = interval_rows or min(MOST_ROWS, max(2 * LEAF, -(-total // INTERVALS)))
    run, schema, names = _placed(axes, eps, dtype)
    keys = ["dim", *names, "node"]
    ordered = vectors.select("node", "dim", "raw").mapInArrow(trimmed(run, 4096), schema).repartitionByRange(-(-total // rows), *keys).sortWithinPartitions(*keys)
    blocks = cut(ordered.mapInArrow(trimmed(_intervals(rows, k, eps), 4096), INTERVAL), "intervals")
    near_cells = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.array(*[c + (i << 20) + j for i in (-1, 0, 1) for j in (-1, 0, 1)]))))
    left = blocks.select("dim", F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode("cells").alias("cell"))
    right = blocks.select("dim", F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(near_cells).alias("cell"))
    gap = "aggregate(sequence(0, size(alo) - 1), 0D, (s, k) -> s + power(greatest(0, alo[k] - bhi[k], blo[k] - ahi[k]), 2))"
    pairs = cut(left.join(right, ["dim", "cell"]).where("a <= b").where(f"{gap} <= {reach(eps, k) ** 2!r}").select("a", "b").distinct(), "pairs")
    side = lambda s: blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("nodes", "q")))
    few = F.broadcast if total * (k + 8) <= BROADCAST else (lambda df: df)
    work = pairs.repartition("a", "b").join(few(side("a")), "a").join(few(side("b")), "b")
    if few is not F.broadcast:
        work = work.repartition("a", "b")
    needed = cut(work.select("a", "b", "a_nodes", "a_q", "b_nodes", "b_q").mapInArrow(trimmed(_needed(k, eps), 4), NEEDED), "needed")
    cell = ["a", "b", "i", "j"]
    whole = needed.join(vectors.select("node", "dim", "n", "raw"), "node").repartition(*cell).sortWithinPartitions(*cell, "side", "node")
    return cut(whole.select(*cell, "side", "node", "dim", "n", "raw").mapInArrow(trimmed(_compare(cosine, dtype), 4096), "a long, b long, n long"), "joined")


def near_vectors(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", interval_rows: int | None = None) -> DataFrame:
    """One row per row of table: id, n_links (other rows' vectors with cosine >= the threshold, in double precision),
    component_id (least id reachable by links), kept.

    Equal vectors are one row of the join with their number; links between others are counted where they are found
    and only a forest of them leaves a task. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths; repeated rows count each. Links are between rows' vectors, not
    ids: a repeated id has, at each of its vectors, that vector's links and component. Null ids are left out of the least; a
    component of null ids only has a null component_id and its rows are kept. Empty tables give no rows; other columns
    are not looked at.
    """
    spark = table.sparkSession
    prepare(spark)
    dtype = np.float32 if dict(table.dtypes)[vec_col] == "array<float>" else np.float64
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if dtype is np.float32 else "array<double>").alias("v"))
    with temporary(spark):
        valid = cut(salted(rows.mapInArrow(trimmed(_valid(dtype), 4096), "id long, dim int, raw binary").withColumn("key", F.struct("dim", "raw")).select("id", "key"), "id"), "valid")
        by_salt = valid.groupBy("key", "_salt").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        classes = by_salt.groupBy("key").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("mask"))
        nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so that numbers stay
        joined = grid_join(nodes.select("node", "key.dim", "n", "key.raw"), cosine, dtype, interval_rows)
        links = joined.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        comps = components(joined.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
        least = groups_by_key(nodes.join(comps, "node"), "component", "node", "min", "rep").select("node", F.col("picked").alias("reached"), F.lit(True).alias("found"))
        named = nodes.join(links, "node", "left").join(least, "node", "left")
        at = F.when(F.col("found"), F.col("reached")).otherwise(F.col("rep"))
        known = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), at.alias("component_id"), F.explode(salts_of("mask")).alias("_salt"))
        linked = cut(valid.join(known, ["key", "_salt"]).select("id", "n_links", "component_id"), "linked", keep=True)
    usable = F.size("v") > 0
    usable = F.coalesce(usable & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS m FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, k.m AS component_id, k.m = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN k ON k.a = vec_id
"""
