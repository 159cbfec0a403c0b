"""Approximate nearest neighbours by learned partitions (operator 13).

The neighbour graph of a bounded sample is cut into parts of equal size, by bisections that leave few edges across. A small
classifier learns which parts a vector's neighbours are in. Every row goes to its most probable part; a query goes to its
most probable parts until these hold `mass` of the probability, and is compared there with every row by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, temporary, trimmed
from .embedding import _valid, by_dim_raw

#: Distinct vectors that the index is fitted on, at most; neighbours of each in the graph; most parts, and rows a part is meant for.
SAMPLE, GRAPH, MOST_PARTS, PART_ROWS = 8192, 20, 128, 1024
#: Units of the classifier's hidden layer, passes of its training; bytes of a block of vectors as doubles; queries held against one at once.
HIDDEN, EPOCHS, BLOCK_BYTES, TOGETHER = 128, 40, 32 << 20, 64
#: Share of a query's neighbours that the classifier expects in the parts searched.
MASS = 0.95


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    norms, out = (x * x).sum(axis=1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        rows = np.arange(at, min(at + 1024, len(x)))
        d = norms[rows, None] + norms - 2 * x[rows] @ x.T
        d[rows - at, rows] = np.inf
        out[rows] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(x: np.ndarray, ends: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Two halves of equal size: along the direction of most variance, then by swaps of the rows that have more neighbours
    on the other side, as long as fewer edges cross."""
    n, u = len(x), x - x.mean(axis=0)
    v = rng.normal(size=x.shape[1])
    for _ in range(20):
        v = u.T @ (u @ v)
        v /= max(np.sqrt(v @ v), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(u @ v, kind="stable")[n // 2 :]] = True
    a, b = np.concatenate(ends), np.concatenate(ends[::-1])
    best, least = side, np.inf
    for _ in range(30):
        crossing = side[a] != side[b]
        if crossing.sum() < least:
            best, least = side, crossing.sum()
        gain = np.bincount(a, np.where(crossing, 1.0, -1.0), minlength=n)
        one, two = (r[np.argsort(-gain[r], kind="stable")] for r in (np.flatnonzero(side), np.flatnonzero(~side)))
        m = min(len(one), len(two))
        swaps = int((gain[one[:m]] + gain[two[:m]] > 0).sum())
        if not swaps:
            break
        taken = rng.random((swaps + 1) // 2) < 0.7  # not all at once: swapped rows are neighbours of each other
        side = side.copy()
        side[one[: len(taken)][taken]] = False
        side[two[: len(taken)][taken]] = True
    return best


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """The part, of `parts` (a power of two) of equal size, of each row."""
    label, level = np.zeros(len(x), np.int64), 1
    while level < parts:
        new = 2 * label
        for part in range(level):
            own = np.flatnonzero(label == part)
            place = np.full(len(x), -1)
            place[own] = np.arange(len(own))
            a, b = np.repeat(np.arange(len(own)), graph.shape[1]), place[graph[own]].ravel()
            new[own] += _halves(x[own], (a[b >= 0], b[b >= 0]), rng)
        label, level = new, 2 * level
    return label


@dataclass
class Router:
    """A network of one hidden layer: vectors of one length to the probabilities of the parts."""

    mean: np.ndarray
    scale: float
    layers: list[np.ndarray]

    @property
    def parts(self) -> int:
        return len(self.layers[3])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_router(x: np.ndarray, total: int) -> Router:
    """Parts of the sample's neighbour graph, and the classifier that learns in which parts each row's neighbours are."""
    rng = np.random.default_rng(23)
    mean = x.mean(axis=0)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) or 1.0
    u = (x - mean) / scale
    parts, wanted = 1, min(MOST_PARTS, max(4, total // PART_ROWS), len(x) // 32)
    while 2 * parts <= wanted:
        parts *= 2
    k = min(GRAPH, len(x) - 1)
    soft = np.ones((len(x), 1))
    if parts > 1:
        graph = neighbour_graph(u, k)
        label = balanced_parts(u, graph, parts, rng)
        soft = np.zeros((len(x), parts))
        np.add.at(soft, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 1 / k)
    dim = x.shape[1]
    layers = [rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    for epoch in range(EPOCHS if parts > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            z = u[rows] @ layers[0] + layers[1]
            h = np.maximum(z, 0)
            o = h @ layers[2] + layers[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - soft[rows]) / len(rows)
            gh = (g @ layers[2].T) * (z > 0)
            step += 1
            for n, grad in enumerate((u[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad * grad
                layers[n] -= 3e-3 * (1 - epoch / EPOCHS) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, layers)


def sample_of(valid: DataFrame, dim: int, total: int, dtype, most: int = SAMPLE) -> np.ndarray:
    """About `most` distinct vectors of this length, those of the least hashes, at most twice as many: the hash bound is
    raised fourfold until they are enough or all, and copies are one before anything leaves a task."""
    rows = valid.where(F.col("dim") == dim).withColumn("h", F.xxhash64("raw"))
    share = (most + 6 * most**0.5 + 16) / total
    while True:
        edge = (1 << 63) - 1 if share >= 1 else int(share * 2**64) - (1 << 63)
        got = rows.where(F.col("h") <= edge).select("h", "raw").distinct().limit(2 * most).toArrow()
        if got.num_rows >= most or share >= 1:
            break
        share *= 4
    h, raw = got.column("h").to_pylist(), got.column("raw").to_pylist()
    order = sorted(range(len(raw)), key=lambda k: (h[k], raw[k]))[:most]
    return np.frombuffer(b"".join(raw[k] for k in order), dtype).reshape(len(order), dim).astype(np.float64)


def _parted(router: Router, dim: int, dtype):
    """(id, dim, raw) with the most probable part; -1 for other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            part = np.full(x.num_rows, -1, np.int32)
            for at, v in by_dim_raw(np.asarray(x.column("dim")), x.column("raw"), dtype):
                if v.shape[1] == dim:
                    part[at] = router.probabilities(v).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("id", "dim", "raw")), pa.array(part)], ["id", "dim", "raw", "part"])

    return run


def _routed(router: Router, dim: int, dtype, mass: float):
    """Queries (node, id, dim, raw) to the parts in which they are searched, the most probable first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            parts = [np.array([-1], np.int32)] * x.num_rows
            for at, v in by_dim_raw(np.asarray(x.column("dim")), x.column("raw"), dtype):
                if v.shape[1] == dim:
                    p = router.probabilities(v)
                    order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
                    before = np.cumsum(np.take_along_axis(p, order.astype(np.int64), 1), axis=1)
                    n = np.minimum((before < mass).sum(axis=1) + 1, router.parts)
                    for k, row in enumerate(at.tolist()):
                        parts[row] = order[k, : n[k]]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("node", "id", "dim", "raw")), pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))], ["node", "id", "dim", "raw", "parts"])

    return run


FOUND = "node long, query_id long, vec_id long, score double"


def _search(k: int, dtype):
    """Rows sorted by cell, and in it vectors (node null) before queries: the k nearest vectors of each query in each cell."""

    def one(vectors: np.ndarray, ids: pa.Array, node: np.ndarray, own: np.ndarray, q: np.ndarray) -> pa.RecordBatch | None:
        number, known = np.asarray(ids.fill_null(0)), ~np.asarray(ids.is_null())
        top = max(np.abs(vectors).max(), np.abs(q).max(), 1e-300)
        a, b = vectors / top, q / top
        d = (b * b).sum(axis=1)[:, None] + (a * a).sum(axis=1) - 2 * b @ a.T
        d[(number[None, :] == own[:, None]) & known[None, :]] = np.inf
        few = min(k, len(a)) - 1
        limit = np.partition(d, few, axis=1)[:, few] + 1e-11 * a.shape[1]  # more than the products' rounding: ties stay in
        out = []
        for n in range(len(q)):
            at = np.flatnonzero((d[n] <= limit[n]) & np.isfinite(d[n]))
            diff = vectors[at] - q[n]
            score = np.sqrt((diff * diff).sum(axis=1))
            best = np.lexsort((number[at], ~known[at], score))[:k]
            out.append((np.full(len(best), n), at[best], score[best]))
        rows, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(own[rows]), ids.take(pa.array(at)), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, ids, matrix = None, [], [], None
        for x in batches:
            if not x.num_rows:
                continue
            keys = np.array([x.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "part", "block", "kind")], np.int64)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist(), x.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                cell, kind = tuple(keys[:3, begin].tolist()), keys[3, begin]
                if cell != now:
                    now, raw, ids, matrix = cell, [], [], None
                part = x.slice(begin, end - begin)
                values = np.frombuffer(b"".join(v.as_buffer() for v in part.column("raw")), dtype).reshape(part.num_rows, cell[0])
                if kind == 0:
                    raw.append(values), ids.append(part.column("id"))
                    continue
                if not raw:
                    continue
                if matrix is None:
                    matrix, ids = np.concatenate(raw).astype(np.float64), [pa.concat_arrays(ids)]
                node, own = (np.asarray(part.column(c)) for c in ("node", "id"))
                for s in range(0, part.num_rows, TOGETHER):
                    w = slice(s, s + TOGETHER)
                    yield one(matrix, ids[0], node[w], own[w], values[w].astype(np.float64))

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 10, mass: float = MASS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of table where is_query holds, the k nearest other rows found,
    by Euclidean distance in double precision, ties to the smaller id, null ids last.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or rows; a query has
    a non-null id, and rows of its own id aren't its neighbours. Repeated rows count each as neighbours; queries of one id
    and vector are one query, of one id and several vectors a query each. The index is fitted on about SAMPLE distinct
    vectors of the most frequent length; vectors of other lengths meet their like only, all of them. Every row is in
    the index. A part is cut into blocks by size, so that no task holds more than a block, and a part with a third of all
    rows is many blocks. Empty tables give no rows; other columns are not looked at.
    """
    spark = table.sparkSession
    prepare(spark)
    dtype = np.float32 if dict(table.dtypes)[vec_col] == "array<float>" else np.float64
    own, vec = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if dtype is np.float32 else "array<double>").alias("v")
    read = lambda df: df.select(own, vec).mapInArrow(trimmed(_valid(dtype), 4096), "id long, dim int, raw binary")
    with temporary(spark):
        valid = read(table)
        lengths = valid.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
        if lengths is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        dim, total = lengths
        router = fit_router(sample_of(valid, dim, total, dtype), total)
        rows = cut(valid.mapInArrow(trimmed(_parted(router, dim, dtype), 4096), "id long, dim int, raw binary, part int"), "parts")
        queries = cut(read(table.where(is_query)).where("id is not null").distinct().withColumn("node", F.monotonically_increasing_id()), "queries")  # written, so that numbers stay
        sizes = rows.groupBy("dim", "part").count()
        block_rows = lambda d: F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES // 8) / d))
        counted = sizes.withColumn("blocks", F.ceil(F.col("count") / block_rows(F.col("dim"))).cast("int"))
        of_part = dict(tuple(r) for r in counted.where(F.col("part") >= 0).select("part", "blocks").collect())  # at most MOST_PARTS rows
        other = counted.where("part < 0").agg(F.max("blocks")).first()[0] or 1
        blocks = F.when(F.col("part") < 0, F.lit(other)).otherwise(F.get(F.array(*[F.lit(of_part.get(p, 0)) for p in range(router.parts)]), F.col("part")))
        cell = ["dim", "part", "block", "kind"]
        placed = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), blocks).cast("int"))  # by place: copies spread too
        left = placed.select(*cell[:3], F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"), "id", "raw")
        routed = queries.mapInArrow(trimmed(_routed(router, dim, dtype, mass), 4096), "node long, id long, dim int, raw binary, parts array<int>")
        sent = routed.withColumn("part", F.explode("parts")).withColumn("block", F.explode(F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))))
        right = sent.select(*cell[:3], F.lit(1).alias("kind"), "node", "id", "raw")
        meet = left.unionByName(right).repartition("dim", "part", "block").sortWithinPartitions(*cell)
        found = meet.mapInArrow(trimmed(_search(k, dtype), 4096), FOUND)
        order = Window.partitionBy("node").orderBy("score", F.col("vec_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return cut(best.select("query_id", "rank", "vec_id", "score"), "nearest", keep=True)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
