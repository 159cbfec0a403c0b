"""Skeleton search by levels of conditioning-set size.

A verdict depends on the data only; whether it is consulted depends on what earlier verdicts removed, in the lexicographic
order (i, j, S). A level goes in waves: each takes the next sets of every pair that is still open, as equal ranges of
candidate numbers over all tasks, and leaves the independent ones. These are settled in rounds: a pair falls to its
first set that stands (none of its edges fell before, in the order) once no earlier set of it hangs on an open pair. A pair
that has fallen, or can't any more, isn't tested further. What meets at the driver is of the size of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import TINY, ci_test, critical_z
from ..sources.shared import cut, ship, temporary
from .candidates import Level, numbered
from .moments import MATRIX_BYTES, Correlations

#: Tests of a level's first wave, at least one a pair; how much longer each further wave of a pair is.
FIRST_WAVE, GROWTH = 1 << 17, 4
#: Fewest and most tests of a task; tests held at once in it; most rows that a wave brings to the driver.
LEAST_TASK, MOST_TASK, TOGETHER, LOCAL = 1 << 12, 1 << 20, 1 << 15, 1 << 20
#: Pairs of a set from which on the set is eliminated once for all of them.
SHARED = 24
OPEN, FALLEN, STANDS = 0, 1, 2
NEVER = np.iinfo(np.int64).max


def pair_grid(spark: SparkSession, p: int) -> DataFrame:
    """All (i, j) with i < j."""
    v = spark.range(p).select(F.col("id").cast("int").alias("i"))
    return v.join(v.select(F.col("i").alias("j")), F.col("i") < F.col("j"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(i, nbrs): sorted neighbours; nodes without any have no row."""
    return symmetric(edges).groupBy("i").agg(F.array_sort(F.collect_set("j")).alias("nbrs"))


def adjacency_matrix(edges: DataFrame) -> np.ndarray:
    """Symmetric booleans of edges (i, j) on the driver; the number of nodes is checked first."""
    p = (edges.agg(F.max(F.greatest("i", "j"))).first()[0] or 0) + 1
    if p * p > MATRIX_BYTES:
        raise ValueError(f"A graph of {p} nodes is over {MATRIX_BYTES} bytes")
    found = edges.select("i", "j").distinct().toArrow()
    out = np.zeros((p, p), bool)
    i, j = (np.asarray(found.column(c), np.int64) for c in ("i", "j"))
    out[i, j] = out[j, i] = True
    return out


def tasks_of(total: int, cores: int) -> list[tuple[int, int]]:
    """Equal ranges of the numbers 0 to total - 1: as many as cores if each gets LEAST_TASK, more if one would get over MOST_TASK."""
    n = max(1, min(cores, -(-total // LEAST_TASK)), -(-total // MOST_TASK))
    cuts = [total * t // n for t in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def over_ranges(spark: SparkSession, total: int, run, schema: str) -> DataFrame:
    """run(low, high), batches of rows, over equal ranges of numbers, one a task."""
    ranges = tasks_of(total, spark.sparkContext.defaultParallelism)
    ship(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for t in x.column(0).to_pylist():
                yield from run(*ranges[t])

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(each, schema)


def _lists(s: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of int."""
    if not s.shape[1]:
        return pa.array([[]] * len(s), pa.list_(pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel().astype(np.int32)))


def candidates(edges: DataFrame, k: int, sides: str = "first") -> DataFrame:
    """(i, j, s): sets of k neighbours of i besides j; with sides="both" also of j. Each task makes its own, by their numbers."""
    adjacent = adjacency_matrix(edges)
    level = Level.of(adjacent, k, sides)
    ends = np.cumsum(level.counts())
    begins = np.zeros(len(ends), np.int64)

    def run(low: int, high: int) -> Iterator[pa.RecordBatch]:
        for at in range(low, high, TOGETHER):
            pair, rank = numbered(ends, begins, at, min(at + TOGETHER, high))
            s = level.sets(pair, rank)
            i, j, base = level.i[pair], level.j[pair], level.base[pair]
            once = (base == i) | ~adjacent[i[:, None], s].all(axis=1)  # a set of j's that is one of i's too stands there
            yield pa.RecordBatch.from_arrays([pa.array(i[once]), pa.array(j[once]), _lists(s[once])], ["i", "j", "s"])

    return over_ranges(edges.sparkSession, int(ends[-1]) if len(ends) else 0, run, "i int, j int, s array<int>")


def _step(xy: np.ndarray, xz: np.ndarray, yz: np.ndarray) -> np.ndarray:
    """Correlations of x and y, given one more variable z."""
    product = (1 - xz * xz) * (1 - yz * yz)
    denom = np.sqrt(np.where(np.isnan(product) | (product < 0), 0, product))
    small = denom <= TINY
    return np.where(small, 0.0, (xy - xz * yz) / np.where(small, 1, denom))


def eliminated(r: np.ndarray, ends: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Partial correlations of many pairs given one set: its variables are eliminated, one after the other, once for all
    nodes that occur."""
    nodes, place = np.unique(np.concatenate([ends.ravel(), s]), return_inverse=True)
    now = r[np.ix_(nodes, nodes)]
    for z in place[len(ends) * 2 :]:
        now = _step(now, now[:, z, None], now[None, z, :])
    at = place[: 2 * len(ends)].reshape(-1, 2)
    return now[at[:, 0], at[:, 1]]


def partial(r: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Partial correlations of each i and j given the set s of its row, one variable after the other.

    Sets that many pairs share are eliminated once for all of them. For the others stage t holds the correlations, given the
    first t variables, of all pairs of variables that later stages need. Both take the same steps in the same order.
    """
    k, out = s.shape[1], np.empty(len(i))
    rest = np.ones(len(i), bool)
    with np.errstate(all="ignore"):
        if k:
            key = s[:, 0]
            for t in range(1, k):
                key = key * r.shape[0] + s[:, t] if r.shape[0] ** k < 1 << 62 else np.unique(np.column_stack([key, s[:, t]]), axis=0, return_inverse=True)[1].ravel()
            _, of, size = np.unique(key, return_inverse=True, return_counts=True)
            if size.max(initial=0) >= SHARED * k:
                order = np.argsort(of, kind="stable")
                begins = np.concatenate([[0], np.cumsum(size)])
                for g in np.flatnonzero(size >= SHARED * k):
                    rows = order[begins[g] : begins[g + 1]]
                    ends = np.column_stack([i[rows], j[rows]])
                    if len(np.unique(ends)) ** 2 <= 8 * k * len(rows):  # else most of what is eliminated isn't asked for
                        out[rows] = eliminated(r, ends, s[rows[0]])
                        rest[rows] = False
        at = np.column_stack([i[rest], j[rest], s[rest]]).T.astype(np.int64)
        now = {(a, b): r[at[a], at[b]] for a in range(len(at)) for b in range(a + 1, len(at))}
        for z in range(2, len(at)):
            now = {(a, b): _step(v, now[a, z] if a < z else now[z, a], now[b, z] if b < z else now[z, b]) for (a, b), v in now.items() if z not in (a, b) and all(e < 2 or e > z for e in (a, b))}
        out[rest] = now[0, 1]
    return out


def partial_correlations(rows: DataFrame, matrix: Correlations) -> DataFrame:
    """rows (i, j, s), the sets of one size, with rho."""
    ship(rows.sparkSession)
    r = matrix.r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                i, j = (np.asarray(x.column(c), np.int64) for c in ("i", "j"))
                s = np.asarray(x.column("s").flatten(), np.int64).reshape(len(i), -1)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(partial(r, i, j, s))], ["i", "j", "s", "rho"])

    return rows.select("i", "j", "s").mapInArrow(run, "i int, j int, s array<int>, rho double")


def ci_tests(rows: DataFrame, matrix: Correlations, k: int, alpha: float, test: str = "fisher_z") -> DataFrame:
    """rows (i, j, s), sets of size k, with rho, z and the verdict indep."""
    z, indep = ci_test(test).columns(F.col("rho"), matrix.n, k, alpha)
    return partial_correlations(rows, matrix).withColumn("z", z).withColumn("indep", indep)


@dataclass
class Skeleton:
    """edges (i, j); separating sets (i, j, s, level); trace: (level, edges removed); work: for each level the pairs, its
    candidates, the tests made, waves of tests and rounds of settling."""

    edges: DataFrame
    sepset: DataFrame
    trace: list[tuple[int, int]]
    work: list[dict] = field(default_factory=list)


@dataclass
class _Run:
    """One search of several that share their tests: its critical value and its graph as it stands."""

    zc: float
    adjacent: np.ndarray
    going: bool = True
    trace: list[tuple[int, int]] = field(default_factory=list)
    sets: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=list)
    after: list[np.ndarray] = field(default_factory=list)


def _earlier(i: np.ndarray, j: np.ndarray, base: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether the edge of each member of a pair's set to the pair's base comes before the pair in the order."""
    return (np.minimum(base[:, None], s) < i[:, None]) | ((np.minimum(base[:, None], s) == i[:, None]) & (np.maximum(base[:, None], s) < j[:, None]))


def _tested(level: Level, ends: np.ndarray, begins: np.ndarray, r: np.ndarray, n: int, statistic, runs: list[tuple], stable: bool):
    """(pair, rank, bits) of the independent candidates of a range: bit a for each search a in which the candidate
    stands so far, and the number of tests made, as a row of a negative pair. runs: (critical value, the graph at the
    level's start, pairs that have fallen as p x p, pairs that are open) of each."""

    def run(low: int, high: int) -> Iterator[pa.RecordBatch]:
        tests, found = 0, [np.zeros(len(level.i), bool) for _ in runs]
        for at in range(low, high, TOGETHER):
            pair, rank = numbered(ends, begins, at, min(at + TOGETHER, high))
            s = level.sets(pair, rank)
            i, j, base = (v[pair].astype(np.int64) for v in (level.i, level.j, level.base))
            before = None if stable else _earlier(i, j, base, s)
            stands = np.zeros((len(runs), len(pair)), bool)
            for a, (_, graph, fallen, is_open) in enumerate(runs):
                ok = is_open[pair] & ~found[a][pair]
                ok[ok] = graph[base[ok][:, None], s[ok]].all(axis=1)
                if before is not None:
                    ok[ok] = ~(fallen[base[ok][:, None], s[ok]] & before[ok]).any(axis=1)
                stands[a] = ok
            asked = stands.any(axis=0)
            if not asked.any():
                continue
            tests += int(asked.sum())
            z = np.full(len(pair), np.nan)
            z[asked] = statistic(partial(r, i[asked], j[asked], s[asked]), n, level.k)
            bits = np.zeros(len(pair), np.int64)
            for a, (zc, *_) in enumerate(runs):
                yes = stands[a] & ~np.isnan(z) & (np.abs(z) <= zc)
                if stable:  # the pair's first set is all that counts
                    found[a][pair[yes]] = True
                bits |= yes.astype(np.int64) << a
            hit = np.flatnonzero(bits)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(pair[hit]), pa.array(rank[hit]), pa.array(bits[hit])], ["pair", "rank", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([tests]), pa.array([0])], ["pair", "rank", "bits"])

    return run


FOUND = "pair long, rank long, bits long"


def _firsts(level: Level, edge_of: np.ndarray, state: np.ndarray, pair: np.ndarray, rank: np.ndarray, bits: np.ndarray, stable: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each search and pair the least rank of a candidate that stands for sure, and of one that hangs on an open pair."""
    shape = (len(state), len(level.i))
    sure, maybe = np.full(shape, NEVER), np.full(shape, NEVER)
    for at in range(0, len(pair), TOGETHER):
        q, rk, b = (v[at : at + TOGETHER] for v in (pair, rank, bits))
        if not stable:
            s = level.sets(q, rk)
            i, j, base = (v[q].astype(np.int64) for v in (level.i, level.j, level.base))
            before, member = _earlier(i, j, base, s), edge_of[base[:, None], s]
        for a in range(len(state)):
            on = ((b >> a) & 1).astype(bool) & (state[a, q] == OPEN)
            if stable:
                np.minimum.at(sure[a], q[on], rk[on])
                continue
            of = np.where(before & (member >= 0), state[a][member], STANDS)
            fell, hangs = (of == FALLEN).any(axis=1), (of == OPEN).any(axis=1)
            np.minimum.at(sure[a], q[on & ~fell & ~hangs], rk[on & ~fell & ~hangs])
            np.minimum.at(maybe[a], q[on & ~fell & hangs], rk[on & ~fell & hangs])
    return sure, maybe


def _firsts_of_table(table: DataFrame, level: Level, edge_of: np.ndarray, state: np.ndarray, stable: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same over a table of candidates: each task sends one row a search and pair at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sure, maybe = _firsts(level, edge_of, state, *(np.asarray(x.column(c)) for c in ("pair", "rank", "bits")), stable)
            a, q = np.nonzero((sure != NEVER) | (maybe != NEVER))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(q), pa.array(sure[a, q]), pa.array(maybe[a, q])], ["a", "q", "sure", "maybe"])

    got = table.mapInArrow(run, "a long, q long, sure long, maybe long").groupBy("a", "q").agg(F.min("sure").alias("sure"), F.min("maybe").alias("maybe")).toArrow()
    sure, maybe = (np.full((len(state), len(level.i)), NEVER) for _ in range(2))
    at = tuple(np.asarray(got.column(c)) for c in ("a", "q"))
    sure[at], maybe[at] = np.asarray(got.column("sure")), np.asarray(got.column("maybe"))
    return sure, maybe


def _level(spark: SparkSession, level: Level, shared, n: int, statistic, runs: list[_Run], stable: bool, local: int) -> dict:
    """Settles a level in each search; returns its work. The graphs of the searches are changed."""
    count, p = level.counts(), runs[0].adjacent.shape[0]
    state = np.array([np.where(x.adjacent[level.i, level.j] & (count > 0) & x.going, OPEN, STANDS) for x in runs], np.int8)
    start, fell = [x.adjacent.copy() for x in runs], np.full((len(runs), len(level.i)), NEVER)
    edge_of = np.full((p, p), -1, np.int32)
    edge_of[level.i, level.j] = edge_of[level.j, level.i] = np.arange(len(level.i), dtype=np.int32)
    done = np.zeros(len(level.i), np.int64)
    length = np.full(len(level.i), max(1, FIRST_WAVE // max(1, len(level.i))), np.int64)
    work = {"level": level.k, "pairs": int((state == OPEN).any(axis=0).sum()), "candidates": int(np.minimum(count, NEVER >> 20).sum()), "tests": 0, "waves": 0, "rounds": 0}
    near: list[np.ndarray] = []
    tables: list[DataFrame] = []
    asking = (state == OPEN).any(axis=0)
    while asking.any():
        upto = np.where(asking, np.minimum(count, done + length), done)
        ends, begins, total = np.cumsum(upto - done), done.copy(), int((upto - done).sum())
        parts = [(x.zc, start[a], _fallen(level, state[a], p), state[a] == OPEN) for a, x in enumerate(runs)]
        r = shared

        def run(low: int, high: int, args=(level, ends, begins), parts=parts) -> Iterator[pa.RecordBatch]:
            return _tested(*args, r.value, n, statistic, parts, stable)(low, high)

        found = over_ranges(spark, total, run, FOUND)
        if total <= local:
            got = found.toArrow()
            work["tests"] += int(np.asarray(got.column("rank"))[np.asarray(got.column("pair")) < 0].sum())
            rows = np.array([np.asarray(got.column(c)) for c in ("pair", "rank", "bits")], np.int64).reshape(3, -1)
            near.append(rows[:, rows[0] >= 0])
        else:
            held = cut(found, "independent")
            work["tests"] += held.where("pair < 0").agg(F.sum("rank")).first()[0]
            tables.append(held.where("pair >= 0"))
        done, length, work["waves"] = upto, np.where(asking, length * GROWTH, length), work["waves"] + 1
        here = np.concatenate(near, axis=1) if near else np.zeros((3, 0), np.int64)
        while True:
            sure, maybe = _firsts(level, edge_of, state, *here, stable)
            for table in tables:
                s, m = _firsts_of_table(table, level, edge_of, state, stable)
                sure, maybe = np.minimum(sure, s), np.minimum(maybe, m)
            falls = (state == OPEN) & (sure < maybe)
            stays = (state == OPEN) & (sure == NEVER) & (maybe == NEVER) & (done == count)
            work["rounds"] += 1
            if not falls.any() and not stays.any():
                break
            state[falls], state[stays] = FALLEN, STANDS
            fell[falls] = sure[falls]
            if stable or not (state == OPEN).any():
                break
        near = [here[:, ((state[:, here[0]] == OPEN) & ((here[2] >> np.arange(len(runs))[:, None]) & 1).astype(bool)).any(axis=0)]]
        asking = ((state == OPEN) & (sure == NEVER) & (maybe == NEVER) & (done < count)).any(axis=0)
    for a, x in enumerate(runs):
        if x.going:
            _remove(x, level, np.flatnonzero(state[a] == FALLEN), fell[a])
    return work


def _fallen(level: Level, state: np.ndarray, p: int) -> np.ndarray:
    out, at = np.zeros((p, p), bool), state == FALLEN
    out[level.i[at], level.j[at]] = out[level.j[at], level.i[at]] = True
    return out


def _remove(x: _Run, level: Level, q: np.ndarray, rank: np.ndarray) -> None:
    """Takes fallen pairs out of a search's graph, with their sets; of the sets from both ends the lesser counts."""
    i, j, s = level.i[q].astype(np.int64), level.j[q].astype(np.int64), level.sets(q, rank[q])
    order = np.lexsort((*s.T[::-1], j, i)) if len(q) else np.zeros(0, np.int64)
    i, j, s = i[order], j[order], s[order]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, s = i[first], j[first], s[first]
    x.adjacent[i, j] = x.adjacent[j, i] = False
    x.sets.append((i, j, s, level.k))
    x.trace.append((level.k, len(i)))


def skeletons(spark: SparkSession, matrix: Correlations, alphas: list[float], max_k: int | None = None, early_stop: bool = True, stable: bool = False, sides: str = "first", test: str = "fisher_z", local: int = LOCAL, stop_from: int = 0) -> tuple[list[_Run], list[dict]]:
    """The searches for several alphas at once, and their work: a test that several of them ask for is made once, and its
    statistic held against each one's critical value. Sets are numbered in the union of their graphs. stop_from: see skeleton."""
    p = matrix.p
    if p < 2:
        raise ValueError("At least two variables are required")
    if len(alphas) > 62:
        raise ValueError("At most 62 searches share their tests")
    stable = stable or sides == "both"
    max_k = max(0, p - 2) if max_k is None else max_k
    runs = [_Run(critical_z(a), ~np.eye(p, dtype=bool)) for a in alphas]
    statistic, work, shared = ci_test(test).statistic, [], spark.sparkContext.broadcast(matrix.r)
    try:
        for k in range(max_k + 1):
            for x in runs:
                degree = x.adjacent.sum(axis=1).max()
                x.going = x.going and bool(degree) and (k == 0 or degree - 1 >= k)
            active = [x for x in runs if x.going]
            if not active:
                break
            union = np.any([x.adjacent for x in active], axis=0)
            with temporary(spark):
                work.append(_level(spark, Level.of(union, k, sides), shared, matrix.n, statistic, active, stable, local))
            for x in active:
                x.after.append(x.adjacent.copy())
                x.going = not early_stop or k < stop_from or x.trace[-1][1] > 0
    finally:
        shared.unpersist()
    return runs, work


def pairs_table(spark: SparkSession, i: np.ndarray, j: np.ndarray) -> DataFrame:
    """(i, j) of a graph's lines."""
    return spark.createDataFrame(pa.table({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32))})).coalesce(1)


def sets_of(spark: SparkSession, sets: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> DataFrame:
    """(i, j, s, level) of all levels."""
    columns = [pa.concat_arrays(c) if sets else None for c in zip(*((pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _lists(s), pa.array(np.full(len(i), k, np.int32))) for i, j, s, k in sets), strict=True)]
    if not columns:
        return spark.createDataFrame([], "i int, j int, s array<int>, level int")
    return spark.createDataFrame(pa.table(dict(zip(("i", "j", "s", "level"), columns, strict=True)))).coalesce(1)


def skeleton(spark: SparkSession, matrix: Correlations, alpha: float = 0.05, max_k: int | None = None, early_stop: bool = True, stable: bool = False, sides: str = "first", test: str = "fisher_z", stop_from: int = 0) -> Skeleton:
    """The graph and separating sets of one search.

    early_stop: at the first level, of those from stop_from on, that removes nothing. stable: sets are taken from the level's starting graph, without
    regard to the order. sides="both": sets of either end's neighbours, which is stable too. Of a pair's sets at most
    GROWTH times as many, and its share of FIRST_WAVE, are tested as one after the other would be.
    """
    runs, work = skeletons(spark, matrix, [alpha], max_k, early_stop, stable, sides, test, stop_from=stop_from)
    x = runs[0]
    return Skeleton(pairs_table(spark, *np.nonzero(np.triu(x.adjacent, 1))), sets_of(spark, x.sets), x.trace, work)
