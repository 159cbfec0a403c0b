"""discover() and run_case(): from a table to a graph, and to a scored report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ci_test
from ..operators import evaluate, ranks  # noqa: F401  (ranks registers its test)
from ..operators.diagnostics import thin, thinned_matrices
from ..operators.moments import Correlations, correlation_matrix
from ..operators.orient import collider_arrows, cpdag
from ..operators.skeleton import pairs_table, sets_of, skeleton, skeletons
from ..sources.datasets import load_dataset
from ..sources.shared import cut, move_single, new_path, temporary
from ..sources.truth import load_named_truth, load_truth
from .report import as_text, report_graph, report_metrics, report_scores, report_sweep


@dataclass
class PCResult:
    """variables (idx, name), edges (i, j), sepset (i, j, s, level), arrows (src, dst), removals by level, and the levels' work."""

    variables: DataFrame
    edges: DataFrame
    sepset: DataFrame
    arrows: DataFrame
    trace: list[tuple[int, int]]
    work: list[dict] = field(default_factory=list)

    @property
    def adjacency(self) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {r["idx"]: set() for r in self.variables.collect()}
        for r in self.edges.collect():
            out[r["i"]].add(r["j"])
            out[r["j"]].add(r["i"])
        return out

    def summary(self, names: Sequence[str] | None = None) -> str:
        """The report of the graph; without names the variables are "0", "1" and so on."""
        spark, n = self.variables.sparkSession, self.variables.count()
        given = list(names) if names is not None else [str(k) for k in range(n)]
        return as_text(report_graph(spark.createDataFrame(list(enumerate(given)), "idx int, name string").coalesce(1), self.edges, self.arrows))

    def matrix(self) -> np.ndarray:
        """The arrows as a dense matrix of 0 and 1."""
        return evaluate.dense_matrix(self.arrows, self.variables.count())


def search(spark: SparkSession, matrix: Correlations, alpha: float = 0.05, max_cond_set_size: int | None = None, mode: str = "observed", **options) -> PCResult:
    """The graph of a correlation matrix. mode "observed": colliders as they come, both arrows on a conflict;
    "documented": no direction on conflicts, then the propagation rules. options: early_stop, stop_from, stable, sides,
    test (a registered name)."""
    if mode not in ("observed", "documented"):
        raise ValueError("mode is observed or documented")
    found = skeleton(spark, matrix, alpha, max_cond_set_size, **options)
    variables = spark.createDataFrame(list(enumerate(matrix.names)), "idx int, name string").coalesce(1)
    arrows = collider_arrows(found.edges, found.sepset) if mode == "observed" else cpdag(found.edges, found.sepset)
    return PCResult(variables, found.edges, found.sepset, arrows, found.trace, found.work)


def discover(df: DataFrame, alpha: float = 0.05, max_cond_set_size: int | None = None, variable_names: Sequence[str] | None = None, mode: str = "observed", **options) -> PCResult:
    """The causal graph of df's numeric columns, in their order. variable_names is accepted and not used."""
    if len(df.columns) < 2:
        raise ValueError("At least two variables are required")
    matrix = ci_test(options.get("test", "fisher_z")).matrix or correlation_matrix
    return search(df.sparkSession, matrix(df, df.columns), alpha, max_cond_set_size, mode, **options)


def sweep(df: DataFrame, alphas: Sequence[float], sizes: Sequence[int | None], order: list[str] | None = None, steps: Sequence[int] = (1,), **options) -> list[dict]:
    """n, edge and arrow counts for each combination of thinning step, alpha and size.

    The rows are sorted once, and one pass over them gives the moments of all steps (a test with a matrix of its own sorts for each). The searches of a step share their tests:
    one is made once and held against every alpha, and the sizes are the levels of one search. The arrows of all
    graphs are found together, as those of one graph of many parts.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c not in (order or [])]
    test = ci_test(options.get("test", "fisher_z"))
    if list(steps) == [1]:
        matrices = [(test.matrix or correlation_matrix)(df, names)]
    elif test.matrix:
        matrices = [test.matrix(thin(df, order or [], k), names) for k in steps]
    else:
        matrices = thinned_matrices(df, names, order or [], steps)
    p, out, edges, sets = len(names), [], [], []
    most = [p - 2 if s is None else s for s in sizes]
    for step, matrix in zip(steps, matrices, strict=True):
        runs, _ = skeletons(spark, matrix, list(alphas), max(0, *most) if max(most) >= 0 else -1, **options)
        for alpha, x in zip(alphas, runs, strict=True):
            for size, most_k in zip(sizes, most, strict=True):
                graph = x.after[min(most_k, len(x.after) - 1)] if most_k >= 0 and x.after else ~np.eye(p, dtype=bool)
                at = len(out) * p  # the nodes of this graph among those of all
                i, j = np.nonzero(np.triu(graph, 1))
                edges.append((i + at, j + at))
                sets += [(i + at, j + at, s + at, k) for i, j, s, k in x.sets if k <= most_k]
                out.append({"step": step, "alpha": alpha, "size": size, "n": matrix.n, "edges": len(i), "arrows": 0})
    lines = pairs_table(spark, *(np.concatenate(c) for c in zip(*edges, strict=True)))
    counts = collider_arrows(lines, sets_of(spark, sets)).groupBy(F.floor(F.col("src") / p).alias("at")).count()
    for at, n in counts.collect():  # one number a combination
        out[at]["arrows"] = n
    return out


# The files that are taken when none are named, and the parameters of the runner.
DATASET, TRUTH, ALPHA, SIZE = "DatasetUF.csv", "UFGroundTruth.txt", 0.01, 2


@dataclass
class Case:
    """A dataset and its reference graph. truth_names: the variables of the reference graph, where they aren't the dataset's;
    order: the columns that order the rows, for thinning; title: of the case's part of a report."""

    dataset: str = DATASET
    truth: str = TRUTH
    truth_names: Sequence[str] | None = None
    order: Sequence[str] = ()
    title: str = ""


def run_case(spark: SparkSession, dataset_path: str | None = None, truth_path: str | None = None, alpha: float = ALPHA, max_cond_set_size: int = SIZE, mode: str = "observed", truth_names: Sequence[str] | None = None, sweeps: dict | None = None, **options) -> str:
    """The report of a dataset against a reference graph; a missing or unreadable graph only skips the scores.

    mode "documented": the completed graph; lines and directions are scored apart from each other; the reference graph, over
    truth_names (by default the dataset's), is aligned by name and recall taken over the edges whose ends are both in the
    dataset; sweeps, the arguments of sweep() beside the table, adds its table.
    """
    dataset_path, truth_path = dataset_path or DATASET, truth_path or TRUTH
    data = load_dataset(spark, dataset_path, drop_index=mode == "documented", carry=(sweeps or {}).get("order", ()))
    result = discover(data.frame, alpha, max_cond_set_size, mode=mode, **options)
    lines = [as_text(report_graph(result.variables, result.edges, result.arrows))]
    try:
        if mode == "documented":
            lines.append("\n".join(["", *documented_scores(spark, result, data.names, truth_path, truth_names)]))
        else:
            truth, form = load_truth(spark, truth_path, data.names)
            lines.append(f"\n(Ground truth parsed as: {form}, from {truth_path})")
            lines.append("\n".join(report_metrics(evaluate.compute_metrics(result.arrows, truth, len(data.names)))))
    except (FileNotFoundError, ValueError) as e:
        lines.append(f"\n[Ground-truth evaluation skipped: {e}]")
    if sweeps is not None:
        lines.append("\n".join(["", *report_sweep(sweep(data.carrying, **{"alphas": [alpha], "sizes": [max_cond_set_size], **sweeps}, **options))]))
    return "\n".join(lines)


def documented_scores(spark: SparkSession, result: PCResult, names: list[str], truth_path: str, truth_names: Sequence[str] | None = None) -> list[str]:
    """The lines of a graph's scores against a reference graph that is aligned by name."""
    named, form = load_named_truth(spark, truth_path, list(truth_names or names))
    with temporary(spark):
        named = cut(named.distinct().coalesce(1), "named")
        truth = cut(evaluate.align(named, result.variables).coalesce(1), "aligned")
        lines = all_scores(result.edges, result.arrows, truth, len(names), evaluate.by_recovery(named, result.variables))
    return [f"(Ground truth parsed as: {form}, from {truth_path})", *lines]


def all_scores(edges: DataFrame, arrows: DataFrame, truth: DataFrame, n_vars: int, by_recovery: DataFrame) -> list[str]:
    """The lines of a graph's scores, lines and directions apart, against an aligned reference graph."""
    skeleton_scores = evaluate.skeleton_metrics(edges, truth, n_vars).first().asDict()
    shd = evaluate.shd_edges(edges, arrows, truth).first()["SHD"]
    turns = evaluate.orientation_counts(edges, arrows, truth).first().asDict()
    recoverable, total = by_recovery.agg(F.count_if("recoverable"), F.count("*")).first()
    return report_scores(skeleton_scores, shd, evaluate.compute_metrics(arrows, truth, n_vars), turns, recoverable, total)


def run_cases(spark: SparkSession, cases: Sequence[Case], path: str | None = None, alpha: float = ALPHA, max_cond_set_size: int = SIZE, mode: str = "documented", alphas: Sequence[float] = (), sizes: Sequence[int] = (), steps: Sequence[int] = (), **options) -> str:
    """The reports of all cases, one after the other, each under its title; with a path also as one text file. With alphas, sizes
    or steps each report ends with their sweep; steps other than 1 need the case's order."""
    out = []
    for case in cases:
        title = case.title or case.dataset
        sweeps = None
        if alphas or sizes or steps:
            sweeps = {"alphas": list(alphas or [alpha]), "sizes": list(sizes or [max_cond_set_size]), "steps": list(steps or [1]), "order": list(case.order)}
        text = run_case(spark, case.dataset, case.truth, alpha, max_cond_set_size, mode, case.truth_names, sweeps, **options)
        out.append(f"{title} (alpha = {alpha}, conditioning sets up to {max_cond_set_size}, {mode})\n\n{text}")
    text = "\n\n\n".join(out)
    if path:
        write_report(spark, text, path)
    return text


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """The lines of a report as one text file, which replaces another of that name."""
    rows = list(enumerate(text.split("\n")))
    with temporary(spark):
        parts = new_path(spark, "report")
        spark.createDataFrame(rows, "n int, value string").coalesce(1).sortWithinPartitions("n").select(F.col("value")).write.text(parts)
        move_single(spark, parts, path)
