"""Text reports as rows (line_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import KEYS
from ..operators.skeleton import adjacency_lists


def report_graph(variables: DataFrame, edges: DataFrame, arrows: DataFrame) -> DataFrame:
    """The variables, each one's neighbours by index, and the arrows by (parent, child). As many rows as the graph has."""
    names = variables.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda v: v["name"]).alias("names"))
    head = names.select(F.lit(0).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.concat(F.lit("Variables: "), F.concat_ws(", ", "names")).alias("text"))
    title = lambda part, text: names.select(F.lit(part).alias("part"), F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(text).alias("text"))
    rows = variables.join(adjacency_lists(edges).withColumnRenamed("i", "idx"), "idx", "left").join(F.broadcast(names))
    listed = F.coalesce(F.concat_ws(", ", F.transform("nbrs", lambda k: F.get("names", k))), F.lit("(none)"))
    lines = rows.select(F.lit(1).alias("part"), F.col("idx").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("  "), "name", F.lit(" -> "), F.when(F.col("nbrs").isNull(), "(none)").otherwise(listed)).alias("text"))
    at = lambda k: F.get("names", F.col(k))
    directed = arrows.join(F.broadcast(names)).select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("  "), at("src"), F.lit(" -> "), at("dst")).alias("text"))
    none = arrows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(2).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("  (none detected)").alias("text"))
    every = head.union(title(1, "Undirected skeleton:")).union(lines).union(title(2, "Directed edges:")).union(directed).union(none)
    sorted_rows = every.agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "text"))).alias("r"))
    return sorted_rows.select(F.posexplode("r").alias("line_no", "r")).select("line_no", F.col("r.text").alias("text"))


def report_metrics(metrics: dict[str, float]) -> list[str]:
    return ["Evaluation against ground truth:", *[f"  {k:<12}: {metrics[k]}" for k in KEYS]]


def report_scores(skeleton: dict, shd: int, directed: dict[str, float], turns: dict, recoverable: int, edges: int) -> list[str]:
    """The scores of the graph's lines and of its directions, apart from each other, as lines."""
    ratio = lambda x: f"{x:.4f}"
    return [
        f"Reference edges: {edges}, of which between variables of the dataset: {recoverable}",
        "Skeleton:",
        *[f"  {k:<12}: {v}" for k, v in (("Found", skeleton["TP"] + skeleton["FP"]), ("Precision", ratio(skeleton["Precision"])), ("Recall", ratio(skeleton["Recall_TPR"])), ("F1", ratio(skeleton["F1"])), ("SHD", shd))],
        "Directions of shared edges:",
        *[f"  {k:<12}: {turns[k]}" for k in ("correct", "reversed", "undirected", "other")],
        "Directed entries:",
        *[f"  {k:<12}: {directed[k]}" for k in KEYS],
    ]


def report_sweep(rows: list[dict]) -> list[str]:
    """A table of a sweep's searches."""
    keys = ("step", "alpha", "size", "n", "edges", "arrows")
    return ["Sweep:", "  " + "".join(f"{k:>9}" for k in keys), *["  " + "".join(f"{r[k]:>9}" for k in keys) for r in rows]]


def as_text(report: DataFrame) -> str:
    return "\n".join(r["text"] for r in report.orderBy("line_no").collect())
