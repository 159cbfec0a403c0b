"""Loading a reference graph: a square matrix of numbers, or a list of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .datasets import NUMBER, read_text

WHOLE, SPECIAL = r"^[+-]?\d+(_\d+)*$", r"(?i)^[+-]?(nan|inf|infinity)$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file, in its order. One task reads it whole: graphs are of the size of the variables squared."""
    read_text(spark, path, "Ground truth file not found")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("pos", "line"))


def cell_number(token: Column) -> Column:
    """A cell's number; NULL if it is none: a number as it is written in decimals, or an infinity or NaN, which aren't zero."""
    return F.when(token.rlike(NUMBER), token.try_cast("double")).when(token.rlike(SPECIAL), F.lit(float("nan")))


def parse_matrix(lines: DataFrame, n: int, comma: bool) -> DataFrame | None:
    """(src, dst) of the entries that aren't zero, or None if the lines aren't n rows of n numbers; # begins a comment."""
    text = F.trim(F.regexp_replace("line", "#.*", ""))
    cells = F.transform(F.split(text, ","), lambda c: F.trim(c)) if comma else F.split(text, r"\s+")
    rows = lines.select("pos", text.alias("t"), F.transform(cells, cell_number).alias("v")).where("t <> ''")
    good = rows.agg(F.count("*").alias("n"), F.expr(f"count_if(size(v) = {n} and not exists(v, x -> x is null))").alias("ok")).first()
    if n < 1 or good["n"] != n or good["ok"] != n or (n == 1 and good["n"] == 1):
        return None
    numbered = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("r"))
    entries = numbered.select(F.posexplode("r").alias("src", "row")).select("src", F.posexplode("row.v").alias("dst", "x"))
    return entries.where("isnan(x) or x <> 0").select("src", "dst")


def parse_edges(lines: DataFrame, variables: DataFrame, n: int) -> DataFrame:
    """(src, dst): the first two tokens of each line as names, or both as indices; other lines are skipped."""
    tokens = lines.select(F.filter(F.split(F.trim(F.regexp_replace("line", ",", " ")), r"\s+"), lambda t: t != "").alias("t")).where("size(t) >= 2").select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"))
    named = variables.groupBy("name").agg(F.max("idx").alias("idx"))  # of equal names the last counts
    v = lambda name, idx: F.broadcast(named.select(F.col("name").alias(name), F.col("idx").alias(idx)))
    number = lambda c: F.when(F.col(c).rlike(WHOLE), F.regexp_replace(c, "_", "").try_cast("int"))
    both = tokens.join(v("a", "ia"), "a", "left").join(v("b", "ib"), "b", "left")
    by_name = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    edges = both.select(F.when(by_name, F.col("ia")).otherwise(number("a")).alias("src"), F.when(by_name, F.col("ib")).otherwise(number("b")).alias("dst"))
    return edges.where(f"src between 0 and {n - 1} and dst between 0 and {n - 1}").distinct()


def load_truth(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, str]:
    """(src, dst) and the form found: "matrix" or "edge_list"."""
    n, lines = len(names), numbered_lines(spark, path)
    for comma in (False, True):
        if (found := parse_matrix(lines, n, comma)) is not None:
            return found, "matrix"
    variables = spark.createDataFrame(list(enumerate(names)), "idx int, name string")
    edges = parse_edges(lines, variables, n)
    if edges.isEmpty():
        raise ValueError(f"Could not parse ground truth file {path} as either a matrix ({n}x{n} expected) or an edge list against variable_names.")
    return edges, "edge_list"


def load_named_truth(spark: SparkSession, path: str, own_names: list[str]) -> tuple[DataFrame, str]:
    """A graph over own_names, by name: (src_name, dst_name), and the form found."""
    truth, form = load_truth(spark, path, own_names)
    own = spark.createDataFrame(list(enumerate(own_names)), "idx int, name string")
    named = truth.where("src <> dst").join(own.select(F.col("idx").alias("src"), F.col("name").alias("src_name")), "src").join(own.select(F.col("idx").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return named.select("src_name", "dst_name"), form
