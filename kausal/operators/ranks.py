"""Mid-ranks and normal scores of columns, for tests that hold under any monotone change of the variables."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import CITest, fisher_columns, register_test, z_statistic
from ..sources.shared import cut, ship, temporary
from .moments import Correlations, correlation_matrix

#: Salts that the rows of one value are dealt over.
SALTS = 32


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as x0, x1 and so on, with _id: by place, as names may differ in case only or be _id."""
    named = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return named.select(*[F.col(f"c{df.columns.index(c)}").cast("double").alias(f"x{n}") for n, c in enumerate(columns)], F.monotonically_increasing_id().alias("_id"))


def _long(held: DataFrame) -> DataFrame:
    """(_id, col, v, salt) of all values of x0, x1 and so on that are numbers, -0.0 as 0.0."""
    cells = F.array(*[F.struct(F.lit(n).alias("col"), (F.col(f"x{n}") + F.lit(0.0)).alias("v")) for n in range(len(held.columns) - 1)])
    rows = held.select("_id", F.explode(cells).alias("c")).select("_id", "c.col", "c.v")
    return rows.where("v is not null and not isnan(v)").withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))


def values_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(_id, col, v, salt): the values of the columns that are numbers, by row."""
    return _long(_numbered(df, columns))


def mid_ranks(rows: DataFrame) -> DataFrame:
    """(col, v, n, mask, mid, total) of each distinct value of rows (col, v, salt): its number, the salts that its rows have,
    the mean of its rows' ranks (from 1) among the column's, and the column's number of values.

    Values are counted before and after they meet, ordered by ranges, and each range adds what the ranges before it hold: one
    number a range and column goes through the driver.
    """
    counted = rows.groupBy("col", "v", "salt").agg(F.count("*").alias("n")).groupBy("col", "v").agg(F.sum("n").alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    held = cut(counted.repartitionByRange("col", "v").withColumn("part", F.spark_partition_id()), "values")
    before, total, sums = [], {}, held.groupBy("part", "col").agg(F.sum("n").alias("n"), F.min("v").alias("least")).collect()
    for r in sorted(sums, key=lambda r: (r["col"], r["least"])):
        before.append((r["part"], r["col"], total.get(r["col"], 0)))
        total[r["col"]] = total.get(r["col"], 0) + r["n"]
    starts = held.sparkSession.createDataFrame([(p, c, b, total[c]) for p, c, b in before], "part int, col int, before long, total long")
    order = Window.partitionBy("part", "col").orderBy("v")
    placed = held.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(starts), ["part", "col"])
    return placed.select("col", "v", "n", "mask", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("mid"), "total")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    normal = NormalDist()
    for x in batches:
        share = np.asarray(x.column("mid")) / (np.asarray(x.column("total")) + 1.0)
        yield pa.RecordBatch.from_arrays([x.column("col"), x.column("v"), x.column("mask"), pa.array([normal.inv_cdf(p) for p in share.tolist()], pa.float64())], ["col", "v", "mask", "score"])


def normal_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, each value replaced by the normal quantile of its mid-rank over one more than the number of values.

    NULL stays NULL and NaN NaN, and neither counts; infinities are the ends of the order. Two shuffles of all values, whatever
    the number of columns: to their counts, and back to their rows; a value that many rows have is dealt over salts.
    """
    ship(df.sparkSession)
    held = cut(_numbered(df, columns), "rows")  # written, so that numbers stay
    rows = _long(held)
    scores = mid_ranks(rows).mapInArrow(_scores, "col int, v double, mask long, score double")
    spread = scores.select("col", "v", "score", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(mask, s) & 1L) = 1L)")).alias("salt"))
    found = rows.join(spread, ["col", "v", "salt"]).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "score"))).alias("scores"))
    own = [F.when(F.isnan(F.col(f"x{n}")), F.lit(float("nan"))).otherwise(F.try_element_at("scores", F.lit(n))).alias(c) for n, c in enumerate(columns)]
    return held.join(found, "_id", "left").select(*own)


def normal_score_matrix(df: DataFrame, columns: list[str]) -> Correlations:
    """Correlations of normal scores."""
    with temporary(df.sparkSession):
        return correlation_matrix(normal_scores(df, columns), columns)


register_test("normal_scores", CITest(z_statistic, fisher_columns, normal_score_matrix))
