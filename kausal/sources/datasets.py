"""Loading a numeric table from CSV: columns stay or go by their content."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = r"^[+-]?(inf|infinity)$"
BOOLEAN = r"^(true|false|True|False|TRUE|FALSE)$"


@dataclass
class Dataset:
    """A wide DataFrame of doubles without missing values, and its column names, whose order is the variables' order; carrying:
    the same with columns, as text, that were asked for beside them."""

    frame: DataFrame
    names: list[str]
    carrying: DataFrame | None = None


def read_text(spark: SparkSession, path: str, message: str) -> DataFrame:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{message}: {path}") from None
        raise


def column_names(header: list[str | None]) -> list[str]:
    """A blank header becomes `Unnamed: k`; a repeated one gets .1, .2 and so on."""
    names, seen = [], set()
    for k, raw in enumerate(header):
        base = raw if raw and raw.strip() else f"Unnamed: {k}"
        name, n = base, 0
        while name in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name)
        names.append(name)
    return names


def header_names(line: str) -> list[str]:
    return column_names(next(csv.reader([line])))


def as_number(token: Column) -> Column:
    """A token's number; NULL if it is none. Infinities count as numbers."""
    t = F.trim(token)
    sign = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(F.lower(t).rlike(INFINITE), sign)


def numeric_columns(df: DataFrame, names: list[str], drop_index: bool = False, carry: Sequence[str] = ()) -> Dataset:
    """Of string columns c0.., those without a missing or non-numeric token, as doubles; one pass decides.

    A column named exactly DateTime goes; with drop_index also one with a blank header. A column of booleans is 1/0. carry: names of
    columns that are no variables and that `carrying` has as text, to order the rows by.
    """
    keep = [(k, n) for k, n in enumerate(names) if n != "DateTime" and n not in carry and not (drop_index and n.startswith("Unnamed: "))]
    counts = [F.count("*").alias("n")]
    for k, _ in keep:
        c = F.col(f"c{k}")
        counts += [F.count_if(as_number(c).isNotNull()).alias(f"n{k}"), F.count_if(c.rlike(BOOLEAN)).alias(f"b{k}")]
    row = df.agg(*counts).first()
    out = []
    for k, name in keep:
        if row["n"] and row[f"n{k}"] == row["n"]:
            out.append(as_number(F.col(f"c{k}")).alias(name))
        elif row["n"] and row[f"b{k}"] == row["n"]:
            out.append((F.lower(F.col(f"c{k}")) == "true").cast("double").alias(name))
    if not out:
        raise ValueError("No numeric columns were found in the dataset")
    frame = df.select(*out)
    return Dataset(frame, frame.columns, df.select(*out, *[F.col(f"c{names.index(n)}").alias(n) for n in carry]))


def load_dataset(spark: SparkSession, path: str, drop_index: bool = False, carry: Sequence[str] = ()) -> Dataset:
    """A CSV file's numeric columns. Names may differ in case only: later steps take columns by place. A line with an odd
    number of quotes means that a quoted cell holds a line feed; only then files are read whole, one task each."""
    lines = read_text(spark, path, "Dataset not found")
    top = lines.where("trim(value) <> ''").first()
    if top is None:
        raise ValueError("No numeric columns were found in the dataset")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    broken = not lines.where(odd).isEmpty()
    header = next(csv.reader([top[0]])) if top[0].count('"') % 2 == 0 else list(spark.read.csv(path, multiLine=True).first())
    names = column_names([header[0].lstrip("\ufeff") if header[0] else "", *header[1:]])
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    return numeric_columns(spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=broken), names, drop_index, carry)


def from_frame(df: DataFrame) -> Dataset:
    """A DataFrame's numeric columns without missing values, by the same rule (NULL and NaN are missing)."""
    kinds = ("byte", "short", "integer", "long", "float", "double", "boolean")
    at = [k for k, f in enumerate(df.schema.fields) if f.name != "DateTime" and (f.dataType.typeName() in kinds or f.dataType.typeName().startswith("decimal"))]
    named = df.toDF(*[f"x{k}" for k in range(len(df.columns))])
    q = lambda k: F.col(f"x{k}").cast("double")
    row = named.agg(F.count("*").alias("n"), *[F.count_if(q(k).isNull() | F.isnan(q(k))).alias(f"m{k}") for k in at]).first()
    keep = [k for k in at if row["n"] and not row[f"m{k}"]]
    if not keep:
        raise ValueError("No numeric columns were found in the dataset")
    frame = named.select([q(k).alias(df.columns[k]) for k in keep])
    return Dataset(frame, frame.columns)
