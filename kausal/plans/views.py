"""Numeric views of the supplied tables, with the same text for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

V1 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice", "dp", "ch", "o_totalprice", "c_acctbal", "s_acctbal"]
V1_SQL = """SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice, l_discount, l_tax, p_size::DOUBLE AS p_size, p_retailprice,
  l_extendedprice * (1 - l_discount) AS dp, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS ch, o_totalprice, c_acctbal, s_acctbal
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"""
V2 = [f"e{k}" for k in range(32)]
V2_SQL = "SELECT " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(32)) + " FROM embeddings"
V5 = [f"e{k}" for k in range(64)]
V5_SQL = "SELECT " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(64)) + " FROM embeddings"
V4 = [f"e{k}" for k in range(32, 64)]
V4_SQL = "SELECT " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(32, 64)) + " FROM embeddings"
V3 = ["chars", "words", "lines", "digits", "capitals", "doc_id"]
V3_SQL = """SELECT length(text)::DOUBLE AS chars, len(string_split(text, ' '))::DOUBLE AS words, len(string_split(text, chr(10)))::DOUBLE AS lines,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS digits, length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE AS capitals, doc_id::DOUBLE AS doc_id
FROM documents"""


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    joined = t("lineitem").join(t("part"), _on("p_partkey", "l_partkey")).join(t("orders"), _on("o_orderkey", "l_orderkey")).join(t("customer"), _on("c_custkey", "o_custkey")).join(t("supplier"), _on("s_suppkey", "l_suppkey"))
    return joined.selectExpr(
        "cast(l_quantity as double) l_quantity", "l_extendedprice", "l_discount", "l_tax", "cast(p_size as double) p_size", "p_retailprice",
        "l_extendedprice * (1 - l_discount) dp", "l_extendedprice * (1 - l_discount) * (1 + l_tax) ch", "o_totalprice", "c_acctbal", "s_acctbal",
    )


def _on(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*[f"cast(embedding[{k}] as double) e{k}" for k in range(32)])


def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the embeddings."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*[f"cast(embedding[{k}] as double) e{k}" for k in range(64)])


def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of the embeddings' components."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*[f"cast(embedding[{k}] as double) e{k}" for k in range(32, 64)])


def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "cast(length(text) as double) chars", "cast(size(split(text, ' ', -1)) as double) words", "cast(size(split(text, '\\n', -1)) as double) lines",
        "cast(length(regexp_replace(text, '[^0-9]', '')) as double) digits", "cast(length(regexp_replace(text, '[^A-Z]', '')) as double) capitals", "cast(doc_id as double) doc_id",
    )
