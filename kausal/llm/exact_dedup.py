"""Exact dedup by skew-safe combining (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SALTS, UPPER, cut, only, prepare, salted, salts_of, trimmed, winners


def _digests(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = pc.fill_null(x.column(1), "")
            norm = pc.ascii_lower(text)
            own, digest = (pa.array([hashlib.sha256(v.as_buffer()).digest() for v in c], pa.binary()) for c in (text, norm))
            cols = [x.column(0), own, digest] + ([norm] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, ["id", "own", "digest", "norm"][: len(cols)])

    return run


def combined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, digest, keep_id, group_size) of every row: the digests of its text as it is and as it is compared."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    full = salted(rows.mapInArrow(trimmed(_digests(True)), "id long, own binary, digest binary, norm string"), "id")
    by_salt = full.groupBy("digest", "_salt", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    merged = by_salt.repartition("digest").groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("mask")
    )
    groups = cut(merged.select("digest", "keep_id", "group_size", "mask"), "groups")
    light = salted(rows.mapInArrow(trimmed(_digests(False)), "id long, own binary, digest binary"), "id")
    spread = groups.select("digest", "keep_id", "group_size", F.explode(salts_of("mask")).alias("_salt"))
    shared = groups.groupBy("digest").count().where("count > 1").select("digest")
    columns = ["id", "own", "digest", "keep_id", "group_size"]
    if shared.isEmpty():
        return light.join(spread, ["digest", "_salt"]).select(*columns)
    # different texts of one digest: those are told apart by the texts themselves
    clash = F.broadcast(shared) if shared.count() <= 10_000 else shared
    texts = merged.join(clash, "digest", "left_semi").select("digest", "norm", "keep_id", "group_size", F.explode(salts_of("mask")).alias("_salt"))
    return light.join(spread.join(clash, "digest", "left_anti"), ["digest", "_salt"]).select(*columns).unionByName(full.join(texts, ["digest", "_salt", "norm"]).select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Copies are combined within each task, then merged by (digest, salt), then the salts' winners by digest; each of
    the three compares whole normalised texts, the digest only deals them out. The row with the largest id stays.
    Null and empty texts are one group; rows that repeat an id count each, and each with the largest id is kept; null ids
    are less than all others, and kept only where a group has no others; empty tables give no rows; other columns are
    not looked at, whatever their names.
    """
    found = combined(docs, id_col, text_col)
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns: that of the largest id, null ids being the least. Where
    several rows of the group have that id, the one whose text as it is has the least digest, then the least by the other
    columns. An id that stands at different texts stays at each of them that it wins."""
    kept = combined(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("keep_id")))
    chosen = cut(winners(kept.select(F.col("digest").alias("label"), "id", F.col("own").alias("digest"))), "winners")
    return only(docs, chosen, id_col, text_col)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
assert SALTS <= 62
