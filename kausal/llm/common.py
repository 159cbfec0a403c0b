"""What the operators share: shared-storage cuts, shipping the package, word hashes, salted groups."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path, release, shared_dir, ship, temporary

__all__ = ["cut", "new_path", "release", "shared_dir", "temporary"]

#: Rows that a function holds at once. Bytes of an Arrow batch, and the default of Spark that they replace.
ROWS, BATCH_BYTES = 512, 16 << 20
BATCH_SETTING, BATCH_DEFAULTS = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64mb")
#: Salts of a hot group; a bit mask in a long holds which of them a group has.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors once, and lowers the session's bound of an Arrow batch from Spark's default to
    BATCH_BYTES, as plans are run after a call returns and texts may be long. No other setting is changed."""
    if spark.conf.get(BATCH_SETTING).lower() in BATCH_DEFAULTS:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    ship(spark)


def give_back() -> None:
    """Returns memory that is free in this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = ROWS):
    """run over pieces of at most `rows` rows, as texts may be long, after which the worker gives its free memory back:
    later stages use the same workers again."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(x.slice(k, rows) for x in batches for k in range(0, x.num_rows, rows))
        finally:
            give_back()

    return f


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest_of(text_col: str):
    """The SHA-256 of a text's bytes as a Column, null counting as empty: with the id, the key of a row."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def only(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of docs, one row for each row (id, digest, copies) of chosen, a table: that id, or null, with the text of that digest.

    copies: how many rows of docs are of that id and digest; only where they are several is a choice made among them: the
    least by the other columns that have an order, any one if no such column tells them apart.
    """
    own = docs.columns
    key, digest = fresh(docs, "row_id"), fresh(docs, "row_digest")
    keyed = docs.withColumns({key: F.col(f"`{id_col}`").cast("long"), digest: digest_of(f"`{text_col}`")})
    c = chosen.select(F.col("id").alias("_i"), F.col("digest").alias("_d"), F.col("copies").alias("_n"))
    same = keyed[key].eqNullSafe(c["_i"]) & (keyed[digest] == c["_d"])
    single = keyed.join(c.where("_n = 1"), same, "left_semi").select(*[F.col(f"`{n}`") for n in own])
    if chosen.where("copies > 1").isEmpty():
        return single
    again = keyed.join(c.where("_n > 1"), same, "left_semi")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() not in ("variant", "calendarinterval")]
    order, row = F.struct(*[F.col(f"`{n}`") for n in plain]), F.struct(*[F.col(f"`{n}`") for n in own])
    best = F.min(row) if plain == own else F.min_by(row, order)
    return single.unionByName(again.groupBy(key, digest).agg(best.alias("_row")).select("_row.*"))


def named(column: str):
    """A column by its name, which may hold dots."""
    return F.col(f"`{column}`")


def crc_mod(doc_id: str, mod: int):
    """crc32 of an id as text, modulo mod, as a Column."""
    return F.crc32(named(doc_id).cast("string").cast("binary")) % mod


def crc_mod_py(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


class WordHashes(dict):
    """64-bit hashes of words; a dict that is emptied when it is full, so that memory stays bounded."""

    def __init__(self, most: int = 1 << 18):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def salted(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))


def groups_by_key(df: DataFrame, key: str, id_col: str, pick: str, value: str | None = None) -> DataFrame:
    """For each row (key, id): the picked ("min" or "max") value, by default the id, and the size of its group.

    Rows of a key are combined before the shuffle, then by (key, salt), then by key; the way back joins on
    (key, salt), so a key with a third of all rows is spread over SALTS join keys.
    """
    choose = getattr(F, pick)
    rows = salted(df.select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), F.col(value or id_col).alias("_value")), "_id")
    by_salt = rows.groupBy("_key", "_salt").agg(choose("_value").alias("_pick"), F.count("*").alias("_n"))
    whole = by_salt.groupBy("_key").agg(
        choose("_pick").alias("_pick"),
        F.sum("_n").alias("_size"),
        F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask"),
    )
    spread = whole.select("_key", "_pick", "_size", F.explode(salts_of("_mask")).alias("_salt"))
    return rows.join(spread, ["_key", "_salt"]).select(
        F.col("_id").alias(id_col), F.col("_key").alias(key), F.col("_pick").alias("picked"), F.col("_size").alias("size")
    )


def winners(kept: DataFrame) -> DataFrame:
    """Of rows (label, id, digest) that may stay, one (id, digest, copies) for each label and id: the least digest. A hot
    label is combined before the shuffle."""
    return kept.groupBy("label", "id").agg(F.min("digest").alias("digest"), F.count("*").alias("copies")).select("id", "digest", "copies")


def salts_seen():
    """As an aggregate over a column _salt: the bit mask of a group's salts."""
    return F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("mask")


def salts_of(mask: str):
    return F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright({mask}, s) & 1L) = 1L)")
