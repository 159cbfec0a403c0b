"""Importance resampling towards a target distribution, with DuckDB in each partition (operator 12).

A task hands its texts to an in-memory DuckDB of its own: SQL unnests the words, makes n-grams with a window, and puts them
into buckets by registered functions: zlib's CRC-32 of each different word, and that of joined words from their own. Bucket counts are spilled as Parquet to the shared folder, where Spark merges those
of the corpus and of the target; the buckets' gains go back to a second pass, which scores every document.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diagnostics import ordered_index
from .common import LOWER, UPPER, cut, fresh, prepare, temporary, trimmed

#: Buckets of the n-grams; bytes of text that a database holds at once; its memory.
BUCKETS, PORTION, MEMORY = 10_000, 4 << 20, "700MB"
# Fixed value: the polynomial of zlib's CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes that a checksum is moved over at once.
FAR = 1024
#: What a word is made of, after A-Z have been lowered; and what stands between words before that.
WORDS, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


class Crc:
    """CRC-32 of joined texts from those of their parts: a part's checksum is moved over the bytes of the next by tables."""

    _tables: np.ndarray | None = None

    @classmethod
    def tables(cls) -> np.ndarray:
        """[n, k, byte]: the checksum byte << 8 k, moved over n bytes, for n up to FAR."""
        if cls._tables is None:
            one = np.arange(256, dtype=np.uint32)
            for _ in range(8):
                one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
            out = np.empty((FAR + 1, 4, 256), np.uint32)
            out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
            for n in range(FAR):
                out[n + 1] = (out[n] >> 8) ^ one[out[n] & 255]
            cls._tables = out
        return cls._tables

    @classmethod
    def moved(cls, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        t = cls.tables()
        while True:
            step = np.minimum(n, FAR)
            crc = t[step, 0, crc & 255] ^ t[step, 1, (crc >> 8) & 255] ^ t[step, 2, (crc >> 16) & 255] ^ t[step, 3, crc >> 24]
            n = n - step
            if not n.any():
                return crc

    @classmethod
    def spaced(cls, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The checksums of left, a space, and right of n bytes."""
        with_space = cls.moved(left, np.ones(len(left), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        return cls.moved(with_space, n) ^ right


def database() -> duckdb.DuckDBPyConnection:
    """One thread, bounded memory, no files; crc_of a word, and crc_joined of a feature, the next word's checksum and bytes."""
    db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
    db.create_function("crc_of", lambda w: pa.array([zlib.crc32(v) for v in w.cast(pa.binary()).to_pylist()], pa.int64()), ["VARCHAR"], "BIGINT", type="arrow")
    joined = lambda a, b, n: pa.array(Crc.spaced(np.asarray(a).astype(np.uint32), np.asarray(b).astype(np.uint32), np.asarray(n)).astype(np.int64))
    db.create_function("crc_joined", joined, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
    return db


def _features(n: int, buckets: int) -> str:
    """CTEs up to f(piece, bucket): the 1- to n-word features of the pieces (piece, carried, text). A piece that goes on with a
    long text begins with the `carried` last words of the one before, and has the features that end after them only."""
    crc = ["c"]
    for j in range(1, n):
        crc.append(f"crc_joined({crc[-1]}, c{j}, n{j})")
    runs = " UNION ALL ".join(f"SELECT piece, ({crc[k - 1]} % {buckets})::INT AS bucket FROM g WHERE k + {k - 1} > carried" + (f" AND c{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, n + 1))
    ahead = "".join(f", lead(c, {j}) OVER o AS c{j}, lead(n, {j}) OVER o AS n{j}" for j in range(1, n))
    return f"""WITH l AS (SELECT piece, carried, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM pieces),
w AS (SELECT piece, carried, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM l),
v AS (SELECT w, crc_of(w) AS c, strlen(w) AS n FROM (SELECT DISTINCT w FROM w)),
g AS (SELECT piece, carried, k, c{ahead} FROM w JOIN v USING (w) WINDOW o AS (PARTITION BY piece ORDER BY k)),
f AS ({runs})"""


def count_sql(n: int, buckets: int) -> str:
    return f"{_features(n, buckets)} SELECT bucket, count(*) AS n FROM f GROUP BY bucket"


def score_sql(n: int, buckets: int) -> str:
    return f"""{_features(n, buckets)}, s AS (SELECT piece, count(*) AS features, sum(gain)::BIGINT AS gain FROM f JOIN gains USING (bucket) GROUP BY piece)
SELECT s.piece, features, s.gain, len(ws) - least(carried, len(ws)) AS words FROM s JOIN l USING (piece)"""


def pieces_of(raw: bytes, n: int, portion: int) -> Iterator[tuple[int, bytes]]:
    """(carried, piece) of a text: cut between words, each piece led by the last n - 1 words before it."""
    at, carried = 0, b""
    while at < len(raw):
        end = len(raw)
        if at + portion < len(raw) and (m := BETWEEN.search(raw, at + portion)):
            end = m.start()
        piece = carried + b" " + raw[at:end] if carried else raw[at:end]
        yield len(carried.split(b" ")) if carried else 0, piece
        if end < len(raw) and n > 1:
            carried = b" ".join(last_words(piece, n - 1))
        at = end


def last_words(piece: bytes, n: int) -> list[bytes]:
    words, end = [], len(piece)
    spaced = BETWEEN.sub(b" ", piece)
    while len(words) < n:
        spaced = spaced[:end].rstrip(b" ")
        if not spaced:
            break
        end = spaced.rfind(b" ") + 1
        words.append(spaced[end:])
    return words[::-1]


def _portions(x: pa.Array, n: int, portion: int) -> Iterator[tuple[list[int], pa.Table]]:
    """(row of each piece, pieces) of texts, about `portion` bytes at a time."""
    rows, carried, texts, size = [], [], [], 0
    for row, v in enumerate(x):
        for c, piece in pieces_of(v.as_buffer().to_pybytes() if v.is_valid else b"", n, portion):
            if rows and size + len(piece) > 2 * portion:
                yield rows, _table(carried, texts)
                rows, carried, texts, size = [], [], [], 0
            rows.append(row), carried.append(c), texts.append(piece)
            size += len(piece)
    if rows:
        yield rows, _table(carried, texts)


def _table(carried: list[int], texts: list[bytes]) -> pa.Table:
    return pa.table({"piece": pa.array(range(len(texts)), pa.int32()), "carried": pa.array(carried, pa.int32()), "text": pa.array(texts, pa.binary()).cast(pa.string())})


def _counted(n: int, buckets: int, portion: int):
    """(text) to (bucket, n): a task's counts, combined before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        with database() as db:
            for x in batches:
                for _, pieces in _portions(x.column("text"), n, portion):
                    db.register("pieces", pieces)
                    got = db.execute(count_sql(n, buckets)).fetchnumpy()
                    total[got["bucket"]] += got["n"]
                    db.unregister("pieces")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


SCORED = "id long, n_words long, n_features long, weight long, score long"


def noise(id_: int | None, seed: int) -> int:
    """Gumbel noise of an id in thousandths, from eight hex digits of SHA-256 of `seed:id`; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: np.ndarray, n: int, seed: int, portion: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with database() as db:
            db.register("given", pa.table({"bucket": pa.array(range(len(gains)), pa.int32()), "gain": pa.array(gains)}))
            db.execute("CREATE TABLE gains AS SELECT * FROM given")
            for x in batches:
                words, features, gain = (np.zeros(x.num_rows, np.int64) for _ in range(3))
                for rows, pieces in _portions(x.column("text"), n, portion):
                    db.register("pieces", pieces)
                    got = db.execute(score_sql(n, len(gains))).fetchnumpy()
                    at = np.array(rows)[got["piece"]]
                    for total, name in ((words, "words"), (features, "features"), (gain, "gain")):
                        np.add.at(total, at, got[name])
                    db.unregister("pieces")
                weight = np.where(features > 0, gain // np.maximum(features, 1), 0)
                score = weight + np.array([noise(i, seed) for i in x.column("id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([x.column("id"), *(pa.array(c) for c in (words, features, weight, score))], [c.split()[0] for c in SCORED.split(", ")])

    return run


def bucket_counts(docs: DataFrame, n: int, buckets: int, text_col: str = "text", portion: int = PORTION) -> dict[int, int]:
    """Features of all texts by bucket, of which there are `buckets` at most."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    spilled = cut(texts.mapInArrow(trimmed(_counted(n, buckets, portion)), "bucket int, n long"), "buckets")
    return dict(tuple(r) for r in spilled.groupBy("bucket").agg(F.sum("n")).collect())


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Of each bucket, the logarithm, in thousandths and floored, of its share of the target over its share of the source."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1.0) * float(s_all + buckets) / ((source.get(b, 0) + 1.0) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def importance(docs: DataFrame, target: DataFrame, words: int = 2, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", portion: int = PORTION) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each row of docs: the floored mean of its features' gains, and that with
    Gumbel noise by its id. Null and texts without a word have no features and weight 0; long texts are taken in portions;
    repeated rows count and are scored each; empty tables give no rows, an empty target no counts; other columns are not
    looked at."""
    prepare(docs.sparkSession)
    with temporary(docs.sparkSession):
        gains = gains_of(bucket_counts(docs, words, buckets, text_col, portion), bucket_counts(target, words, buckets, target_col, portion), buckets)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_scored(gains, words, seed, portion)), SCORED)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id", **options) -> DataFrame:
    """importance() with rank: 1, 2, 3 and so on for the rows drawn, null for others. Of the N rows with at least least_words
    words, floor(percent * N / 100) of the highest scores are drawn, ties to smaller ids, null ids last; options: those of
    importance. The order is found by ranges, and a row's place in it from the ranges' sizes."""
    spark = docs.sparkSession
    with temporary(spark):
        scored = cut(importance(docs, target, id_col=id_col, **options), "scored")
        drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
        keyed = scored.select("*", (F.col("n_words") < least_words).alias("out"), (-F.col("score")).alias("last"), F.col("id").isNull().alias("unnamed"))
        ranked = ordered_index(keyed, ["out", "last", "unnamed", "id"])
        rank = F.when(F.col("_row") < drawn, F.col("_row") + 1)
        return cut(ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank")), "drawn", keep=True)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are drawn, in no order, all columns. Rows that share an id stay if one of them is drawn; rows with
    a null id go."""
    chosen, key = resampled(docs, target, id_col=id_col, **options).where("rank is not null"), fresh(docs, "drawn_id")
    ids = chosen.select(F.col(f"`{id_col}`").alias(key)).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = f"""
WITH tab AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
x AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
l AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM x),
f AS (SELECT side, id, unnest(w) AS f FROM l UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM l),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) % 10000 AS b FROM u, tab),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN c USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM n),
d AS (SELECT id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY id),
k AS (SELECT l.id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || l.id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM l LEFT JOIN d ON d.id = l.id WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM k WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= floor(25 * (SELECT count(*) FROM r) / 100) THEN r END AS rank FROM k LEFT JOIN r USING (doc_id)
"""
