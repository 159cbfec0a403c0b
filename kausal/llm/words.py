"""Hashed word features of whole texts, shared by the classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix64, prepare, trimmed, word_hashes

#: Bytes of a very long text whose words are listed at once.
PORTION = 4 << 20
#: Most labels, languages or domains that a classifier tells apart; of more, the most frequent are learned.
MOST_VALUES = 1024
SPACE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def portions(raw: bytes) -> Iterator[list[bytes]]:
    """The words between ASCII white space; those of very long texts in several lists."""
    at = 0
    while at < len(raw):
        m = SPACE.search(raw, at + PORTION) if at + PORTION < len(raw) else None
        end = m.start() if m else len(raw)
        yield raw[at:end].split()
        at = end


def all_hashes(raw: bytes, cache: WordHashes) -> np.ndarray:
    """The hash of every word between ASCII white space."""
    found = [word_hashes(words, cache) for words in portions(raw)]
    return found[0] if len(found) == 1 else np.concatenate([*found, np.zeros(0, np.uint64)])


class Kinds(dict):
    """Of each code point, as str.translate asks for them: letters a or A, digits 0, others as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


KINDS = Kinds()


class ShapesOfKinds(WordHashes):
    """The hash of a word's shape by its kinds, of which there are few: runs of one character count as two of it."""

    def __missing__(self, kinds: str) -> int:
        value = xxhash.xxh3_64_intdigest(RUNS.sub(rb"\1\1", kinds.encode()), seed=77)
        if len(self) >= self.most:
            self.clear()
        self[kinds] = value
        return value


SHAPES = ShapesOfKinds(1 << 16)


def shape_hash(word: bytes) -> int:
    return SHAPES[word.decode(errors="replace").translate(KINDS)]


def bare(text: str) -> str:
    """A word in lower case without the punctuation around it."""
    text = text.lower()
    begin, end = 0, len(text)
    while begin < end and not text[begin].isalnum():
        begin += 1
    while end > begin and not text[end - 1].isalnum():
        end -= 1
    return text[begin:end]


class Beginnings(WordHashes):
    """Hashes of the first four letters of bare words."""

    def __missing__(self, beginning: str) -> int:
        value = xxhash.xxh3_64_intdigest(beginning.encode(), seed=9)
        if len(self) >= self.most:
            self.clear()
        self[beginning] = value
        return value


BEGINNINGS = Beginnings(1 << 16)


def three_hashes(word: bytes) -> tuple[int, int, int]:
    """The hashes of a word's bare form, of that form's beginning and of its shape."""
    text = word.decode(errors="replace")
    own = bare(text)
    return xxhash.xxh3_64_intdigest(own.encode(), seed=5), BEGINNINGS[own[:4]], SHAPES[text.translate(KINDS)]


def bare_hash(word: bytes, letters: int | None = None) -> int:
    """Of a bare word, or of its first letters only."""
    return xxhash.xxh3_64_intdigest(bare(word.decode(errors="replace"))[:letters].encode(), seed=5 + (letters or 0))


class ShapeHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        value = shape_hash(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


class BareHashes(WordHashes):
    """Hashes of bare words, or of their first letters."""

    def __init__(self, letters: int | None = None):
        super().__init__()
        self.letters = letters

    def __missing__(self, word: bytes) -> int:
        value = bare_hash(word, self.letters)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


class WordTable(dict):
    """Numbers of words, with several hashes of each word: a word of a text is looked up once for all of them.

    Emptied between portions when it is full, so that memory stays bounded; numbers hold until the next portion."""

    def __init__(self, hashes_of, kinds: int, most: int = 1 << 19):
        self.hashes_of, self.most = hashes_of, most
        self.hashes = np.zeros((1024, kinds), np.uint64)
        self.fresh: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.fresh.append(self.hashes_of(word))
        return k

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
            self.hashes = self.hashes[:1024]
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            if len(self) > len(self.hashes):
                more = np.zeros((2 * len(self), self.hashes.shape[1]), np.uint64)
                more[: len(self.hashes)] = self.hashes
                self.hashes = more
            self.hashes[len(self) - len(self.fresh) : len(self)] = np.array(self.fresh, np.uint64)
            self.fresh.clear()
        return rows


def pairs_of(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct slots, counts) of hashes in 2**bits slots."""
    s, n = np.unique((h >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    return s, n


class Rows:
    """Sparse rows in one piece: columns and values of row k are those from starts[k] to starts[k + 1]."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]):
        sizes = np.array([len(c) for c in columns], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.cols = np.concatenate([*columns, np.zeros(0, np.int32)]).astype(np.int64)
        self.vals = np.concatenate([*values, np.zeros(0, np.float32)]).astype(np.float64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(sizes)

    def then(self, other: Rows) -> Rows:
        """These rows and then the others."""
        out = Rows([], [])
        out.starts = np.concatenate([self.starts, other.starts[1:] + self.starts[-1]])
        out.cols, out.vals = np.concatenate([self.cols, other.cols]), np.concatenate([self.vals, other.vals])
        out.row, out.n = np.concatenate([self.row, other.row + self.n]), self.n + other.n
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.vals * w[self.cols], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cols, self.vals * g[self.row], minlength=size)


def sampled(table: DataFrame, by: str, most: int, id_col: str = "doc_id", values: int = MOST_VALUES) -> list[tuple[int, object]]:
    """(id, value): of each value of `by`, the `most` ids with the least hashes, ties by id.

    An id counts once, under the least of its values; rows with a null id or value don't count. The number of a value's
    rows gives a bound that about `most` of its hashes stay under; only those leave the scan, spread by id. Where they are
    too few, as ids repeat, the bound is raised fourfold, until they are enough or all. Of more than `values` values the most frequent count, ties to the least.
    """
    spark = table.sparkSession
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{by}`").alias("value")).where("id is not null and value is not null")
    counts = dict(tuple(r) for r in rows.groupBy("value").count().orderBy(F.desc("count"), "value").limit(values).collect())
    rows = rows.withColumn("h", F.xxhash64("id"))
    kind = dict(rows.dtypes)["value"]
    share = {v: (most + 6 * most**0.5 + 16) / n for v, n in counts.items()}
    out = []
    while share:
        edges = [(v, (1 << 63) - 1 if s >= 1 else int(s * 2**64) - (1 << 63)) for v, s in share.items()]
        limits = F.broadcast(spark.createDataFrame(edges, f"value {kind}, edge long"))
        near = rows.join(limits, "value").where("h <= edge").select("value", "h", "id").distinct().collect()
        least = {}
        if len(counts) > 1 and near:
            ids = spark.createDataFrame(sorted({(r["id"],) for r in near}), "id long")
            learned = F.broadcast(spark.createDataFrame([(v,) for v in counts], f"value {kind}"))
            least = dict(tuple(r) for r in rows.join(F.broadcast(ids), "id").join(learned, "value").groupBy("id").agg(F.min("value")).collect())
        for v in list(share):
            own = sorted((r["h"], r["id"]) for r in near if r["value"] == v and least.get(r["id"], v) == v)
            if len(own) >= most or share[v] >= 1:
                out += [(i, v) for _, i in own[:most]]
                del share[v]
            else:
                share[v] *= 4
    return out


def featured(features):
    """An Arrow function from (key, text) to (key, columns, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features()
        for x in batches:
            found = [f(t or "") for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [x.column(0), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([np.asarray(v, np.float32) for _, v in found], pa.list_(pa.float32()))], ["key", "cols", "vals"]
            )

    return run


def gathered(docs: DataFrame, chosen: list[tuple[int, object]], features, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, Rows]:
    """(values, features) of the chosen (id, value), of which there are few by their sampling. Of an id that several rows
    have the least text counts, null ones last."""
    if not chosen:
        return [], Rows([], [])
    prepare(docs.sparkSession)
    value = dict(chosen)
    ids = docs.sparkSession.createDataFrame([(i,) for i in value], "key long")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(ids), "key")
    one = texts.groupBy("key").agg(F.min("text").alias("text"))
    found = one.mapInArrow(trimmed(featured(features)), "key long, cols array<int>, vals array<float>").toArrow()
    cols = [np.asarray(v.values, np.int32) for v in found.column("cols")]
    vals = [np.asarray(v.values, np.float32) for v in found.column("vals")]
    keys = [value[i] for i in found.column("key").to_pylist()]
    order = sorted(range(len(keys)), key=lambda k: (str(keys[k]), xxhash.xxh3_64_intdigest(cols[k].tobytes() + vals[k].tobytes())))
    return [keys[k] for k in order], Rows([cols[k] for k in order], [vals[k] for k in order])
