"""Byte-level BPE by corpus-level merge replay (operator 1).

Pieces between white space are counted over all texts first; the words of the most frequent ones form one corpus, which is
replayed once and whose ids go to every task. What else a batch of texts holds is replayed there, as a corpus of its own. An inverted index leads from the
rank of a token pair to the places where the pair stands; merges are applied in rank order to all places at once, and
only the pairs beside a merged place are looked up again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, temporary, trimmed

#: Most pieces of the whole corpus whose words are replayed once and sent to every task; their mean and greatest length;
#: words that a worker keeps besides.
CORPUS_PIECES, MEAN_CHARS, PIECE_CHARS, CACHE_WORDS = 1 << 18, 16, 64, 200_000
#: Characters of a batch, words of a portion of a very long text.
BATCH_CHARS, PORTION_WORDS = 2_000_000, 200_000
#: Tasks that replay the frequent words.
REPLAYERS = 16
_loaded: dict[str, Replay] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Replay:
    """Ids of words under one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.shift = max(ranks.values()).bit_length()
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.full(1 << 16, -1, np.int64)  # the rank of a pair of bytes
        for a in range(256):
            for b in range(256):
                self.first[a << 8 | b] = ranks.get(bytes([a, b]), -1)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.common: tuple[list[str], np.ndarray, np.ndarray] = ([], np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.common_key = ""
        self.forget()

    def forget(self) -> None:
        """Only the words that were sent along stay: words to numbers, and by number the place and count of the ids."""
        words, sizes, ids = self.common
        self.numbers: dict[str, int] = dict(zip(words, range(len(words)), strict=True))
        self.sizes, self.ids = sizes, ids
        self.starts = np.cumsum(sizes) - sizes

    def know(self, key: str, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        if key != self.common_key:
            self.common, self.common_key = (words, sizes, ids), key
            self.forget()

    def one(self, word: bytes) -> tuple[int, ...]:
        """A single word, always by its lowest rank, leftmost first."""
        ids = [self.ranks[bytes([b])] for b in word]
        while True:
            found = [(r, k) for k in range(len(ids) - 1) if (r := self.pairs.get(ids[k] << self.shift | ids[k + 1])) is not None]
            if not found:
                return tuple(ids)
            rank, k = min(found)
            ids[k : k + 2] = [rank]

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word; words are not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        end = len(flat)  # the place beyond every word's last and before its first; its id opens no pair
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rank = np.full(end + 1, -1, np.int64)
        rank[: end - 1] = self.first[flat[:-1] << 8 | flat[1:]]
        last = starts[1:] - 1
        rank[last] = -1
        nxt_np, prv_np = np.arange(1, end + 2), np.arange(-1, end)
        nxt_np[last], prv_np[starts[:-1]] = end, end
        nxt, prv, rank_at, ids = nxt_np.tolist(), prv_np.tolist(), rank.tolist(), [*self.byte_id[flat].tolist(), -1]
        index: list[list[int]] = [[] for _ in self.bytes_of]
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        found, begin = np.unique(rank[at], return_index=True)
        for r, places in zip(found.tolist(), np.split(at, begin[1:]), strict=True) if len(at) else ():
            index[r] = places.tolist()
        get, shift, early = self.pairs.get, self.shift, set()
        for r, places in enumerate(index):
            if not places:
                continue
            places.sort()
            left_key = r << shift
            for p in places:
                if rank_at[p] != r:
                    continue  # a neighbour was merged away meanwhile
                q = nxt[p]
                after, before = nxt[q], prv[p]
                ids[p], ids[q], rank_at[q] = r, -1, -1
                nxt[p], prv[after] = after, p
                new = get(left_key | ids[after])
                if new is None:
                    rank_at[p] = -1
                else:
                    rank_at[p] = new
                    index[new].append(p)
                    if new < r:
                        early.add(p)
                new = get(ids[before] << shift | r)
                if new is None:
                    rank_at[before] = -1
                else:
                    rank_at[before] = new
                    index[new].append(before)
                    if new < r:
                        early.add(p)
            index[r] = ()
        final = np.array(ids[:end], np.int64)
        alive = final >= 0
        ends = np.cumsum(alive)[last].tolist()
        kept = final[alive].tolist()
        out, begin = [], 0
        for end in ends:
            out.append(tuple(kept[begin:end]))
            begin = end
        for w in {int(np.searchsorted(starts, p, side="right")) - 1 for p in early}:
            out[w] = self.one(words[w])  # a merge opened a pair of lower rank: places of one rank must then take turns
        return out

    def ids_of(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct words."""
        raw = [w.encode() for w in words]
        out: list[tuple[int, ...]] = [(r,) if (r := self.ranks.get(w)) is not None else () for w in raw]
        open_at = [k for k, ids in enumerate(out) if not ids]
        if open_at:
            for k, ids in zip(open_at, self.replay([raw[k] for k in open_at]), strict=True):
                out[k] = ids
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Gives numbers to words that have none."""
        new = list(set(words))
        found = self.ids_of(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.numbers.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])

    def of_words(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list's words, one after the other. Words that have no number yet, of all the lists, are learned
        together; most of the table is kept for the next time."""
        if len(self.numbers) > len(self.common[0]) + CACHE_WORDS:
            self.forget()
        look = self.numbers.get
        numbers = [np.fromiter(map(look, words, repeat(-1)), np.int64, len(words)) for words in lists]
        unknown = [np.flatnonzero(k < 0) for k in numbers]
        missing = [[words[i] for i in at.tolist()] for words, at in zip(lists, unknown, strict=True)]
        if any(missing):
            self.learn(chain.from_iterable(missing))
        out = []
        for k, at, words in zip(numbers, unknown, missing, strict=True):
            k[at] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            sizes = self.sizes[k]
            begins = np.cumsum(sizes) - sizes
            out.append(self.ids[np.repeat(self.starts[k] - begins, sizes) + np.arange(int(sizes.sum()))])
        return out

    def portions(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BATCH_CHARS:
            yield self.pattern.findall(text)
            return
        it = self.pattern.finditer(text)
        while part := [m.group() for m in islice(it, PORTION_WORDS)]:
            yield part

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[np.ndarray]]:
        """For each text the ids of its portions. Texts are taken in batches of BATCH_CHARS; one that is longer by itself,
        a portion at a time, while the iterator is at it."""
        held, chars = [], 0
        for text in texts:
            if len(text) > BATCH_CHARS:
                yield from ([ids] for ids in self.of_words(held))
                held, chars = [], 0
                yield [self.of_words([part])[0] for part in self.portions(text)]
                continue
            held.append(self.pattern.findall(text))
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from ([ids] for ids in self.of_words(held))
                held, chars = [], 0
        yield from ([ids] for ids in self.of_words(held))

    def encode(self, text: str) -> list[int]:
        return [int(i) for parts in self.encode_all([text]) for part in parts for i in part]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def loaded(path: str, pattern: str) -> Replay:
    """The tables of a rank file; a worker reads it once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Replay(read_ranks(path), pattern)
    return _loaded[path, pattern]


def rank_file(ranks: str) -> str:
    """A path, or the place of a file of public_tokenizers."""
    return ranks if "/" in ranks else public_tokenizers.path(ranks)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, n): how often each short piece between ASCII white space, without the ASCII punctuation around it, stands in
    the texts of a batch; Arrow counts them, so that no piece becomes a Python object."""
    for x in batches:
        counts = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(x.column(1))))
        piece = pc.ascii_trim(counts.field(0), characters=punctuation)
        size = pc.utf8_length(piece)
        short = pc.and_(pc.greater(size, 0), pc.less_equal(size, PIECE_CHARS))
        yield pa.RecordBatch.from_arrays([piece.filter(short), counts.field(1).filter(short)], ["piece", "n"])


def _words(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = loaded(rank_file(ranks), pattern)
        for x in batches:
            found = {w for piece in x.column(0).to_pylist() for w in replay.pattern.findall(f" {piece}")}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    return run


def _replayed(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = loaded(rank_file(ranks), pattern)
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(replay.ids_of(x.column(0).to_pylist()), pa.list_(pa.int32()))], ["word", "ids"])

    return run


def corpus_table(rows: DataFrame, ranks: str, pattern: str, most: int) -> tuple[str, list[str], np.ndarray, np.ndarray]:
    """(key, words, counts of ids, ids) of the words in the corpus's most frequent pieces, each replayed once.

    Pieces between white space are counted over all whole texts. Those that are counted at least so often that they are at
    most `most`, and at most MEAN_CHARS characters each on average, are taken: a bound, for any corpus, of what goes to the
    driver and to every task. The words of other pieces, and of those of over PIECE_CHARS, are replayed where they are.
    """
    counts = rows.mapInArrow(trimmed(_counts, 8192), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    with temporary(rows.sparkSession):
        counts = cut(counts.where("n > 1"), "pieces")
        step = F.when(F.col("n") <= 256, F.col("n")).otherwise(F.lit(256) + F.floor(8 * F.log2(F.col("n") / 256)))
        least, pieces, chars = None, 0, 0
        sums = [F.count("*"), F.sum(F.length("piece")), F.min("n")]
        for _, more, size, n in counts.groupBy(step.alias("step")).agg(*sums).orderBy(F.desc("step")).collect():
            pieces, chars = pieces + more, chars + size
            if pieces > most or chars > MEAN_CHARS * most:
                break
            least = n
        if least is None:
            return "", [], np.zeros(0, np.int64), np.zeros(0, np.int32)
        words = counts.where(F.col("n") >= least).select("piece").mapInArrow(trimmed(_words(ranks, pattern), 1 << 16), "word string").repartition(REPLAYERS, "word").distinct()
        found = words.mapInArrow(trimmed(_replayed(ranks, pattern), 1 << 16), "word string, ids array<int>").toArrow()
    ids = found.column("ids").combine_chunks()
    return uuid.uuid4().hex, found.column("word").to_pylist(), np.asarray(ids.value_lengths(), np.int64), np.asarray(ids.flatten(), np.int32)


def _digest(ranks: str, pattern: str, with_ids: bool, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = loaded(rank_file(ranks), pattern)
        replay.know(*table)
        for x in batches:
            n, ids_sha, bytes_sha, kept = [], [], [], []
            for parts in replay.encode_all(t.as_py() or "" for t in x.column(1)):
                a, b, size = hashlib.sha256(), hashlib.sha256(), 0
                for part in parts:
                    ids = part.tolist()
                    if ids:
                        a.update(("," * bool(size) + ",".join(map(replay.text_of.__getitem__, ids))).encode())
                        b.update(replay.decode(ids))
                    size += len(ids)
                n.append(size), ids_sha.append(a.hexdigest()), bytes_sha.append(b.hexdigest())
                if with_ids:
                    kept.append(np.concatenate([*parts, np.zeros(0, np.int32)]))
            cols = [x.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        replay.know("", [], np.zeros(0, np.int64), np.zeros(0, np.int32))  # the worker lives on, maybe for stages that need the memory
        replay.forget()

    return run


def encode(
    docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", corpus_pieces: int = CORPUS_PIECES
) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ranks: a file of public_tokenizers or a path that every executor can open. Two passes over the texts: one counts
    their pieces (only pieces and counts are shuffled), one encodes. Null is empty (0 tokens, digests of nothing); texts of over
    BATCH_CHARS characters go in portions of words; a null id stays null; repeated rows each give a row; empty tables give
    no rows; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    pattern = pattern or public_tokenizers.PATTERN
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = corpus_table(rows, ranks, pattern, corpus_pieces)
    return rows.mapInArrow(trimmed(_digest(ranks, pattern, with_ids, table), 2048), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded): the bytes of each row's ids; null and empty ids give no bytes."""
    prepare(encoded.sparkSession)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = loaded(rank_file(ranks), pattern)
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([replay.decode(v.as_py() or []) for v in x.column(1)], pa.binary())], ["id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), "ids").mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
