"""Language identification by hierarchical discrimination (operator 2).

A linear support vector machine for each family predicts the family; within it, one-versus-one machines tell the
languages apart. Features are hashed n-grams of one to three characters of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, named, prepare, trimmed
from .words import MOST_VALUES, Rows, gathered, sampled

#: Slots of the n-grams; most texts of each language that are learned from; characters taken at once.
BITS, PER_LANG, PORTION = 13, 400, 1 << 20
#: Least score of a text that the filter keeps: under it, another language than the predicted one is the likelier.
LEAST_SCORE = 0.5
UNDETERMINED = "und"
# Families of languages by ISO 639-1 code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
    "indo_aryan": "hi bn ur mr pa gu ne",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def char_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts of n-grams of 1 to 3 characters by slot, other characters than letters as one space; whether there is a letter."""
    counts, any_letter = np.zeros(1 << BITS), False
    for k in range(0, len(text), PORTION):
        part = text[max(0, k - 2) : k + PORTION].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[c]
        any_letter |= bool(is_letter.any())
        c = np.where(is_letter, c, np.uint32(32))
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep].astype(np.uint32)
        with np.errstate(over="ignore"):
            one = c * np.uint32(0x9E3779B1)
            two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + c[1:] * np.uint32(0x85EBCA6B)
            three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(33) + c[2:] * np.uint32(0xC2B2AE35)
            grams = np.concatenate([one, two * np.uint32(0x9E3779B1), three * np.uint32(0x9E3779B1)])
        counts += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts, any_letter


def _features():
    def f(text: str):
        counts, _ = char_counts(text)
        at = np.flatnonzero(counts)
        v = np.sqrt(counts[at])
        return at.astype(np.int32), v / max(np.sqrt((v * v).sum()), 1e-12)

    return f


def svm(rows: Rows, of: np.ndarray, y: np.ndarray, size: int, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss on the rows `of`, by dual coordinate descent; the last weight is
    the bias. Rows stay sparse."""
    n = len(of)
    w, alpha, bias = np.zeros(size + 1), np.zeros(n), size
    own = [(rows.cols[a:b], rows.vals[a:b]) for a, b in zip(rows.starts[of], rows.starts[of + 1], strict=True)]
    norms = np.array([float(v @ v) + 1 for _, v in own])
    diag, rng = 1 / (2 * c), np.random.RandomState(11)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            cols, vals = own[i]
            g = y[i] * (vals @ w[cols] + w[bias]) - 1 + diag * alpha[i]
            new = max(0.0, alpha[i] - g / (norms[i] + diag))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[cols] += step * vals
                w[bias] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    pair_w: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        v = np.sqrt(counts)
        v = np.append(v / max(np.sqrt((v * v).sum()), 1e-12), 1.0)
        squash = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        p = squash(self.family_w @ v)
        p = p / p.sum()
        k = int(p.argmax())
        langs = list(self.families.values())[k]
        votes = {a: 0.0 for a in langs}
        for a, b in combinations(langs, 2):
            s = float(squash(self.pair_w[a, b] @ v))
            votes[a] += s
            votes[b] += 1 - s
        best = max(langs, key=lambda a: (votes[a], a))
        share = votes[best] / sum(votes.values()) if len(langs) > 1 else 1.0
        return best, float(p[k] * share)


def fit(docs: DataFrame, may_learn, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = MOST_VALUES) -> Model | None:
    """A model of the languages of the rows where may_learn holds; at most per_lang texts of each of the
    `languages` most frequent, chosen by hashed id. Of an id that several rows have, the least language and the least
    text count. None if nothing can be learned."""
    known = docs.where(may_learn).where(named(lang_col).isNotNull() & named(text_col).isNotNull() & named(id_col).isNotNull())
    langs, rows = gathered(known, sampled(known, lang_col, per_lang, id_col, languages), _features, id_col, text_col)
    if not langs:
        return None
    names, size, every = np.array(langs), 1 << BITS, np.arange(rows.n)
    model = Model()
    for a in sorted(set(langs)):
        model.families.setdefault(FAMILY_OF.get(a, a), []).append(a)
    family = np.array([FAMILY_OF.get(a, a) for a in langs])
    one = len(model.families) == 1
    model.family_w = np.array([np.zeros(size + 1) if one else svm(rows, every, np.where(family == f, 1.0, -1.0), size) for f in model.families], np.float32)
    for own in model.families.values():
        for a, b in combinations(own, 2):
            of = np.flatnonzero((names == a) | (names == b))
            model.pair_w[a, b] = svm(rows, of, np.where(names[of] == a, 1.0, -1.0), size).astype(np.float32)
    return model


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for text in x.column(1).to_pylist():
                counts, any_letter = char_counts(text or "")
                out.append(model.predict(counts) if model and any_letter else (UNDETERMINED, 0.0))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score. Null texts and those without a letter are `und` with score 0, as is
    everything if there was nothing to learn from; null ids stay null; repeated rows each give a row; of languages with
    equal votes the last by name is taken; whole texts are read in portions; empty tables give no rows; other columns are
    not looked at."""
    prepare(docs.sparkSession)
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_predict(model)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def learning(docs: DataFrame, id_col: str = "doc_id"):
    return crc_mod(id_col, 4) != 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prepare(spark)
    found = identify(docs, fit(docs, learning(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: set[str] | None = None, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay. Decided row by row, without a shuffle.

    A row stays if its predicted language is one of `languages` (None: any learned one) with at least least_score, by default
    a half: texts go for which all other languages together are likelier than the predicted one, as of a few letters or
    of several languages. `und` (null texts and those without a letter) goes. Without a learnable row there is no model: then texts with a letter stay.
    """
    prepare(docs.sparkSession)
    model = fit(docs, learning(docs, id_col), id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for text in x.column(at).to_pylist():
                counts, any_letter = char_counts(text or "")
                if any_letter and model:
                    lang, score = model.predict(counts)
                    any_letter = score >= least_score and (languages is None or lang in languages)
                keep.append(any_letter)
            yield x.filter(pa.array(keep, pa.bool_()))

    placed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots
    return placed.mapInArrow(trimmed(run), docs.schema)
