"""Mixing to target weights by soft membership (operator 7).

A classifier learned from the labelled table gives each text a posterior over domains. A text's rate is the number of
times it is to be used; projected gradient steps on the distributed rates, in the least squares of the expected tokens of
each domain (rate x tokens x posterior) against the targets, find the rates. The rates
follow from one pull a domain, as the projection max(least, 1 + posterior . pull), and are never stored. A step is a damped
Newton step on the pulls: the gradient of the misfit, scaled by the inverse of the domains' Gram matrix over the rows that
aren't at their bound, and cut until the slope along it has fallen; restarts from the pulls reached take the regularisation off again.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, digest_of, fresh, prepare, trimmed
from .words import Rows, WordTable, gathered, portions, sampled, slots, three_hashes

#: Slots of the features; most labelled texts of each domain; steps of the classifier; passes over the
#: rates that are usual at most (ten times as many are an error).
BITS, PER_DOMAIN, FIT_STEPS, RATE_STEPS = 17, 1500, 150, 40
#: Pull of the classifier's weights to zero; tokens over the least total when every row is to be used at least once.
L1, HEADROOM = 4e-4, 1.02
#: Most of the total that a domain may be off its target; pull of the rates' search to its centre.
MISFIT, PROX = 1e-6, 1e-6
DOMAINS = ("clean", "low_quality", "toxic")
#: Production targets: shares of the tokens.
TARGETS = {"clean": 0.78, "low_quality": 0.12, "toxic": 0.10}


def domain_of(quality: str = "quality", toxic: str = "toxic"):
    return F.when(F.col(quality) == 0, "low_quality").when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "clean")


def domain_rows():
    """A function from the bytes of a text to (slots, values, number of words): which bare words and beginnings of words it
    has, each counting alike in texts of any length, and the damped shares of its word shapes; fit_domains keeps few words,
    so that a long text is not sure of its domain by chance words."""
    table = WordTable(three_hashes, 3)

    def f(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        found, total, repeats, last = [], 0, 0, None
        for words in portions(raw):
            rows = table.numbers(words)
            if not len(rows):
                continue
            bare = table.hashes[rows, 0]
            repeats += int((bare[1:] == bare[:-1]).sum()) + int(last is not None and last == bare[0])
            total, last = total + len(rows), bare[-1]
            kinds, n = np.unique(rows, return_counts=True)
            found.append((table.hashes[kinds].T, n))
        hashes = np.concatenate([h for h, _ in found], axis=1) if found else np.zeros((3, 0), np.uint64)
        n = np.concatenate([n for _, n in found]) if found else np.zeros(0)
        cols, _ = slots(hashes[:2].ravel(), BITS - 1)
        shape_cols, at = np.unique((hashes[2] >> np.uint64(65 - BITS)).astype(np.int32), return_inverse=True)
        v = np.sqrt(np.bincount(at, n, minlength=len(shape_cols)) / max(1, total))
        again = np.sqrt(np.array([repeats / (total - 1) if total > 1 else 0.0, 0.0]))
        return (
            np.concatenate([cols, shape_cols + (1 << (BITS - 1)), [1 << BITS, (1 << BITS) + 1]]).astype(np.int32),
            np.concatenate([np.ones(len(cols)), 4 * v, 4 * again]),
            total,
        )

    return f


def domain_features():
    f = domain_rows()
    return lambda text: f(text.encode())[:2]


@dataclass
class Domains:
    names: list[str]
    w: np.ndarray
    b: np.ndarray
    learned: list[str]

    def posterior(self, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        m = self.w[:, cols] @ vals + self.b
        e = np.exp(m - m.max())
        return e / e.sum()


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> Domains:
    """Sparse softmax regression on labelled (id, domain); at most per_domain texts of each, chosen by hashed id, weighted to the
    shares of the labelled table. A label counts once for each id, of several the first by name. Domains without a labelled
    text are not told. Without any label every domain is alike, and `learned` is empty."""
    known = labelled.where(F.col("domain").isNotNull()).select(F.col(f"`{id_col}`"), "domain")
    share = dict(tuple(r) for r in known.where(F.col(f"`{id_col}`").isNotNull()).groupBy("domain").count().collect())  # one number a domain
    keys, rows = gathered(docs, sampled(known, "domain", per_domain, id_col), domain_features, id_col, text_col)
    names = list(DOMAINS) if set(keys) <= set(DOMAINS) else sorted(set(keys))
    size = (1 << BITS) + 2
    if not keys:
        return Domains(names, np.zeros((len(names), size), np.float32), np.zeros(len(names)), [])
    y = np.array([names.index(k) for k in keys])
    weight = np.array([share[names[k]] / max(1, (y == k).sum()) for k in y], float)
    w, b = softmax(_often(rows, size), y, weight / weight.sum(), len(names), size)
    return Domains(names, w.astype(np.float32), b, sorted(set(keys)))


def softmax(rows: Rows, y: np.ndarray, weight: np.ndarray, k_names: int, size: int, steps: int = FIT_STEPS, rate: float = 0.05, l1: float = L1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression on weighted rows; Adam with soft thresholds, so that most weights are zero."""
    w, b = np.zeros((k_names, size)), np.zeros(k_names)
    m, v = np.zeros((k_names, size + 1)), np.zeros((k_names, size + 1))
    for t in range(1, steps + 1):
        z = np.array([rows.dot(w[k]) + b[k] for k in range(k_names)])
        p = np.exp(z - z.max(axis=0))
        p /= p.sum(axis=0)
        for k in range(k_names):
            d = (p[k] - (y == k)) * weight
            g = np.append(rows.back(d, size), d.sum())
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            pace = rate / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-4)
            step = pace * m[k] / (1 - 0.9**t)
            w[k] -= step[:-1]
            w[k] = np.sign(w[k]) * np.maximum(0, np.abs(w[k]) - pace[:-1] * l1)
            b[k] -= step[-1]
    return w, b


def _often(rows: Rows, size: int) -> Rows:
    """rows without the slots that fewer than four of them have."""
    keep = (np.bincount(rows.cols, minlength=size) >= 4)[rows.cols]
    rows.cols, rows.vals, rows.row = rows.cols[keep], rows.vals[keep], rows.row[keep]
    return rows


def posteriors(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """(id, digest, tokens, p): the digest of the text if asked for, words between ASCII white space, and an array with the
    posterior of each domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = domain_rows()
        for x in batches:
            p, n = [], []
            for raw in x.column(2).to_pylist():
                cols, vals, words = f(raw or b"")
                p.append(model.posterior(cols, vals))
                n.append(words)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["id", "digest", "tokens", "p"])

    prepare(docs.sparkSession)
    digest = digest_of(f"`{text_col}`") if with_digest else F.lit(None).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("digest"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, digest binary, tokens long, p array<double>")


def rates(soft: DataFrame, targets: dict[str, float], names: list[str], total: float | None = None, least: float = 0.0, steps: int = 10 * RATE_STEPS) -> tuple[DataFrame, list[np.ndarray]]:
    """soft with the column rate, and the domains' totals at each pass, the last those of the rates returned.

    Of all rates of at least `least` whose totals S = sum(rate * tokens * p) meet T = total * targets, those nearest to
    1 (to `least` if that is more) in the sum of tokens * (rate - 1)^2: a row's rate is max(least, 1 + p . pull), with one
    pull a domain, so rates are never stored or moved. Scaled gradient steps on the rows over `least` find the pulls; each pass
    sends k * (k + 3) / 2 numbers to the driver. The pull of G = sum(tokens * p * p') on the pulls, PROX, is taken
    off again by renewed centres, until no domain is over MISFIT of the total off. Targets out of reach: the centres
    stop helping, the totals are then as near (measured by the inverse of G) as they get, and a warning says how far
    off. The pulls are then large (misfit / PROX), so a turn ends when its next step is lost in the rounding of the
    totals that they give, or of themselves: values could no longer be told apart. Not settled after `steps` passes: an error. Without a total: the tokens as they are, or, with a positive
    least rate, HEADROOM times the least total for which no domain has to shrink: at that total itself texts of mixed
    posteriors would have to fall below `least`.
    """
    k, base = len(names), max(1.0, float(least))
    t = np.array([targets.get(n, 0.0) for n in names])
    t = t / t.sum()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    history: list[np.ndarray] = []

    def rate(pull: np.ndarray):
        return F.greatest(F.lit(float(least)), sum((F.col("p")[i] * F.lit(float(pull[i])) for i in range(k)), F.lit(base)))

    def measure(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The totals, and sum(tokens * p * p') of the rows that may move."""
        if len(history) >= steps:
            raise ArithmeticError(f"mixing: not settled after {steps} passes, totals {history[-1].tolist()}")
        found = soft.select("tokens", "p", rate(pull).alias("r")).withColumn("_w", F.when((F.col("r") > float(least)) | F.lit(not pull.any()), F.col("tokens")).otherwise(0))
        sums = [F.col("r") * F.col("tokens") * F.col("p")[i] for i in range(k)] + [F.col("_w") * F.col("p")[i] * F.col("p")[j] for i, j in pairs]
        got = np.array([x or 0.0 for x in found.agg(*map(F.sum, sums)).first()])
        h = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:], strict=True):
            h[i, j] = h[j, i] = x
        history.append(got[:k])
        return got[:k], h

    pull = np.zeros(k)
    s, g = measure(pull)
    h, natural = g, s / base
    if total is None:
        total = float(natural.sum()) if least <= 0 else HEADROOM * float(max((natural[i] * least / t[i] for i in range(k) if t[i] > 0), default=0.0))
    off = lambda x: float(np.abs(x - total * t).max())
    last, turn = np.inf, 0
    while s.any() and off(s) > MISFIT * total and off(s) <= last / 2:
        last, centre, turn = off(s) if turn else np.inf, pull, turn + 1
        slope_at = lambda x, s, c=centre: s - total * t + PROX * g @ (x - c)
        slope = slope_at(pull, s)
        while off(s) > MISFIT * total:
            step = -np.linalg.pinv(h + PROX * g, rcond=1e-12, hermitian=True) @ slope
            fall, rounding = -slope @ step, 8 * np.finfo(float).eps * (g @ np.abs(pull) + natural + total * t)
            if fall <= max(1e-14 * total, np.abs(step) @ rounding) or np.abs(step).max() <= 1e-12 * np.abs(pull).max():
                break
            size = 1.0
            new = measure(pull + step)
            while (along := slope_at(pull + size * step, new[0]) @ step) > fall / 2 and size > 1e-6:
                size *= max(0.1, min(0.5, fall / (fall + along)))
                new = measure(pull + size * step)
            if size <= 1e-6:  # no flatter slope to be told from rounding
                history.append(s)
                break
            pull, (s, h) = pull + size * step, new
            slope = slope_at(pull, s)
    if s.any() and off(s) > MISFIT * total:
        shares = {n: (round(float(x), 6), round(float(y), 6)) for n, x, y in zip(names, s / total, t, strict=True)}
        warnings.warn(f"mixing: targets out of reach with rates of at least {least}; of {total:.0f} tokens (share, target): {shares}", RuntimeWarning, stacklevel=2)
    return soft.withColumn("rate", rate(pull)), history


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, least: float, total: float | None, id_col: str, text_col: str, with_digest: bool = False) -> tuple[DataFrame, Domains]:
    """(id, digest, tokens, p, rate) of every row, and the model."""
    model = fit_domains(docs, labels.select(F.col(f"`{id_col}`"), domain_of().alias("domain")), id_col, text_col)
    soft = cut(posteriors(docs, model, id_col, text_col, with_digest), "posteriors")
    wanted = targets or TARGETS
    if not model.learned:
        warnings.warn("mixing: no labels, every row is used once", RuntimeWarning, stacklevel=3)
        return soft.withColumn("rate", F.lit(1.0)), model
    if lost := [n for n in wanted if wanted[n] > 0 and n not in model.learned]:
        warnings.warn(f"mixing: no labelled text of {lost}; the others share its target", RuntimeWarning, stacklevel=3)
        wanted = {n: v for n, v in wanted.items() if n in model.learned}
    return rates(soft, wanted, model.names, total, least)[0], model


def mixed_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0, total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, tokens, p_<domain> and rate.

    Null and empty texts have no tokens and get the rate that their posterior gives; null ids stay null; repeated
    rows each count; empty tables give no rows; other columns are not looked at. Targets out of reach are warned of, as
    are domains without a label, whose targets go to the others; without any label every rate is 1.
    """
    found, model = rated(docs, labels, targets, least, total, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "tokens", *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(model.names)], "rate")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixed_rates(docs, labels)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its rate says, at least once: the whole part, and once more with the probability
    of the rest, decided by a hash of the id and the text. All columns stay, whatever their names; repeated rows are
    repeated alike; rows with a null id count as others do; without labels docs come back as they are."""
    found, model = rated(docs, labels, targets, 1.0, None, id_col, text_col, with_digest=True)
    if not model.learned:
        return docs
    luck = F.pmod(F.xxhash64(F.lit("mix"), "id", "digest"), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    often = found.select("id", "digest", times.alias("times")).where("times > 1").groupBy("id", "digest").agg(F.max("times").alias("_times"))
    key, digest, copy = fresh(docs, "row_id"), fresh(docs, "row_digest"), fresh(docs, "row_copy")
    keyed = docs.withColumns({key: F.col(f"`{id_col}`").cast("long"), digest: digest_of(f"`{text_col}`")})
    o = often.select(F.col("id").alias(fresh(keyed, "often_id")), F.col("digest").alias(fresh(keyed, "often_digest")), F.col("_times").alias(fresh(keyed, "often_times")))
    i, d, n = o.columns
    joined = keyed.join(o, F.col(key).eqNullSafe(F.col(i)) & (F.col(digest) == F.col(d)), "left")
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.coalesce(F.col(n), F.lit(1))))).select(*[F.col(f"`{c}`") for c in docs.columns])
