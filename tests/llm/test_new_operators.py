"""Fill-in-middle, importance resampling and learned partitions against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kausal.llm import ann, fim, resample

ODD = [None, "", "\n", "\n\n", "x", "a\nb", "a\nb\n", "has <S> inside\nand more", "cut < P>\n<P\n", "日本語\n🎉é\n" * 7, "one line only", "w\n" * 300, "<", "tail<M>"]


def draw(seed, i, k):
    return int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16)


def plain_fim(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted(draw(seed, i, k) % (n + 1) for k in (0, 1))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or draw(seed, i, 2) % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if draw(seed, i, 3) % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("chunk", "giant", "rate"), [(1 << 18, 4 << 20, 100), (3, 1 << 20, 100), (5, 12, 60), (64, 0, 100)])
def test_fill_in_middle_is_the_plain_cut(spark, chunk, giant, rate):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "é", "\n", "<", "P", ">", "<P", " "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id\nat all\n", "y"), (3, "again\nid\n", "z"), (3, "again\nid\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fim.fill_in_middle(df, rate=rate, chunk=chunk, giant=giant).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, t or "", *plain_fim(i, t, rate=rate)) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert all(r.back == r.text for r in got)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_chunk_functions_compose():
    """Any cut of a text into chunks gives the states and counts of the whole, from every entry state."""
    a, rng = fim.automaton(), random.Random(6)
    for _ in range(200):
        raw = np.frombuffer("".join(rng.choice("a\n<PSM>") for _ in range(rng.randrange(1, 40))).encode(), np.uint8)
        state, units = np.arange(a.states), np.zeros(a.states, int)
        for byte in raw:
            c = a.classes[byte]
            units, state = units + a.begins[c, state], a.step[c, state].astype(int)
        f, n = fim.scan(a, raw)
        assert f.tolist() == state.tolist() and n.tolist() == units.tolist()
        at = rng.randrange(len(raw) + 1)
        (f1, n1), (f2, n2) = fim.scan(a, raw[:at]), fim.scan(a, raw[at:])
        assert f2[f1].tolist() == f.tolist() and (n1 + n2[f1]).tolist() == n.tolist()
        assert a.found[f[0]] == any(m in raw.tobytes() for m in (b"<P>", b"<S>", b"<M>"))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(words, n):
    return [" ".join(words[k : k + m]) for m in range(1, n + 1) for k in range(len(words) - m + 1)]


def plain_scores(rows, target, n, buckets, seed=7):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in grams(words_of(t), n))
    s, t = count([x for _, x in rows]), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        own = grams(words_of(text), n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        out.append((i, len(words_of(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((draw(seed, i, 0) + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize(("n", "portion"), [(2, 1 << 22), (2, 40), (1, 16), (3, 25)])
def test_importance_is_the_plain_count(spark, n, portion):
    rng = random.Random(8)
    letters = ["alpha", "Beta", "ÉTÉ", "été", "日本", "a1", "x\x00y", "don't", "--", "end.", "B\x7fC"]
    rows = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(50)))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (93, "solo"), (None, "alpha beta " * 15), (5, "alpha " * 30), (5, "alpha " * 30), (94, "z" * 500)]
    target = ["Alpha beta alpha", None, "été " * 9]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance(df, goal, words=n, buckets=50, portion=portion)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain_scores(rows, target, n, 50), key=str)
    ranked = resample.resampled(df, goal, percent=40, least_words=20, words=n, buckets=50, portion=portion).collect()
    able = sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked if r.n_words >= 20)
    drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in ranked if r["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, 40 * len(able) // 100 + 1)) and [d[1:] for d in drawn] == able[: len(drawn)] and len(ranked) == len(rows)
    kept = resample.draw(df, goal, percent=40, words=n, buckets=50, portion=portion)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in ranked if r["rank"] is not None and r.doc_id is not None}
    assert resample.resampled(df.limit(0), goal).count() == 0


def test_resampling_without_a_target(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u"), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in resample.resampled(df, df.limit(0), percent=100).collect()}
    assert got[1]["rank"] == 1 and got[2]["rank"] is None and got[1].n_features == 41


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in sorted(range(len(x)), key=lambda i: (d[i], ids[i] is None, ids[i] or 0)) if ids[i] != ids[q]]
        out[ids[q]] = [(ids[i], d[i]) for i in order[:k]]
    return out


def test_nearest_of_clusters_ties_and_odd_vectors(spark):
    """Copies of one vector are a third of the rows, so ties fill whole lists; few parts hold a cluster's neighbours."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 4
    x = np.concatenate([centres[rng.integers(12, size=1200)] + rng.normal(size=(1200, 8)) * 0.3, np.tile(centres[0], (600, 1))]).astype(np.float32)
    order = rng.permutation(len(x))
    x = x[order]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8]
    other = [[1.0, float(k)] for k in range(5)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000 + i, v, 1) for i, v in enumerate(odd)] + [(6000 + i, v, 2) for i, v in enumerate(other)] + [(None, x[0].tolist(), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    lists = {q: [v[k] for k in sorted(v)] for q, v in got.items()}
    want = brute([*range(len(x)), None], np.vstack([x, x[:1]]).astype(float), range(0, len(x), 50), 10)
    assert set(lists) == set(want) | {6000}
    assert lists[6000] == [(6000 + k, float(k)) for k in range(1, 5)]  # all of its length
    hits = sum(len({a for a, _ in lists[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q in want:
        if [a for a, _ in lists[q]] == [a for a, _ in want[q]]:
            assert np.allclose([s for _, s in lists[q]], [s for _, s in want[q]], rtol=1e-12, atol=0)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id >= 5000 and vec_id < 5006"), F.lit(True)).count() == 0


def test_nearest_in_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 4)))], "vec_id long, embedding array<double>").cache()
    whole = ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 4 * 30)
    assert sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()) == sorted(whole)


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(16, 6))[rng.integers(16, size=2048)] * 5 + rng.normal(size=(2048, 6)) * 0.2
    graph = ann.neighbour_graph(x, 10)
    label = ann.balanced_parts(x, graph, 8, rng)
    assert np.ptp(np.bincount(label, minlength=8)) <= 1 and (label[graph] == label[:, None]).mean() > 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    """Recall against all pairs, on vectors without clusters."""
    d = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    want = brute(ids, x, [k for k, i in enumerate(ids) if i % 100 == 0], 10)
    got = {}
    for r in ann.op13_nearest(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(got[q] & {a for a, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
