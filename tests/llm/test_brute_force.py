"""Queries that SQL can't express against plain versions: dense, sequential, all pairs."""

import hashlib
import itertools
import math
import random
import warnings
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kausal.llm import bpe, langid, minhash, mixing, quality, toxicity, words
from kausal.llm.common import WordHashes, crc_mod_py

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, name, d=SMALL):
    return spark.read.parquet(f"{d}/{name}.parquet")


def in_learning_order(rows, features):
    """(value, columns, values) as the operators learn from them: by value, then by a hash of the features."""
    import xxhash

    found = [(v, *(np.asarray(x, k) for x, k in zip(features(t or ""), (np.int32, np.float32), strict=True))) for v, t in rows]
    return sorted(found, key=lambda x: (str(x[0]), xxhash.xxh3_64_intdigest(x[1].tobytes() + x[2].tobytes())))


def dense(found, size):
    cols = np.unique(np.concatenate([c for _, c, _ in found]))
    x = np.zeros((len(found), len(cols)))
    for k, (_, c, v) in enumerate(found):
        x[k, np.searchsorted(cols, c)] = v
    return x, cols


def logistic(m):
    return 1 / (1 + np.exp(-m))


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_sample_is_the_least_hashes(spark, most):
    rng = random.Random(4)
    rows = [(rng.randrange(900), rng.choice(["a", "a", "a", "a", "b", "b", "c", None])) for _ in range(3000)] + [(5, "a")] * 400 + [(None, "a")] * 9
    df = spark.createDataFrame(rows, "doc_id long, kind string")
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    least = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None:
            least[i].append(v)
    want = set()
    for v in "abc":
        own = sorted((h[i], i) for i, vs in least.items() if min(vs) == v)
        want |= {(i, v) for _, i in own[:most]}
    got = words.sampled(df, "kind", most)
    assert len(got) == len(set(got)) and set(got) == want
    assert words.sampled(df.limit(0), "kind", most) == []


def test_sample_plans_no_window_and_bounds_its_values(spark):
    """Of over 1,024 values the most frequent are sampled, ties to the least; an id counts under the least of those."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.format_string("%04d", "id").alias("kind")).union(spark.createDataFrame([(k, "4999") for k in range(9000, 9009)], "doc_id long, kind string"))
    got = words.sampled(df.union(spark.createDataFrame([(9000, "2500")], "doc_id long, kind string")), "kind", 3)
    assert {v for _, v in got} == {"4999"} | {f"{k:04d}" for k in range(1022)} | {"2500"}
    assert sorted(got) == sorted(set(got)) and all(v != "2500" or i == 2500 for i, v in words.sampled(df, "kind", 3))


def test_language_query_is_the_dense_machines(spark):
    docs = [r.asDict() for r in table(spark, "documents").collect()]
    found = in_learning_order([(r["lang"], r["text"]) for r in docs if crc_mod_py(r["doc_id"], 4) != 2 and r["lang"] and r["text"] is not None], langid._features())
    x, cols = dense(found, 1 << langid.BITS)
    x = np.column_stack([x, np.ones(len(x))])
    names = np.array([v for v, _, _ in found])

    def machine(of, y, c=10.0):
        w, alpha, rng, diag = np.zeros(x.shape[1]), np.zeros(len(of)), np.random.RandomState(11), 1 / 20
        for _ in range(30):
            moved = 0.0
            for i in rng.permutation(len(of)):
                row = x[of[i]]
                new = max(0.0, alpha[i] - (y[i] * (row @ w) - 1 + diag * alpha[i]) / (row @ row + diag))
                w += (new - alpha[i]) * y[i] * row
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
            if moved < 1e-3:
                break
        return w

    family = np.array([langid.FAMILY_OF.get(v, v) for v in names])
    order = list(dict.fromkeys(langid.FAMILY_OF.get(v, v) for v in sorted(set(names))))
    every = np.arange(len(x))
    family_w = {f: machine(every, np.where(family == f, 1.0, -1.0)) for f in order}
    got = {r.doc_id: r for r in langid.op2_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        counts, letters = langid.char_counts(r["text"] or "")
        assert got[r["doc_id"]].held_out == (crc_mod_py(r["doc_id"], 4) == 2)
        if not letters:
            assert (got[r["doc_id"]].lang_pred, got[r["doc_id"]].score) == ("und", 0.0)
            continue
        v = np.sqrt(counts)
        v = np.append((v / np.sqrt((v * v).sum()))[cols], 1.0)
        p = {f: float(logistic(4 * (w @ v))) for f, w in family_w.items()}
        best = max(p, key=p.get)
        langs, votes = sorted(set(names[family == best])), Counter()
        for a in langs:
            for b in langs:
                if a < b:
                    of = np.flatnonzero((names == a) | (names == b))
                    s = logistic(4 * (machine(of, np.where(names[of] == a, 1.0, -1.0)) @ v))
                    votes[a] += s
                    votes[b] += 1 - s
        lang = max(langs, key=lambda a: (votes[a], a))
        score = p[best] / sum(p.values()) * (votes[lang] / sum(votes.values()) if len(langs) > 1 else 1)
        if len(docs) > 60 and r["doc_id"] % 4:  # pairs are trained anew for each text here: a quarter of them is enough
            continue
        assert got[r["doc_id"]].lang_pred == lang and got[r["doc_id"]].score == pytest.approx(score, abs=2e-3)


def test_quality_query_is_a_plain_ftrl_loop(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    rows = [(r.quality, docs[r.doc_id]) for r in table(spark, "labels").collect() if crc_mod_py(r.doc_id, 5) != 0]
    found = in_learning_order(rows, quality.quality_features())
    z, n, z0, n0, alpha, l1, l2 = defaultdict(float), defaultdict(float), 0.0, 0.0, 0.5, 0.02, 0.1

    def weight(c):
        return 0.0 if abs(z[c]) <= l1 else -(z[c] - math.copysign(l1, z[c])) / ((1 + math.sqrt(n[c])) / alpha + l2)

    rng = np.random.RandomState(3)
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(found)):
            y, cols, vals = found[k]
            w, b = [weight(c) for c in cols.tolist()], -z0 / ((1 + math.sqrt(n0)) / alpha)
            g0 = 1 / (1 + math.exp(-max(-35, min(35, sum(a * v for a, v in zip(w, vals.tolist(), strict=True)) + b)))) - y
            for c, v, a in zip(cols.tolist(), vals.tolist(), w, strict=True):
                g = g0 * v
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha * a
                n[c] += g * g
            z0 += g0 - (math.sqrt(n0 + g0 * g0) - math.sqrt(n0)) / alpha * b
            n0 += g0 * g0
    bias, features = -z0 / ((1 + math.sqrt(n0)) / alpha), quality.quality_features()
    got = quality.op8_quality(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        cols, vals = features(docs[r.doc_id] or "")
        want = logistic(sum(weight(c) * float(v) for c, v in zip(cols.tolist(), vals, strict=True)) + bias)
        assert r.score == pytest.approx(want, abs=1e-4) and r.predicted == int(r.score >= 0.3) and r.held_out == (crc_mod_py(r.doc_id, 5) == 0)


def test_toxicity_query_is_a_dense_nnpu(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    labels = [r for r in table(spark, "labels").collect() if crc_mod_py(r.doc_id, 5) != 0]
    f = toxicity.toxic_features()
    found = [*in_learning_order([(1, docs[r.doc_id]) for r in labels if r.toxic == 1], f), *in_learning_order([(0, t) for i, t in docs.items() if crc_mod_py(i, 5) != 0], f)]
    pos, (x, cols) = np.array([v == 1 for v, _, _ in found]), dense(found, 1 << toxicity.BITS)
    prior = min(max(sum(r.toxic for r in labels) / len(labels), 1e-3), 0.5)
    a, u, every = x[pos].mean(axis=0), x[~pos].mean(axis=0), x.mean(axis=0)
    x *= np.abs(a - u) > toxicity.APART * np.sqrt(every * (1 - every) * (1 / pos.sum() + 1 / (~pos).sum()))
    w, b, m, v = np.zeros(x.shape[1]), math.log(prior / (1 - prior)), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, toxicity.STEPS + 1):
        g = np.clip(x @ w + b, -35, 35)
        s, loss = logistic(g), np.logaddexp(0, g)
        down = np.where(pos, -prior / pos.sum(), 1 / (~pos).sum()) * s
        d = np.where(pos, prior / pos.sum() * (s - 1), 0) + down if loss[~pos].mean() - prior * loss[pos].mean() >= 0 else -down
        grad = np.append(x.T @ d, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = 0.05 / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        step = pace * m / (1 - 0.9**t)
        w = w - step[:-1]
        w, b = np.sign(w) * np.maximum(0, np.abs(w) - pace[:-1] * 5e-5), b - step[-1]
    got = toxicity.op10_toxicity(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        own, _ = f(docs[r.doc_id] or "")
        at = np.searchsorted(cols, own)
        at = at[(at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == own)]
        assert r.score == pytest.approx(logistic(np.clip(w[at].sum() + b, -35, 35)), abs=1e-4) and r.predicted == int(r.score >= 0.5)


def test_toxicity_catches_most_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, d).where("held_out").join(table(spark, "labels", d), "doc_id").groupBy("toxic", "quality").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.p * r.n for r in toxic) >= 0.9 * sum(r.n for r in toxic)
    assert next(r.p for r in got if r.toxic == 0 and r.quality == 1) <= 0.02


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing_query_is_a_dense_projection(spark, least):
    """The rates nearest to 1 that meet the targets, by plain projected gradient on the pulls of the domains."""
    docs, labels = table(spark, "documents", MIDDLE), table(spark, "labels", MIDDLE)
    rows = (mixing.op7_mixing(spark, MIDDLE) if least == 0 else mixing.mixed_rates(docs, labels, least=least)).orderBy("doc_id").collect()
    p = np.array([[r[f"p_{n}"] for n in mixing.DOMAINS] for r in rows])
    tokens, rate = np.array([float(r.tokens) for r in rows]), np.array([r.rate for r in rows])
    target = np.array([mixing.TARGETS[n] for n in mixing.DOMAINS])
    natural = (tokens[:, None] * p).sum(axis=0)
    total = natural.sum() if least == 0 else mixing.HEADROOM * (natural / target).max()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert tokens.tolist() == [len((texts[r.doc_id] or "").encode().split()) for r in rows] and np.allclose(p.sum(axis=1), 1)
    assert np.abs((rate * tokens) @ p - total * target).max() <= 2e-6 * total
    weight, pull = tokens / tokens.sum(), np.zeros(3)
    pace = 1 / np.linalg.eigvalsh((weight[:, None] * p).T @ p).max()
    for _ in range(60_000):
        slope = (weight * np.maximum(least, 1 + p @ pull)) @ p - total / tokens.sum() * target
        pull -= pace * slope
        if np.abs(slope).max() < 1e-9:
            break
    assert np.abs(rate - np.maximum(least, 1 + p @ pull)).max() < 1e-3


def test_softmax_is_dense_adam(spark):
    rng = np.random.default_rng(1)
    x, y = (rng.random((40, 12)) < 0.3) * 1.0, rng.integers(0, 3, 40)
    rows = words.Rows([np.flatnonzero(r).astype(np.int32) for r in x], [r[r > 0].astype(np.float32) for r in x])
    w, b = mixing.softmax(rows, y, np.full(40, 1 / 40), 3, 12, steps=30)
    v, c, m, q = np.zeros((3, 12)), np.zeros(3), np.zeros((3, 13)), np.zeros((3, 13))
    for t in range(1, 31):
        e = np.exp(x @ v.T + c)
        d = (e / e.sum(axis=1, keepdims=True) - np.eye(3)[y]) / 40
        g = np.column_stack([d.T @ x, d.sum(axis=0)])
        m, q = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
        pace = 0.05 / (np.sqrt(q / (1 - 0.999**t)) + 1e-4)
        step = pace * m / (1 - 0.9**t)
        v = v - step[:, :-1]
        v, c = np.sign(v) * np.maximum(0, np.abs(v) - pace[:, :-1] * mixing.L1), c - step[:, -1]
    assert np.allclose(w, v) and np.allclose(b, c)


def test_mixing_without_labels_or_with_names_of_its_own(spark):
    texts = [(i, f"some words of text number {i}", i, "x") for i in range(10)] + [(None, "no id", 0, "y")]
    df = spark.createDataFrame(texts, "doc_id long, text string, _copy int, _rate string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(RuntimeWarning, match="no labels"):
        assert sorted(map(str, mixing.mix(df, none).collect())) == sorted(map(str, df.collect()))
        assert {r.rate for r in mixing.mixed_rates(df, none).collect()} == {1.0}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    with pytest.warns(RuntimeWarning, match="no labelled text of"):
        out = mixing.mix(df, labels)
        got = {tuple(r) for r in out.collect()}
    assert out.columns == df.columns and got == {tuple(r) for r in df.collect()} and mixing.mix(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("p", [minhash.QUERY, minhash.NearParams()])
def test_near_dedup_finds_the_links_of_all_pairs(spark, p):
    """Exact all pairs on the middle table, by whole sets of word strings. Lost links would show as other components."""
    docs = sorted((r.doc_id, r.text) for r in table(spark, "documents", MIDDLE).collect())
    comp, owners, sets = {i: i for i, _ in docs}, defaultdict(list), {}
    for i, t in docs:
        w = bytes((t or "").encode()).lower().split()
        sets[i] = {tuple(w[k : k + p.words]) for k in range(max(1, len(w) - p.words + 1))} if w else set()
        both = Counter(j for g in sets[i] for j in owners[g])
        for j, c in both.items():
            if 100 * c >= p.percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((comp[i], comp[j]))
                if a != b:
                    comp = {k: a if v == b else v for k, v in comp.items()}
        for g in sets[i]:
            owners[g].append(i)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(table(spark, "documents", MIDDLE), p).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i, _ in docs}


def test_near_copies_that_meet_in_most_bands_are_dealt_once(spark, monkeypatch):
    """A group that is in a bucket of nearly every band, and most of whose texts are a little under the threshold; two smaller
    groups. The links are those of all pairs."""
    rng, texts = random.Random(3), []
    for name, size in (("a", 400), ("b", 120), ("c", 30)):
        for _ in range(size):
            words = [f"{name}{i}" for i in range(150)]
            for i in rng.sample(range(150), rng.randrange(1, 8)):
                words[i] = f"x{rng.randrange(300)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 3]) for k in range(148)} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    dealt, in_cells = [], minhash.in_cells

    def counted(placed, p):
        dealt.append(in_cells(placed, p).count())
        return in_cells(placed, p)

    monkeypatch.setattr(minhash, "in_cells", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(df, minhash.NearParams(words=3, percent=85, chunk=50)).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp[:400])) > 20
    assert dealt[0] <= 40 * len(texts)


def test_rows_dealt_grow_with_a_cluster_not_with_its_square(spark):
    """A bucket of one large component and three strays that it doesn't link to."""
    p, counts = minhash.NearParams(chunk=100), {}
    for size in (1000, 4000):
        rows = [(7, 0, k, 500, k, k, (0, 500, 0, 0), 0 if k < size else k) for k in range(size + 3)]
        placed = spark.createDataFrame(rows, "bucket long, band int, node long, n long, s1 long, s2 long, h struct<node:long,n:long,s1:long,s2:long>, comp long")
        with minhash.temporary(spark):
            cells = minhash.in_cells(placed, p).collect()
        counts[size] = len(cells)
        assert size <= len(cells) / 2 <= 1.3 * size  # two classes of size, one chunk of strays
        met = defaultdict(lambda: defaultdict(set))
        for r in cells:
            met[r.cell][r.comp].add(r.node)
        for stray in range(size, size + 3):  # each stray meets every row
            assert set(range(size + 3)) - {stray} <= set().union(*(v for c in met.values() if stray in c for k, v in c.items() if k != stray))
    assert counts[4000] <= 4.2 * counts[1000]


def test_components_beside_each_other_meet_in_cells(spark):
    """Whatever the sizes of the components, any two rows of different ones share exactly one cell of a class on its two sides."""
    rng, p = random.Random(2), minhash.NearParams(chunk=4)
    comp = [c for c, size in enumerate([11, 1, 6, 2, 9, 1]) for _ in range(size)]
    rng.shuffle(comp)
    rows = [(7, 0, k, 500, k, k, (99, 500, 0, 0), c) for k, c in enumerate(comp)]
    placed = spark.createDataFrame(rows, "bucket long, band int, node long, n long, s1 long, s2 long, h struct<node:long,n:long,s1:long,s2:long>, comp long")
    with minhash.temporary(spark):
        cells = minhash.in_cells(placed, p).where("older = 0").collect()
    at = defaultdict(list)
    for r in cells:
        at[r.node].append((r.cell, r.side))
    for x in range(len(comp)):
        for y in range(x):
            shared = [(a, b) for c, a in at[x] for d, b in at[y] if c == d and (a != b or a == 2)]
            assert len(shared) == 1 if comp[x] != comp[y] else len(shared) <= 1


def test_pipeline_is_the_plain_stages(spark, tmp_path):
    """run() on a small corpus against a plain version of each stage, document by document."""
    import corpus_pipeline

    rng = random.Random(12)
    say = lambda n, lang: " ".join("".join(rng.choice({"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ei", "ch"]}[lang]) for _ in range(3)) for _ in range(n))
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        text = say(40, lang) + (" horrid scum" if i % 9 == 0 else "") + ("!!" * 9 if i % 7 == 0 else "")
        rows.append((i, text, lang, "s", len(text)))
    rows += [(100 + k, rows[k][1].upper(), "en", "s", 1) for k in range(5)]  # exact copies
    rows += [(110 + k, rows[10 + k][1] + " " + say(1, "en"), "en", "s", 1) for k in range(5)]  # near copies
    rows += [(120, None, "en", "s", 0), (121, "12 34 !", None, "s", 1), (122, "", "en", None, 0), (100, rows[0][1].upper(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 9 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")

    model = langid.fit(docs, langid.learning(docs))
    speaks = lambda t: (c := langid.char_counts(t or ""))[1] and model.predict(c[0])[1] >= langid.LEAST_SCORE
    left = [(r[0], r[1]) for r in rows if speaks(r[1])]
    best = {}
    for i, t in left:
        best[t.encode().lower()] = max(i, best.get(t.encode().lower(), i))
    left = sorted({(i, t) for i, t in left if best[t.encode().lower()] == i})
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.encode().lower().split()] for k in range(max(1, len(w) - 4))}
    comp = {i: i for i, _ in left}
    for i, s in left:
        for j, t in left:
            if j < i and 5 * len(shingles(s) & shingles(t)) >= 4 * len(shingles(s) | shingles(t)):
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if v == b else v for k, v in comp.items()}
    left = [(i, t) for i, t in left if comp[i] == i]
    assert 70 < len(left) < 95
    kept = docs.join(spark.createDataFrame(left, "doc_id long, text string"), ["doc_id", "text"]).dropDuplicates(["doc_id"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rate = {r.doc_id: r.rate for r in mixing.mixed_rates(kept, labels, least=1.0).collect()}
        got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect())
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in left:
        ids = e.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), tuple(ids)] = rate[i]
    assert got.keys() == want.keys()
    assert all(math.floor(r - 1e-6) <= got[k] <= math.ceil(r + 1e-6) for k, r in want.items())


def test_pipeline_stages_on_empty_and_dirty_tables(spark, tmp_path):
    """Nulls in every column, an extra column, repeated rows, no labels, and no rows at all."""
    import corpus_pipeline

    rows = [(1, "some plain words here", None, None, None, "x"), (1, "some plain words here", None, None, None, "x"), (None, "of no id", "en", "s", 1, None), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for df, n in ((docs, 2), (docs.limit(0), 0)):
            for name, stage in corpus_pipeline.STAGES:
                out = stage(spark, df, f"file://{tmp_path}")
                assert name == "bpe" or out.columns == df.columns
                df = spark.createDataFrame(out.collect(), out.schema)
            assert df.count() == n


def test_words_of_long_texts_come_in_portions(monkeypatch):
    raw = b" ".join(b"w%d" % (k % 977) for k in range(60_000))
    whole = words.all_hashes(raw, WordHashes())
    monkeypatch.setattr(words, "PORTION", 1 << 10)
    assert np.array_equal(words.all_hashes(raw, WordHashes()), whole) and len(whole) == 60_000
    counts, letter = langid.char_counts("Ab, c " * 1000)
    monkeypatch.setattr(langid, "PORTION", 6 * 100)
    parts, also = langid.char_counts("Ab, c " * 1000)
    assert letter and also and np.abs(parts - counts).sum() <= 40
