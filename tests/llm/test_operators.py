"""The pipeline operators against brute force, round trips and held-out rows on small tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kausal.llm import bpe, chat, common, components, embedding, exact_dedup, langid, minhash, mixing, quality, toxicity, warc

ODD = [None, "", " ", "x", "A b", "a B", "日本語 🎉", "\n\t", "é" * 300, "w " * 5000]


def docs(spark, texts):
    """With an extra column whose name the operators use inside."""
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, norm string")


def random_words(rng, n, words=200):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def test_bpe_is_the_library_s(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), 32, 10])) for _ in range(400)) for _ in range(20)]
    got = bpe.encode(docs(spark, texts))
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(got).collect()}
    for r in got.collect():
        ids = e.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert back[r.doc_id] == (texts[r.doc_id] or "").encode() and r.decoded_sha256 == hashlib.sha256(back[r.doc_id]).hexdigest()
    assert bpe.encode(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [0, 5, 1 << 18])
def test_bpe_of_repeated_rows_and_texts_in_portions(spark, most, monkeypatch):
    """The same ids whichever words are replayed for the whole corpus, and of texts over the size of a batch."""
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rng = random.Random(9)
    long = " ".join(f"wort{rng.randrange(10**6)}  ümlaut\n" for _ in range(300_000))
    assert len(long) > bpe.BATCH_CHARS
    texts = ["one two two three three three", "one two two three three three", long, None, "tail"]
    df = spark.createDataFrame([(1, t, "x") for t in texts], "doc_id long, text string, word string")
    got = bpe.encode(df, corpus_pieces=most).collect()
    want = sorted(hashlib.sha256(",".join(map(str, e.encode_ordinary(t or ""))).encode()).hexdigest() for t in texts)
    assert sorted(r.ids_sha256 for r in got) == want and sorted(r.n_tokens for r in got) == sorted(len(r.ids) for r in got)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in texts)


def test_merges_out_of_rank_order():
    """A table in which a merge opens a pair of lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"cd": 301, b"dd": 270}
    replay = bpe.Replay(ranks, r"\S+")
    words = [b"abcbcd", b"abcd", b"bcbc", b"dddd", b"abcabc"]
    assert replay.replay(words) == [replay.one(w) for w in words]


def test_exact_dedup(spark):
    texts = ODD + ["Same Text"] * 50 + ["same text"] * 50 + ["É", "é"]
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts)).collect()}
    key = lambda t: (t or "").encode().lower()
    for i, t in enumerate(texts):
        own = [j for j, u in enumerate(texts) if key(u) == key(t)]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(own), len(own), i == max(own))
        assert rows[i].text_sha256 == hashlib.sha256(key(t)).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, texts)).columns == ["doc_id", "text", "norm"]


DIRTY = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "A b c d e f g", "x"), (1, "wholly other words stand in here now", "y"), (2, "Wholly other words stand in here now", "z"),
         (None, "a b c d e f g", "x"), (None, "of a null id only", "x"), (None, "of a null id only", "w"), (3, None, "x"), (3, "", None), (4, " ", "x"), (5, "short", None)]


def test_dedup_stages_keep_one_row_of_each_group(spark):
    """Repeated rows, ids at several texts, null ids, and columns with names that are used inside."""
    df = spark.createDataFrame(DIRTY, "doc_id long, text string, digest string").withColumn("row_id", F.lit(1)).withColumn("label", F.lit("l")).withColumn("_n", F.lit(0))
    rows = lambda x: sorted(((r.doc_id, r.text) for r in x.collect()), key=str)
    first = min(("a b c d e f g", "A b c d e f g"), key=lambda t: hashlib.sha256(t.encode()).digest())
    exact = exact_dedup.drop_copies(df)
    assert exact.columns == df.columns
    assert rows(exact) == sorted([(1, first), (2, "Wholly other words stand in here now"), (None, "of a null id only"), (3, None), (4, " "), (5, "short")], key=str) or rows(exact) == sorted(
        [(1, first), (2, "Wholly other words stand in here now"), (None, "of a null id only"), (3, ""), (4, " "), (5, "short")], key=str)
    near = minhash.drop_near_copies(df)
    assert near.columns == df.columns
    assert rows(near) == sorted([(1, first), (1, "wholly other words stand in here now"), (None, "of a null id only"), (3, None), (3, ""), (4, " "), (5, "short")], key=str)
    assert exact_dedup.drop_copies(df.limit(0)).count() == minhash.drop_near_copies(df.limit(0)).count() == 0


def test_repeated_ids_do_not_multiply(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h"), (None, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(df, minhash.QUERY).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False)], key=str)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (1, 3, 2, False), (3, 3, 2, True)], key=str)
    assert minhash.near_dedup(df.limit(0), minhash.QUERY).count() == 0


@pytest.mark.parametrize("chunk", [1024, 7])
def test_near_dedup(spark, chunk):
    rng = random.Random(2)
    texts = list(ODD)
    for _ in range(6):
        base = random_words(rng, 60)
        for edits in (0, 0, 1, 1, 2, 3, 4, 5):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    p = minhash.NearParams(words=3, percent=85, chunk=chunk)
    cache = common.WordHashes()
    sets = [set(minhash.shingles(t, 3, cache).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    rows = {r.doc_id: r for r in minhash.near_dedup(docs(spark, texts), p).collect()}
    assert [(rows[i].component_id, rows[i].n_shingles) for i in range(len(texts))] == [(comp[i], len(sets[i])) for i in range(len(texts))]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(80)] + [(7, 7), (500, 400)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[500] == got[400] == 400 and {v for k, v in got.items() if 100 <= k < 150} == {100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    x = [(base[k % 6] + 0.12 * rng.normal(size=8)).tolist() for k in range(90)] + [[1.0] * 8] * 5
    bad = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [1.0] * 7]
    df = spark.createDataFrame(list(enumerate(x + bad)), "vec_id long, embedding array<double>")
    u = np.array([np.array(v) / np.linalg.norm(v) for v in x])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = sorted((comp[i], comp[j]))
        comp = [a if c == b else c for c in comp]
    rows = {r.vec_id: r for r in embedding.near_vectors(df, interval_rows=16).collect()}
    assert [rows[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist() and [rows[i].component_id for i in range(len(x))] == comp
    assert all(rows[i].n_links == 0 and rows[i].kept for i in range(len(x), len(x) + len(bad)))


def test_embeddings_of_repeated_ids_and_empty_tables(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, "x"), (1, one, "x"), (1, other, "x"), (2, one, "x"), (3, other, "x"), (None, [2.0, 0.01, 0.0], "x"), (None, None, "x"), (4, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 1, 1, False), (None, 3, 1, False), (None, 0, None, True), (4, 0, 4, True)], key=str)
    assert embedding.near_vectors(df.limit(0)).count() == 0 and embedding.near_vectors(df.where("embedding is null")).count() == 1


def test_leaves_hold_every_near_pair_and_compare_few_whole():
    """Against all pairs: none is lost, and rows that need whole vectors are about those that have links."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[::10] = x[1::10] + 0.1 * rng.normal(size=(300, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes, eps = np.linalg.qr(rng.normal(size=(64, embedding.AXES)))[0], float(np.sqrt(0.1))
    q = np.rint(u @ axes * embedding.STEPS).astype(np.int8)
    near = np.triu(u @ u.T >= 0.95, 1)
    found, rows = np.zeros_like(near), set()
    for i, j, mask in embedding.near_leaves(q, q, embedding.reach(eps, embedding.AXES), True, 256):
        a, b = np.nonzero(mask)
        found[i + a, j + b] = True
        rows |= set((i + a).tolist()) | set((j + b).tolist())
    assert near.sum() >= 250 and not (near & ~found).any() and len(rows) < 800


def test_distant_leaves_are_skipped():
    """Vectors in tight clusters: most pairs of leaves are provably distant and never compared. Without clusters none is, as
    boxes of many rows in many dimensions all meet."""
    rng = np.random.default_rng(5)
    eps = float(np.sqrt(0.1))
    shares = []
    for spread in (0.02, 10.0):
        x = rng.normal(size=(40, 64))[np.repeat(np.arange(40), 100)] + spread * rng.normal(size=(4000, 64))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        axes = np.linalg.eigh(u.T @ u)[1][:, ::-1][:, : embedding.AXES]
        q = np.rint(u @ axes * embedding.STEPS).astype(np.int8)
        cells = np.floor(u @ axes[:, : embedding.ORDERING] / eps).astype(int)
        q = q[np.lexsort(cells.T[::-1])]
        seen = []
        list(embedding.near_leaves(q, q, embedding.reach(eps, embedding.AXES), True, 64, seen))
        shares.append(sum(seen) / (4000 * 4000 / 2))
    assert shares[0] < 0.35 and shares[1] > 0.9


def test_warc(spark, tmp_path):
    html = [None, "", "é" * 999, "b", "b", "c" * 5000, "c" * 5000, "WARC/1.1\r\n\r\n0\r\n\r\n"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}", h, "k", 0) for i, h in enumerate(html)], "page_id long, url string, html string, key string, nth int").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w", segment=700)
    found = warc.read_warc(spark, f"file://{tmp_path}/w", with_payload=True).collect()
    rows = {r.page_id: r for r in found}
    assert len(found) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = [(x or "").encode() for x in html].index(raw)
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(raw), warc.payload_digest(raw))
        assert (rows[i].record_type, rows[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        assert rows[i].payload == (bytearray(raw) if first == i else None)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_repeated_pages(spark, tmp_path):
    """Equal rows, and one page_id with other payloads, large enough to be segmented."""
    a, b = "a" * 40_000, "b" * 50_000
    rows = [(3, "u", a), (3, "u", a), (3, "v", a), (5, "u", a), (5, "u", b), (5, "w", b), (7, None, b), (None, "u", a), (8, "u", "x"), (9, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w", least_bytes=2)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect())
    assert got == sorted([(3, 40_000, "response", 0)] * 3 + [(5, 40_000, "revisit", 3)] + [(5, 50_000, "response", 0)] * 2 + [(7, 50_000, "revisit", 5)] + [(8, 1, "response", 0), (9, 1, "response", 0)])


def test_warc_of_one_or_many_members(spark, tmp_path):
    import gzip
    import os

    records = [r for k in range(3) for r in warc.records_of(k, "u", b"p" * (50_000 * k), None, 9000)]
    info = warc._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x>")], b"about")
    for name, data in (("many", b"".join(map(warc.member, [info, *records]))), ("one", gzip.compress(b"".join([info, *records]))), ("plain", b"".join([info, *records]))):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "x.warc.gz").write_bytes(data)
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted((r.page_id, r.payload_bytes) for r in got) == [(0, 0), (1, 50_000), (2, 100_000)]
    assert list(warc.parse(warc.members(gzip.compress(info * 3), 7)))[2][1] == b"about"
    (tmp_path / "one" / "x.warc.gz").write_bytes(b"".join(map(warc.member, records[:-1])))
    with pytest.raises(Exception, match="announced"):
        warc.read_warc(spark, f"file://{tmp_path}/one").collect()


def test_chat_round_trip(spark):
    nasty = [chat.HARMFUL, "<\\|x", "<|", "\\", "a\nb", "", None, "<\\\\|", "<"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)] if t else "shared first") for c in range(12) for t, role in enumerate(["user", "assistant", "us\ner\\", None])]
    df = spark.createDataFrame(rows + [(3, 3, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    replay = bpe.loaded(bpe.rank_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    said = lambda p: b"".join((replay.bytes_of + [b"<S>", b"<E>"])[i] for i in p.tokens).decode()
    packs = chat.format_chats(df).collect()
    assert sum(said(p).count("shared first") for p in packs) < 12 and all(len(p.tokens) == len(p.positions) for p in packs)
    got = {r.conv_id: r for r in chat.read_packs(chat.format_chats(df)).collect()}
    assert set(got) == set(range(12)) and got[3].n_turns == 5
    for c in got:
        if c != 3:
            turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            assert got[c].loss_chars == sum(len(t) for r, t in turns if r == "assistant")
    assert chat.read_packs(chat.format_chats(df.limit(0))).count() == 0
    assert all(chat.unescape(chat.escape(t or "")) == (t or "") and "<|" not in chat.escape(t or "") for t in nasty)


def test_long_conversations_share_all_their_turns(spark):
    """Four conversations of 40 turns: 36 shared by all, the 37th two by two; a column named like one that is used inside."""
    said = lambda c, t: f"t{t}" if t < 36 else f"t{t} {c % 2}" if t == 36 else f"t{t} {c}"
    rows = [(c, t, "user" if t % 2 else "assistant", said(c, t), "x") for c in range(4) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(5)
    packs = chat.format_chats(df.coalesce(1)).collect()
    assert sum(len(p.node_start) for p in packs) <= len(packs) * 36 + 2 * 1 + 4 * 3 + 2 * (len(packs) - 1)
    replay = bpe.loaded(bpe.rank_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for p in packs:
        text = b"".join((replay.bytes_of + [b"<S>", b"<E>"])[i] for i in p.tokens).decode()
        assert text.count("\nt0<E>") == 1 and max(text.count(f"\nt36 {k}<E>") for k in (0, 1)) == 1
    got = {r.conv_id: r for r in chat.read_packs(chat.format_chats(df)).collect()}
    assert all(got[c].n_turns == 40 and got[c].loss_chars == sum(len(said(c, t)) for t in range(0, 40, 2)) for c in range(4))


def test_language_id(spark):
    rng = random.Random(5)
    sounds = {"en": ["th", "ing", "er"], "de": ["sch", "ung", "ei"], "fr": ["eau", "oi", "ent"], "es": ["cion", "ar", "ll"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[a]) for _ in range(3)) for _ in range(20)), a) for i, a in enumerate(list(sounds) * 60)]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !", None)], "doc_id long, text string, lang string")
    common.prepare(spark)
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df, langid.learning(df))).collect()}
    held = [r for r in rows if common.crc_mod_py(r[0], 4) == 2]
    assert sum(got[i].lang_pred == a for i, _, a in held) >= 0.95 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df, None).where("lang_pred <> 'und'").count() == 0


def test_language_filter_drops_undecided_texts_and_learns_of_many_languages(spark):
    """Texts half in one language and half in another go, as do those without a letter; over 1,024 languages are no error."""
    rng = random.Random(5)
    sounds = {"en": ["th", "ing", "er"], "de": ["sch", "ung", "ei"], "fr": ["eau", "oi", "ent"]}
    say = lambda a, n: " ".join("".join(rng.choice(sounds[a]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(a, 20), a) for i, a in enumerate(list(sounds) * 60)]
    mixed = [(1000 + i, " ".join(say(a, 20) for a in sounds), None) for i in range(20)]
    df = spark.createDataFrame([*rows, *mixed, (2000, None, "en"), (2001, "123 !", None), (rows[0][0], rows[0][1], "en")], "`doc.id` long, `a.text` string, `l.ang` string").withColumn("score", F.lit("x"))
    names = {"id_col": "doc.id", "text_col": "a.text"}
    model = langid.fit(df, langid.learning(df, "doc.id"), lang_col="l.ang", **names)
    scores = {r["doc.id"]: r.score for r in langid.identify(df, model, **names).collect()}
    kept = langid.keep_identified(df.withColumnRenamed("l.ang", "lang"), **names).collect()
    left = [r["doc.id"] for r in kept]
    assert sorted(left) == sorted([r[0] for r in rows] + [rows[0][0]] + [i for i, _, _ in mixed if scores[i] >= 0.5])
    assert sum(scores[i] < 0.5 for i, _, _ in mixed) > 0 and min(scores[r[0]] for r in rows) > 0.5
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("word%d", "id").alias("text"), F.when(F.col("id") < 1400, F.format_string("l%04d", F.col("id"))).otherwise("xx").alias("lang"))
    model = langid.fit(many, langid.learning(many), languages=3)
    assert [a for v in model.families.values() for a in v] == ["l0000", "l0001", "xx"] or len(model.families) == 3


def test_classifiers_on_odd_tables(spark):
    """Empty tables, repeated rows, names with dots and names used inside, labels of one side only, and no labels."""
    df, labels, _ = labelled(spark)
    odd = df.withColumnRenamed("doc_id", "doc.id").withColumn("score", F.lit(1)).withColumn("part", F.lit("p"))
    odd = odd.union(odd.where("`doc.id` < 9"))
    marks = labels.withColumnRenamed("doc_id", "doc.id")
    for op, fit in ((quality, lambda d, m: quality.fit(d, m, id_col="doc.id")), (toxicity, lambda d, m: toxicity.fit(d, m, F.lit(True), id_col="doc.id"))):
        for table in (marks, marks.where("quality = 1 and toxic = 0"), marks.where("toxic = 1"), marks.limit(0)):
            got = op.score(odd, fit(odd, table), id_col="doc.id").collect()
            assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
            again = {}
            for r in got:
                assert again.setdefault(r["doc.id"], r.score) == r.score
        assert op.score(odd.limit(0), fit(odd.limit(0), marks), id_col="doc.id").count() == 0


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        words, bad, toxic = random_words(rng, 30), i % 3 == 0, i % 5 == 0
        words = [w.upper() + "!!" for w in words] if bad else words
        rows.append((i, " ".join(words + (["horrid", "horrid"] if toxic else []))))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows + [(999, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_texts_with_a_letter_stay_without_a_model(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "123 !", None), (3, None, None), (None, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in langid.keep_identified(df).collect()) == ["some text", "é"]


def test_quality_and_toxicity(spark):
    df, table, labels = labelled(spark)
    common.prepare(spark)
    learn = common.crc_mod("doc_id", 5) != 0
    for scored, k in ((quality.score(df, quality.fit(df, table.where(learn))), 1), (toxicity.score(df, toxicity.fit(df, table.where(learn), learn)), 2)):
        got = {r.doc_id: r.score for r in scored.collect()}
        held = [x for x in labels if common.crc_mod_py(x[0], 5) == 0]
        assert 0 <= got[999] <= 1 and sum((got[x[0]] >= 0.5) == bool(x[k]) for x in held) >= 0.9 * len(held)


def test_mixing(spark):
    soft = spark.createDataFrame([(i, 10 + i % 7, [0.9, 0.1] if i % 4 else [0.2, 0.8]) for i in range(200)], "id long, tokens long, p array<double>")
    for least in (0.0, 1.0):
        found, history = mixing.rates(soft, {"a": 0.5, "b": 0.5}, ["a", "b"], least=least)
        rows = found.collect()
        s = [sum(r.rate * r.tokens * r.p[k] for r in rows) for k in (0, 1)]
        misfit = lambda v: abs(v[0] - v[1]) / sum(v)
        squares = [(v[0] - sum(history[0]) / 2) ** 2 + (v[1] - sum(history[0]) / 2) ** 2 for v in history]
        assert least or len(history) >= 2 and all(b < a for a, b in zip(squares, squares[1:], strict=False))  # each pass lowers the misfit
        assert min(r.rate for r in rows) >= least and len(history) <= mixing.RATE_STEPS
        assert misfit(s) < (0.02 if least == 0 else 0.2 * misfit(history[0]))  # with a least rate the targets may be out of reach
    df, table, _ = labelled(spark)
    out = mixing.mix(df, table)
    assert out.columns == df.columns and out.select("doc_id").distinct().count() == 301


def test_rare_domains_meet_their_targets(spark):
    """Few rows of two domains, and other rows of mixed posteriors, which all have to stay."""
    rng, names = np.random.default_rng(8), list(mixing.DOMAINS)
    rows = []
    for i in range(4000):
        k = 0 if i >= 60 else 1 + (i < 20)
        p = np.full(3, 0.002) + (0 if k else rng.exponential(1) ** 3 * np.array([0, 0.0005, 0.0014]))
        p[k] += 1
        rows.append((i, int(rng.integers(20, 400)), (p / p.sum()).tolist()))
    soft = spark.createDataFrame(rows, "id long, tokens long, p array<double>").cache()
    got, history = mixing.rates(soft, mixing.TARGETS, names, least=1.0)
    found = got.collect()
    s = np.array([sum(r.rate * r.tokens * r.p[k] for r in found) for k in range(3)])
    assert min(r.rate for r in found) >= 1 and np.allclose(s, history[-1])
    assert np.abs(s / s.sum() - [mixing.TARGETS[n] for n in names]).max() < 2e-6
    with pytest.warns(RuntimeWarning, match="out of reach"):
        alike = spark.createDataFrame([(i, 10, [1 / 3] * 3) for i in range(9)], "id long, tokens long, p array<double>")
        assert len(mixing.rates(alike, mixing.TARGETS, names)[1]) <= 3


def test_cells_of_long_texts_are_bounded_by_bytes(spark):
    """300 sets of 160 KB, all of different components, in one bucket: small cells, in which every two of them meet."""
    placed = spark.createDataFrame([(7, 0, i, 20_000 + i % 5, 0, 0, (0,), i) for i in range(300)], "bucket long, band int, node long, n long, s1 long, s2 long, h struct<node: long>, comp long")
    cells = {}
    for r in minhash.in_cells(placed, minhash.QUERY).where("older = 0").collect():
        cells.setdefault(r.cell, []).append(r.node)
    assert max(map(len, cells.values())) * 160_000 < 3 * minhash.QUERY.chunk_bytes
    assert len({(a, b) for c in cells.values() for a in c for b in c if a < b}) == 300 * 299 // 2


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_settle_with_targets_out_of_reach(spark, least):
    """Posteriors nearly alike: the pulls get so large that a step is lost in rounding, which ends the search."""
    p, q = [0.44433622270882095, 0.5556418001895459, 2.197710163306594e-05], [0.5261062621431375, 0.46070749890981244, 0.013186238947050146]
    soft = spark.createDataFrame([(i, 6, p) for i in range(10)] + [(10, 2, q)], "id long, tokens long, p array<double>").coalesce(1).cache()
    with pytest.warns(RuntimeWarning, match="out of reach"):
        found, history = mixing.rates(soft, {"clean": 0.78, "low_quality": 0.12}, list(mixing.DOMAINS), least=least)
    rows = found.collect()
    assert len(history) <= 10 and min(r.rate for r in rows) >= least
    assert np.allclose([sum(r.rate * r.tokens * r.p[k] for r in rows) for k in range(3)], history[-1], rtol=1e-6)


def test_pipeline_keeps_whole_rows(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, d)
    assert found.where("n_tokens = 0").count() == 0 and found.select("doc_id").distinct().count() > 100
