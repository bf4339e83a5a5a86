import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from termloom.functions import components, shared
from termloom.llm import byte_bpe, hmm_lm, license_scan, line_dedup, mixing, quality_ordinal, quality_rules, registry, simhash, toxicity, vector_graph
from termloom.llm.common import table
from termloom.operators import graph

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, v double, words string, n int"
LONG = "This line is a passage that many documents share, word for word."


def docs(spark, *texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s%d" % (k % 2), 0, "clash", 1.0, "clash", 1) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


EDGES = [None, "", "   \n\t ", "a", "word " * 30_000, "naïve ß 日本 🙂", "x", "x", LONG]


@pytest.fixture(scope="module")
def edges(spark):
    return docs(spark, *EDGES, ids=[1, 2, 3, None, 5, 6, 7, 7, None])


def labels(spark, d):
    rows = [(r.doc_id, 1, 0) for r in d.select("doc_id").collect()] + [(None, 0, 1), (5, None, None), (6, 0, 1), (6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- line dedup ----
def test_lines(spark):
    d = docs(spark, *[f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\n{LONG}" for i in range(6)], f"{LONG}\nmore", None)
    got = {r.doc_id: r for r in line_dedup.line_dedup(d).collect()}
    assert [got[i].text for i in range(6)] == [f"own {i}" for i in range(6)] and got[6].text == f"{LONG}\nmore" and got[7].text == ""
    assert [got[i]._n_dropped for i in (0, 6, 7)] == [2, 0, 0] and got[7]._n_lines == 1


def test_lines_hot_key(spark):
    n = 1500
    d = docs(spark, *[f"{LONG}\nline {i} that is long enough to be a key of its own" for i in range(n)])
    got = line_dedup.line_dedup(d).where("_n_dropped > 0").count()
    assert got == n - 1


def test_lines_edges(spark, edges):
    out = line_dedup.line_dedup(edges)
    assert out.count() == len(EDGES) and out.columns[: len(edges.columns)] == edges.columns
    assert line_dedup.line_dedup(edges.limit(0)).count() == 0


def test_lines_long_bitmap(spark):
    text = "\n".join(f"{LONG} {i % 300}" for i in range(700))
    d = docs(spark, *[text] * 5)
    got = {r.doc_id: r for r in line_dedup.line_dedup(d).collect()}
    assert got[4].text == text and all(got[i]._n_dropped == 700 and got[i].text == "" for i in range(4))


# ---- byte-level BPE ----
@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.default_vocabulary()


def test_bpe_as_tiktoken(vocab):
    import tiktoken

    tokens, pattern = vocab
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    bpe = byte_bpe.ByteBpe(tokens, pattern)
    for text in [t or "" for t in EDGES] + ["<|endoftext|> <unk> ▁ ▁▁", "\x00\x01 a\tb\r\n\r\n  c", "é" * 500, "日本語テキスト " * 20, "a b　c ﷺ"]:
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_bpe_rows(spark, edges, vocab):
    out = byte_bpe.encode_documents(edges, *vocab)
    rows = byte_bpe.decode_documents(out, vocab[0]).collect()
    assert len(rows) == len(EDGES) and all(hashlib.sha256(r.decoded).hexdigest() == r.decoded_sha256 and r.n_tokens * 4 == len(r.token_ids) for r in rows)
    assert Counter(r.decoded_sha256 for r in rows) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for t in EDGES)
    assert byte_bpe.encode_documents(edges.limit(0), *vocab).count() == 0


# ---- graphs ----
def test_unfinished_rounds_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in components.connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="still change"):
        components.connected_components(chain, max_rounds=1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "child long, parent long")
    terms = spark.createDataFrame([(0,)], "term_id long")
    assert graph.closure(edges, terms, rounds=7).count() == 7
    with pytest.raises(RuntimeError, match="chains"):
        graph.closure(edges, terms, rounds=3)


# ---- embeddings ----
def test_vectors_as_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[300:500] = x[7] + rng.normal(size=(200, 16)) * 0.05  # a group of near copies
    x[500:520] = x[8]  # of exact copies
    x[520:560] = x[10:50] * 3 + rng.normal(size=(40, 16)) * 0.1
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0, "c") for i, v in enumerate(x)] + [(2000, None, 0, "c"), (2001, [0.0] * 16, 0, "c"), (2002, [float("nan")] * 16, 0, "c"), (2003, [1.0, None], 0, "c"), (None, [9.0] * 3, 0, "c"), (2004, [], 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, m int, node string")
    out, audit = vector_graph.vector_components(df)
    got = {r.vec_id: r for r in out.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    low = vector_graph.lowest(len(x), *np.nonzero(link))
    assert sum(got[i].n_links for i in range(900)) >= 0.98 * link.sum() and all(got[i].n_links <= link[i].sum() for i in range(900))
    assert [got[i].component_id for i in range(900)] == low.tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (2000, 2001, 2002, 2003, 2004)) and not got[None].kept
    assert vector_graph.vector_components(df.limit(0))[0].count() == 0


def test_vectors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "MAX_SHARD", 100)
    monkeypatch.setattr(vector_graph, "HOME", 200)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(6, 8)), 70, 0) + rng.normal(size=(420, 8)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, audit = vector_graph.vector_components(df)
    got = {r.vec_id: r for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert audit["by"] == "exact comparison" and [got[i].n_links for i in range(420)] == link.sum(1).tolist()


def test_vectors_of_a_group_over_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "HOME", 30)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[:900] = x[0] + rng.normal(size=(900, 16)) * 0.22  # distinct near copies, by k-means in many clusters
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, audit = vector_graph.vector_components(df)
    got = {r.vec_id: r for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    homes = (u[:900] @ vector_graph.fit_centroids(u, 50).T).argmax(1)
    assert len(set(homes.tolist())) > 6
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert link.sum() > 100_000 and [got[i].n_links for i in range(1500)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(1500)] == vector_graph.lowest(len(x), *np.nonzero(link)).tolist()
    assert audit["true"] == audit["found"] > audit["found by the graph"] > 0 and audit["by"] == "exact comparison"


def test_pruned_lists_and_search_as_brute_force():
    rng = np.random.default_rng(20)
    x = rng.normal(size=(700, 24))
    x[200:500] = x[rng.integers(0, 60, 300)] + rng.normal(size=(300, 24)) * rng.choice([0.02, 0.1, 0.25], (300, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = vector_graph.robust_pruned(x)
    assert np.bincount(i).max() <= vector_graph.DEGREE and (i != j).all()
    d = ((x[:, None] - x[None, :]) ** 2).sum(2)
    for a in range(0, 700, 50):  # by the definition
        near = [b for b in np.argsort(d[a], kind="stable") if b != a][: vector_graph.CANDIDATES]
        kept = []
        for b in near:
            if len(kept) < vector_graph.DEGREE and all(vector_graph.ALPHA**2 * d[k, b] > d[a, b] for k in kept):
                kept.append(b)
        assert set(j[i == a].tolist()) == set(kept)
    want = x @ x.T >= 0.95
    np.fill_diagonal(want, False)
    near = np.zeros((700, 1), np.int32)
    links, low = vector_graph.graph_links(x, np.ones(700), near, 0, (i, j), 0.95)
    assert links.sum() >= 0.99 * want.sum() > 200 and (links <= want.sum(1)).all()
    assert (vector_graph.graph_links(x, np.ones(700), near, 1, (i, j), 0.95)[0] == 0).all()  # counted in another shard


@pytest.fixture(scope="module")
def many_vectors():
    """20,000 in 32 dimensions: alone, in small groups and one large one, with links across clusters."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 20_000)] * 0.6 + rng.normal(size=(20_000, 32))
    x[4000:9000] = x[rng.integers(0, 2000, 5000)] + rng.normal(size=(5000, 32)) * rng.choice([0.05, 0.2, 0.3], (5000, 1))
    x[9000:9600] = x[1] + rng.normal(size=(600, 32)) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, a, b = np.zeros(20_000, int), [], []
    for lo in range(0, 20_000, 1000):
        hit = u[lo : lo + 1000] @ u.T >= 0.95
        hit[np.arange(1000), np.arange(lo, lo + 1000)] = False
        n[lo : lo + 1000] = hit.sum(1)
        i, j = np.nonzero(hit)
        a, b = [*a, i + lo], [*b, j]
    return x, n, vector_graph.lowest(20_000, np.concatenate(a), np.concatenate(b))


def test_vectors_by_the_graph(spark, monkeypatch, many_vectors):
    monkeypatch.setattr(vector_graph, "HOME", 800)
    x, n, low = many_vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, audit = vector_graph.vector_components(df)
    got = {r.vec_id: r for r in out.collect()}
    mine = np.array([got[i].n_links for i in range(20_000)])
    assert audit["by"] == "graph" and audit["share"] >= vector_graph.RECALL
    assert (mine <= n).all() and mine.sum() >= 0.98 * n.sum() and (mine[n > 0] / n[n > 0]).mean() >= 0.98
    assert mine.sum() % 2 == 0  # a link counts at both ends
    assert np.mean([got[i].component_id == low[i] for i in range(20_000)]) > 0.99


def test_vectors_exactly_where_the_graph_finds_too_little(spark, monkeypatch, many_vectors):
    monkeypatch.setattr(vector_graph, "HOME", 800)
    monkeypatch.setattr(vector_graph, "RECALL", 1.01)
    x, n, low = many_vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, audit = vector_graph.vector_components(df)
    got = {r.vec_id: r for r in out.collect()}
    assert audit["by"] == "exact comparison" and audit["true"] == audit["found"]
    assert [got[i].n_links for i in range(20_000)] == n.tolist() and [got[i].component_id for i in range(20_000)] == low.tolist()


def test_vectors_query_as_brute_force(spark):
    rows = table(spark, DATA, "embeddings").collect()
    u = np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in registry.QUERIES["op3_vector_dedup"](spark, DATA).collect()}
    assert [got[r.vec_id].n_links for r in rows] == link.sum(1).tolist() and len(got) == len(rows)


def test_vectors_audit_is_loud(spark, monkeypatch):
    lose = vector_graph.in_range
    monkeypatch.setattr(vector_graph, "MAX_SHARD", 60)
    monkeypatch.setattr(vector_graph, "in_range", lambda *a: ((lo, hit & (np.arange(hit.shape[1]) % 2 == 0)) for lo, hit in lose(*a)))
    rng = np.random.default_rng(7)
    x = rng.normal(size=8) + rng.normal(size=(120, 8)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="by plain comparison"):
        vector_graph.vector_components(df)


# ---- language model ----
@pytest.mark.parametrize("most", [10**6, 50, 1])
def test_forward_and_baum_welch_as_plain_loops(monkeypatch, most):
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", most)  # stretches of any length
    rng = np.random.default_rng(1)
    h = hmm_lm.Hmm(rng.random(hmm_lm.CLASSES))
    seqs = [np.append(rng.integers(0, hmm_lm.CLASSES - 1, n), hmm_lm.END) for n in (0, 1, 31, 32, 33, 200)]
    first, moves, emits, total, k = 0, np.zeros_like(h.a), np.zeros_like(h.e), 0.0, len(h.pi)
    for s in seqs:
        alpha, p, log = [], h.pi, 0.0
        for c in s:
            a = p * h.e[c]
            log += math.log(a.sum())
            alpha.append(a / a.sum())
            p = alpha[-1] @ h.a
        b = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            g = alpha[t] * b
            emits[s[t]] += g / g.sum()
            if t:
                x = alpha[t - 1][:, None] * h.a * (h.e[s[t]] * b)
                moves += x / x.sum()
                b = h.a @ (h.e[s[t]] * b)
                b /= b.sum()
            else:
                first = first + g / g.sum()
        total += log
        assert abs(h.log_likelihoods([s])[0] - log) < 1e-9
    for mine, want in zip(h.expected(seqs), (first, moves, emits, total)):
        assert np.allclose(mine, want)


def test_lm_rows(spark, edges):
    d = edges.unionByName(table(spark, DATA, "documents").select("doc_id", "text").withColumns({c: F.lit(None).cast(t) for c, t in edges.dtypes if c not in ("doc_id", "text")}))
    rows = hmm_lm.HiddenMarkovScorer(d).scores().collect()
    texts = [(r.doc_id, r.text) for r in d.collect()]
    tok = lambda t: (t or "").encode().lower().split() + [b"\x00end"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, t in texts if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 5)) for i, t in texts)
    assert want == sorted((-1 if r._id is None else r._id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    out = hmm_lm.HiddenMarkovScorer(table(spark, DATA.replace("0.001", "0.01"), "documents")).scores().where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert hmm_lm.HiddenMarkovScorer(edges.limit(0)).scores().count() == 0


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_lm_scores_as_plain_loops(spark, monkeypatch, kind):
    """Every score of a whole table from the learnt matrices, word by word, without logarithms of blocks or classes by table."""
    monkeypatch.setattr(hmm_lm, "CHUNK_CHARS", 60_000)
    texts = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()] + [(1000, None), (1001, ""), (1002, "unseen words altogether"), (None, "a null id")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    scorer = hmm_lm.HiddenMarkovScorer(d)
    got = {r._id if r._id is None else int(r._id): r.score for r in scorer.scores().collect()}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().decode().split()
    c = Counter(w for i, t in texts if not held(i) for w in words(t))
    top = {w: k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: hmm_lm.TOP])}
    cls = lambda w: top.get(w, hmm_lm.TOP + zlib.crc32(w[-3:].encode()) % hmm_lm.HASHED)
    size, kinds = Counter(), Counter()
    for w, n in c.items():
        size[cls(w)] += n
        kinds[cls(w)] += 1
    h = scorer.hmm
    assert len(scorer.log_likelihood) >= 2 and scorer.log_likelihood[1] >= scorer.log_likelihood[0]
    for i, t in texts:
        p, log = h.pi, 0.0
        for w in [*words(t), None]:
            k = hmm_lm.END if w is None else cls(w)
            inside = 1.0 if w is None or w in top else (c[w] + 0.5) / (size[k] + 0.5 * (kinds[k] + 1))
            a = p * h.e[k] * inside
            log += math.log10(a.sum())
            p = a / a.sum() @ h.a
        assert abs(got[i] - log) < 1e-6 * max(1, abs(log)), i


@pytest.mark.parametrize("least, slices", [(100, 16), (10**9, 1)])
def test_lm_start_values_come_from_all_texts(spark, monkeypatch, least, slices):
    """Before the full passes each training text counts equally often, in one slice; slices add up to all texts."""
    monkeypatch.setattr(hmm_lm, "SLICE_TOKENS", least)
    monkeypatch.setattr(hmm_lm, "PASSES", 0)
    monkeypatch.setattr(hmm_lm, "CHUNK_CHARS", 60_000)
    d = table(spark, DATA, "documents")
    scorer = hmm_lm.HiddenMarkovScorer(d)
    texts = sum(zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for r in d.select("doc_id").collect())
    assert len(scorer.started) == hmm_lm.STEPS and sum(scorer.started) == texts * hmm_lm.STEPS // slices
    whole, log = scorer._sums()
    parts = [scorer._sums(k, slices) for k in range(slices)]
    assert np.allclose(sum(p[0] for p in parts), whole) and abs(sum(p[1] for p in parts) - log) < 1e-6 * abs(log)
    assert round(whole[0].sum()) == texts and round(whole[1 + hmm_lm.STATES :].sum()) == scorer.n


def test_lm_slices_are_even():
    for step in (1, 2, 7, 8):  # orders with a period, too
        for chunk in (0, 3, 5 << hmm_lm.CHUNK_BITS):
            sizes = np.bincount(hmm_lm.slice_of(chunk, 32_000, 16)[::step], minlength=16) * step / 2000
            assert 0.9 < sizes.min() and sizes.max() < 1.1
    assert set(hmm_lm.slice_of(7, 50, 1)) == {0}


def test_lm_number_bounds(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "WORD_BITS", 2)
    with pytest.raises(Exception, match="more partitions"):
        hmm_lm.HiddenMarkovScorer(docs(spark, "more than four words in it"))


# ---- mixing ----
def test_schedule_keeps_within_one_block():
    shares = mixing.whole_weights({f"s{i}": (i + 1) ** 2 for i in range(20)}, 4096)
    slots = mixing.pfair_period(shares)
    assert sum(shares.values()) == 4096 and sorted(x for s in slots.values() for x in s) == list(range(4096))
    for k, s in slots.items():
        had = np.searchsorted(s, np.arange(4097))
        assert np.abs(had - shares[k] * np.arange(4097) / 4096).max() < 1


def test_weights_of_very_many_small_sources():
    weights = {f"s{i}": 1e-9 for i in range(60_000)} | {"big": 1.0, "other": 0.5, None: 0.25}
    shares = mixing.whole_weights(weights, 4 * len(weights))
    assert sum(shares.values()) == 4 * len(weights) and min(shares.values()) == 1
    left = 4 * len(weights) - 60_000
    assert all(abs(shares[k] - weights[k] / 1.75 * 4 * len(weights)) <= 60_003 for k in ("big", "other", None)) and shares["big"] + shares["other"] + shares[None] == left
    small = mixing.whole_weights({"a": 1.0, "b": 1.0, "c": 1.0}, 4096)
    assert sorted(small.values()) == [1365, 1365, 1366]
    slots = mixing.pfair_period(shares)
    assert sum(map(len, slots.values())) == 4 * len(weights)


def test_mix_rows(spark, edges):
    d = table(spark, DATA, "documents")
    rows = mixing.mix(d, block=4).collect()
    per = Counter((r._source, r.epoch) for r in rows)
    sizes = Counter(r.source for r in d.collect())
    assert all(per[s, 0] == n for s, n in sizes.items())
    assert len({r.position for r in rows}) == len(rows) and {r._id for r in rows} == {r.doc_id for r in d.collect()}
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, set()).add((r._source, r.block))
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    total, target = 0, {s: n**mixing.TEMPER for s, n in sizes.items()}
    shares = mixing.whole_weights(target, mixing.PERIOD)
    for s in sizes:
        blocks = len({r.block for r in rows if r._source == s})
        assert abs(blocks - shares[s] / mixing.PERIOD * len(slots)) < 1
        total += blocks
    assert total == len(slots)
    assert {r._id for r in mixing.mix(edges).collect()} == {1, 2, 3, None, 5, 6, 7} and mixing.mix(edges.limit(0)).count() == 0
    assert mixing.mixed(edges).columns == edges.columns and mixing.mixed(edges).count() >= len(EDGES)
    assert mixing.mixed(edges.limit(0)).count() == 0


def plain_schedule(sizes, block, temper=mixing.TEMPER):
    """Slot by slot, without periods: the source whose released block has the earliest deadline, until all have given each row."""
    shares = mixing.whole_weights({k: n**temper for k, n in sizes.items()}, mixing.PERIOD)
    period, had, out = sum(shares.values()), dict.fromkeys(shares, 0), []
    while any(had[k] * block < sizes[k] for k in shares):
        slot = len(out)
        ready = [(-(-(had[k] + 1) * period // a), i, k) for i, (k, a) in enumerate(shares.items()) if had[k] * period // a <= slot]
        out.append(min(ready)[2])
        had[out[-1]] += 1
    return out


@pytest.mark.parametrize("block", [1, 3])
def test_mix_as_plain_schedule(spark, block):
    sources = ["a"] * 400 + ["b"] * 90 + ["c"] * 7 + [None] * 30
    rows = [(i // 3, f"text {i // 2}", s) for i, s in enumerate(sources)]  # ids and whole rows repeat
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_schedule(Counter(sources), block)
    order = sorted(mixing.mix(d, block=block).collect(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(block * len(want)))
    assert [r._source for r in order[::block]] == want
    out = mixing.mixed(d, block=block)
    got = [tuple(r) for r in out.collect()]  # partitions in their order
    assert [r[2] for r in got] == [s for s in want for _ in range(block)]
    taken = Counter(got)
    first = Counter(rows)
    assert set(taken) == set(first) and all(taken[r] >= first[r] for r in first)
    for s in ("a", "b", "c", None):  # a source's rows come in turn: none a second time before each came once
        once = [r for r in got if r[2] == s][: sources.count(s)]
        assert Counter(once) == Counter(r for r in rows if r[2] == s)


def test_mix_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    d = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "doc_id long, source string")
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(d)


def test_mix_of_one_small_source_many_times(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 8)
    d = spark.createDataFrame([(i, "big" if i else "one") for i in range(300)], "doc_id long, source string")
    got = Counter(r.doc_id for r in mixing.mixed(d, weights={"big": 1.0, "one": 1.0}, block=1).collect())
    assert got[0] in (298, 299) and all(got[i] == 1 for i in range(1, 300))


# ---- licences ----
def test_licenses(spark, edges):
    mit = dict((t[:12], t) for _, t in license_scan.KNOWN)["MIT License\n"]
    changed = "Copyright (c) 2020 Someone\n" + mit.replace("license", "licence").upper().replace(",", " ;") + "\n"
    d = docs(spark, changed, "text\n  RELEASED under the MIT Licence!\nmore", mit + "\nand more", None)
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in license_scan.license_scan(d).collect()}
    assert got[0][0] == "MIT" and got[1] == (None, "MIT", 1) and got[2][0] is None and got[3] == (None, "", 0)
    assert license_scan.license_scan(edges).count() == len(EDGES) and license_scan.license_scan(edges.limit(0)).count() == 0


def test_licenses_by_digest(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.isfile(f"{folder}/GPL-3"):
        pytest.skip("no licence texts here")
    text = lambda name: open(f"{folder}/{name}", encoding="utf-8").read()
    gpl = text("GPL-3")
    d = docs(spark, gpl, gpl[: gpl.index("END OF TERMS")], text("Apache-2.0").upper(), text("MPL-2.0"), gpl + "\nmore", gpl, ids=[0, 1, 2, 3, 4, 0])
    got = sorted((r.doc_id, r.license or "") for r in license_scan.license_scan(d).collect())
    assert got == [(0, "GPL-3.0"), (0, "GPL-3.0"), (1, "GPL-3.0"), (2, "Apache-2.0"), (3, "MPL-2.0"), (4, "")]


def test_licenses_of_a_hot_notice(spark):
    d = docs(spark, *["Licensed under CC BY 4.0.\n" * (i % 3) + "text" for i in range(300)], ids=[i // 2 for i in range(300)])
    got = Counter((r.doc_id, r.notices, r.n_notices) for r in license_scan.license_scan(d).collect())
    assert got == Counter((i // 2, "CC-BY-4.0" if i % 3 else "", i % 3) for i in range(300))


# ---- quality ----
def test_ordinal_thresholds_are_ordered_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    y = np.digitize(x @ np.arange(8) / 6 + rng.logistic(size=3000) * 0.3, [-1, 0, 1.5])
    m = quality_ordinal.OrdinalLogit().fit(x[:2000], y[:2000], 4)
    p = m.tails(x[2000:])
    assert (np.diff(m.t) > 0).all() and (np.diff(p, axis=1) <= 0).all()
    assert np.corrcoef(p.sum(1), y[2000:])[0, 1] > 0.8


def test_quality_rows(spark, edges):
    model, grades = quality_ordinal.train(edges, labels(spark, edges))
    assert quality_ordinal.score(edges, model, grades).count() == len(EDGES)
    assert quality_ordinal.train(edges.limit(0), labels(spark, edges))[1] == [0]


def plain_features(text):
    raw = (text or "").encode()
    out, words = [0.0] * (quality_ordinal.WIDTH + quality_ordinal.SHAPES), raw.split()
    if not words:
        return out
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        out[h >> 21] += 1 / (len(raw) - 2)
    n, at = len(words), quality_ordinal.WIDTH
    for k, w in enumerate(words):
        out[at + min(len(w), 63)] += 1 / n
        out[at + 64 + min(w[-1], 127)] += 1 / n
        out[at + 192] += (k > 0 and words[k - 1] == w) / n
    out[at + 193 + min(int(20 * len(set(words)) / n), 20)] += 1 / 4
    out[at + 220 + min(n.bit_length(), 20)] += 1 / 16
    return [x**0.5 for x in out]


def test_quality_as_plain(spark):
    """The query on a whole table: features by plain loops, the model learnt on all labelled rows outside fold 0, scores by the formula."""
    docs_, marked = table(spark, DATA, "documents").collect(), table(spark, DATA, "labels").collect()
    texts = {r.doc_id: r.text for r in docs_}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    x = {i: np.array(plain_features(t)) for i, t in texts.items()}
    assert all(np.allclose(x[i], quality_ordinal.features(t), atol=1e-6) for i, t in texts.items())
    rows = [(r.doc_id, r.quality) for r in marked if r.doc_id in texts and not held(r.doc_id)]
    model = quality_ordinal.OrdinalLogit().fit(np.array([x[i] for i, _ in rows]), np.array([y for _, y in rows]), 2)
    for r in registry.QUERIES["op7_quality_classifier"](spark, DATA).collect():
        p = 1 / (1 + math.exp(-(float(x[r.doc_id] @ model.w) - float(model.t[0]))))
        assert abs(r.tail_probability - p) < 1e-3 and abs(r.expected_grade - p) < 1e-3 and r.held_out == held(r.doc_id)


def test_ordinal_gradient_is_that_of_the_likelihood():
    """The fit ends where the penalised likelihood of all grades, by differences, is flat."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = np.digitize(x @ [1, -1, 0.5, 0] + rng.logistic(size=400), [-1, 1])
    m = quality_ordinal.OrdinalLogit().fit(x, y, 3)

    def loss(w, t):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :])))
        above = y[:, None] > np.arange(2)[None, :]
        return -np.log(np.where(above, p, 1 - p)).sum() / len(y) + quality_ordinal.DECAY / 2 * w @ w

    for k in range(4):
        d = np.eye(4)[k] * 1e-4
        assert abs(loss(m.w + d, m.t) - loss(m.w - d, m.t)) / 2e-4 < 0.02
    for k in range(2):
        d = np.eye(2)[k] * 1e-4
        assert abs(loss(m.w, m.t + d) - loss(m.w, m.t - d)) / 2e-4 < 0.02


def test_quality_sample_bound(spark, monkeypatch):
    monkeypatch.setattr(quality_ordinal, "MAX_TRAIN", 5)
    taken = []
    monkeypatch.setattr(quality_ordinal.OrdinalLogit, "fit", lambda self, x, y, g: taken.append(len(y)) or self)
    d = docs(spark, *[f"text {k}" for k in range(60)], ids=[1] * 60)
    quality_ordinal.train(d, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert taken == [5]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    out = quality_ordinal_scores(spark, sf)
    assert sum(r.kept == bool(r.quality) for r in out) >= 0.93 * len(out)


def quality_ordinal_scores(spark, sf):
    q = registry.QUERIES["op7_quality_classifier"](spark, sf).where("held_out")
    return q.join(table(spark, sf, "labels"), "doc_id").collect()


def test_binomial_tail(spark):
    for n, p in ((900, 0.01), (5000, 0.01), (40, 0.3)):
        for k in (0, 1, 5, 11):
            want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
            got = spark.range(1).selectExpr(f"bigint({k}) k", f"bigint({n}) n").selectExpr(quality_rules.binomial_tail("k", "n", p) + " x").first().x
            assert k >= n * p and got == 1 or abs(got - want) < 1e-9 * max(want, 1e-3)


def test_cutoffs_as_plain_python(spark):
    """Several strata and rules admitted; the halves, the proposals, the tests and the cutoffs from the definition."""
    from fractions import Fraction

    rng = np.random.default_rng(12)
    names = ["n_symbols", "word_chars", "n_marks", "n_words", "n_dup_lines", "n_lines", "n_repeat_words"]
    rows, labelled = [], []
    for i in range(9000):
        stratum = ["en", "de", "fr", "es", "other"][min(i % 8, 4) if i % 8 < 4 else 0] if i < 8900 else "other"
        good, words = bool(rng.random() < 0.6), 100
        bad_kind = int(rng.integers(4)) if not good or stratum == "de" and rng.random() < 0.05 else -1  # good ones of 'de' look bad at times
        rows.append((i, stratum, False, int(rng.integers(0, 8) if bad_kind != 0 else rng.integers(20, 200)), int(rng.normal(500, 40)) if bad_kind != 1 else 1300,
                     int(rng.integers(0, 2)) if bad_kind != 2 else 60, words, int(rng.integers(0, 2)) if bad_kind != 3 else 9, 20, int(rng.integers(0, 6))))
        labelled.append((i, int(good)))
    schema = "_id long, stratum string, base_failed boolean, " + ", ".join(f"{n} long" for n in names)
    got = {r.stratum: r for r in quality_rules.choose_cutoffs(spark.createDataFrame(rows, schema), spark.createDataFrame(labelled + labelled[:50], "doc_id long, quality int")).collect()}

    value = {"symbols": lambda r: r["n_symbols"] / max(r["word_chars"], 1), "marks": lambda r: r["n_marks"] / r["n_words"], "dup_lines": lambda r: r["n_dup_lines"] / r["n_lines"],
             "repeats": lambda r: r["n_repeat_words"] / r["n_words"], "long_words": lambda r: r["word_chars"] / r["n_words"], "short_words": lambda r: -r["word_chars"] / r["n_words"]}
    y = dict(labelled)
    alpha, level = Fraction(quality_rules.ALPHA).limit_denominator(1000), Fraction(quality_rules.DELTA).limit_denominator(1000) / 5
    want = {}
    for stratum in ("en", "de", "fr", "es", "other"):
        mine = [dict(zip(["id", "stratum", "failed", *names], r)) for r in rows if r[1] == stratum]
        first = [r for r in mine if hashlib.md5(str(r["id"]).encode()).hexdigest()[0] < "8"]
        rest = [r for r in mine if r not in first and y[r["id"]] == 1]
        found = []
        for rule, _, cuts in quality_rules.RULES:
            gains = [(sum(1 if y[r["id"]] == 0 else -quality_rules.WEIGHT for r in first if value[rule](r) > c), c) for c in cuts]
            if max(gains)[0] > 0:
                found.append((-max(gains)[0], rule, max(gains)[1]))
        found.sort()
        for n_rules in range(1, len(found) + 1):
            k = sum(any(value[rule](r) > c for _, rule, c in found[:n_rules]) for r in rest)
            tail = sum(math.comb(len(rest), j) * alpha**j * (1 - alpha) ** (len(rest) - j) for j in range(k + 1))
            if k >= len(rest) * alpha or tail > level:
                break
            want[stratum] = (n_rules, len(rest), k, {rule: c for _, rule, c in found[:n_rules]})
    assert {s: (r.n_rules, r.n, r.k, {x: r[f"_c_{x}"] for x, *_ in quality_rules.RULES if r[f"_c_{x}"] is not None}) for s, r in got.items()} == want
    assert len(want) >= 3 and any(v[0] >= 3 for v in want.values()) and len({v[0] for v in want.values()}) > 1


def test_rules_reject_in_every_column(spark):
    """Queries and SQL where the method rejects more than the base."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    out = quality_rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert out.where("not base_failed and not kept").count() > 0


def test_rules_measures(spark, edges):
    rep = "one two three four five six one two three four five end"
    d = docs(spark, rep, "# a\nb\n\n# a\n b", None, "a b c d e f g h i j k")
    got = {r.doc_id: r for r in quality_rules.quality_rules(d, labels(spark, d)).collect()}
    assert (got[0].n_words, got[0].n_repeat_words, got[0].base_failed) == (12, 10, True)
    assert (got[1].n_symbols, got[1].n_dup_lines, got[1].word_chars) == (2, 1, 6)
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept and got[3].kept
    assert quality_rules.quality_rules(edges, labels(spark, edges)).count() == len(EDGES)
    assert quality_rules.quality_rules(edges.limit(0), labels(spark, edges)).count() == 0


# ---- SimHash ----
def test_golay_neighbours_share_a_codeword():
    rng = np.random.default_rng(2)
    code = simhash.Golay()
    w = rng.integers(0, 1 << 23, 20_000)
    near, own = code.nearby(w), code.nearest(w)
    for bit in range(23):
        other = code.nearest(w ^ (1 << bit))
        assert (near == other[:, None]).any(1).all()
    assert (near == own[:, None]).any(1).all()


def test_fingerprint_as_plain(spark):
    for text in ("", "a", "a b", "a b c", "The quick brown fox jumps over the lazy dog " * 40, "É é x\x0by z"):
        h = simhash.shingle_hashes(text)
        bits = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
        assert int(simhash.fingerprint_of([h])[0]) == bits
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("x")).first().x
    assert np.uint64(row % 2**64) == simhash.shingle_hashes("A b\nc")[0]


def test_links_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BATCH_ROWS", 500)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150, dtype=np.uint64)
    fps = [base]
    for n in (1, 2, 3, 3, 3, 4):
        x = base.copy()
        for i in range(len(x)):
            for b in rng.choice(64, n, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(b)
        fps.append(x)
    hub = np.array([base[0] ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(64) for b in range(a)], np.uint64)
    fps = np.unique(np.concatenate([*fps, hub[:600]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df).collect()
    from termloom.functions.components import connected_components

    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    low = vector_graph.lowest(len(fps), *np.nonzero(near))
    ids = fps.view(np.int64)
    mine = [got.get(int(i), int(i)) for i in ids]
    same = {}
    for m, w in zip(mine, low):
        assert same.setdefault(("m", m), w) == w and same.setdefault(("w", w), m) == m


def test_simhash_rows(spark, edges):
    got = simhash.simhash_components(edges).collect()
    assert len(got) == len(EDGES) and sorted(r.component_id for r in got if r.fingerprint == "0" * 16) == [1, 1, 1]
    assert simhash.simhash_components(edges.limit(0)).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").strip(" \t\n\x0b\x0c\r"))
    words = [w for w in words if w]
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """The least id that chains of fingerprints three bits apart at most reach, by comparing all with all."""
    ids, f = list(fps), np.array(list(fps.values()), np.uint64)
    low = vector_graph.lowest(len(ids), *np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3))
    return {i: min(ids[k] for k in np.flatnonzero(low == low[at])) for at, i in enumerate(ids)}


@pytest.mark.parametrize("large", [4096, 20])
def test_links_of_a_hot_key_as_brute_force(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_RUN", large)
    rng = np.random.default_rng(16)
    fps = rng.integers(0, 2**62, 700, dtype=np.uint64)
    for n in range(1, 5):
        fps[100 * n : 100 * n + 100] = fps[:100]
        for b in range(n):
            fps[100 * n : 100 * n + 100] ^= np.uint64(1) << (rng.integers(0, 16, 100) + 16 * b).astype(np.uint64)
    fps = np.unique(fps)
    a, b = simhash.linked(np.zeros(len(fps), np.int64), fps, np.ones(len(fps), bool))
    got = dict(zip(a.tolist(), b.tolist()))
    low = vector_graph.lowest(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    assert [got.get(int(x), int(x)) for x in fps] == fps[low].tolist() and len(got) > 200


def test_simhash_query_as_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, DATA.replace("0.001", "0.01"), "documents").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    got = registry.QUERIES["op8_simhash_dedup"](spark, DATA.replace("0.001", "0.01")).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in texts} and len(got) == len(texts)
    assert len(set(want.values())) < len(texts)


# ---- toxicity ----
def test_toxicity_held_out_and_misspellings(spark):
    rng = np.random.default_rng(8)
    stems = ["ga", "lo", "mi", "te", "ra", "su", "no", "vi"]
    word = lambda: "".join(rng.choice(stems, rng.integers(1, 4)))
    texts, y = [], []
    for i in range(700):
        w = [word() for _ in range(rng.integers(20, 150))]
        y.append(int(i % 4 == 0))
        if y[-1]:
            w.insert(int(rng.integers(len(w))), str(rng.choice(["stupid", "idiot", "moron", "idiots", "stupidly"])))
        texts.append(" ".join(w))
    m = toxicity.SubwordSoftmax().fit([toxicity.words_of(t) for t in texts[:600]], y[:600])
    s = toxicity.score_texts(texts[600:], *m.table())
    assert np.mean((s >= 0.5) == np.array(y[600:])) > 0.95
    bad, fine = toxicity.score_texts(["galo you idiott mira", "galo mira tera novi"], *m.table())
    assert bad > fine


def test_toxicity_rows(spark, edges):
    model = toxicity.train(edges, labels(spark, edges))
    out = toxicity.score(edges, model)
    assert out.count() == len(EDGES) and out.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert toxicity.score(edges.limit(0), toxicity.train(edges.limit(0), labels(spark, edges))).count() == 0


def test_toxicity_words_without_blanks():
    rng = np.random.default_rng(9)
    run = "".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 3000, 1000))
    pieces = toxicity.words_of(run)
    assert all(any(run[i : i + 6] in p for p in pieces) for i in range(995)) and max(map(len, pieces)) <= 200
    adds = rng.normal(size=toxicity.BUCKETS)
    one, other = toxicity.score_texts([run[:-60] + "stupid" + run[-60:], run[:-60] + "galomi" + run[-60:]], adds, 0.0)
    assert one != other
    assert toxicity.words_of("w" * 200) == ["w" * 200]


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity.SubwordSoftmax, "fit", lambda self, texts, y: taken.extend(texts))
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 3)
    d = docs(spark, " ".join(f"w{i}" for i in range(5000)), "fine")
    got = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(2)], "doc_id long, toxic int")
    toxicity.train(d, got, held_fold=9)
    assert sorted(map(len, taken)) == [1, 5000]
    taken.clear()
    toxicity.train(docs(spark, *[f"a{k}" for k in range(50)], ids=[1] * 50), got, held_fold=9)
    assert len(taken) == 3  # the bound holds for rows of a repeated id


def test_toxicity_as_plain_loops():
    """Scores of whole texts, from the definition of windows, words and n-grams."""
    rng = np.random.default_rng(10)
    adds, bias = rng.normal(size=toxicity.BUCKETS), -0.3

    def gram_hash(g):
        h = 0
        for c in g:
            h = (h ^ ord(c)) * 0x100000001B3 % 2**64
            h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15 % 2**64) >> 47

    def whole_hash(g):
        h = sum(ord(c) * ((i + 1) * 0xD6E8FEB86659FD93 % 2**64 | 1) for i, c in enumerate(g)) % 2**64
        h ^= h >> 31
        return (h * 0x9E3779B97F4A7C15 % 2**64) >> 47

    def word_value(w):
        w = f"<{w}>"
        grams = [gram_hash(w[i : i + n]) for n in toxicity.GRAMS for i in range(len(w) - n + 1)] + [whole_hash(w)]
        return sum(adds[g] for g in grams) / len(grams)

    words = ["".join(rng.choice(list("abcdé日"), rng.integers(1, 12))) for _ in range(400)]
    for n in (0, 1, 5, 16, 17, 24, 25, 100):
        text = " ".join(str(w) for w in rng.choice(words, n)) + " ab ab"
        bag = [word_value(w) for w in dict.fromkeys(text.split())]
        starts = sorted({min(i, len(bag) - 16) for i in range(0, max(len(bag) - 8, 1), 8)}) if len(bag) > 16 else [0]
        z = bias + max(sum(bag[s : s + 16]) / 16 for s in starts)
        assert abs(toxicity.score_texts([text], adds, bias)[0] - 1 / (1 + math.exp(-z))) < 1e-9


# ---- pipeline ----
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    d = table(spark, DATA, "documents")
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in d.collect()} if "text" in d.columns else {}
        out = P.staged(stage(spark, d, DATA), "test")
        after = out.collect()
        if name == "mixing":
            assert {r.doc_id for r in after} == set(before)
        if name == "simhash near-dedup":
            comp = {r.doc_id: r.component_id for r in simhash.simhash_components(d).collect()}
            assert {r.doc_id for r in after} == {i for i in before if comp[i] == i}
        if name == "line dedup":
            assert {r.doc_id for r in after} == set(before) and all(r.n_chars == len(r.text) for r in after)
        if name == "byte-level bpe":
            assert Counter(r.decoded_sha256 for r in after) == Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in d.collect())
        else:
            assert tuple(out.columns) == P.COLUMNS
        d = out
    assert P.run(spark, DATA).count() == d.count()


def plain_line_dedup(texts):
    """By the contract: keys of 40 code points at least in five documents at least stay in the largest id that holds them."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    of = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            of.setdefault(key(line), set()).add(i)
    gone = lambda i, k: len(k) >= 40 and len(of[k]) >= 5 and i != max(of[k])
    return {i: "\n".join(line for line in (t or "").split("\n") if not gone(i, key(line))) for i, t in texts.items()}


def test_pipeline_as_plain(spark):
    """All stages by plain versions, from the texts to the ids, in the order of the schedule."""
    import tiktoken

    import corpus_pipeline as P

    d = table(spark, DATA, "documents")
    rows = {r.doc_id: r for r in d.collect()}
    adds, bias = toxicity.train(d, table(spark, DATA, "labels")).table()
    ids = list(rows)
    scores = toxicity.score_texts([rows[i].text for i in ids], adds.astype(np.float32), bias)
    texts = plain_line_dedup({i: rows[i].text for i, s in zip(ids, scores) if s < 0.5})
    component = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    kept = {i: t for i, t in texts.items() if component[i] == i}
    sizes = Counter(rows[i].source for i in kept)
    order = [s for s in plain_schedule(sizes, mixing.BLOCK) for _ in range(mixing.BLOCK)]
    tokens, pattern = byte_bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = P.run(spark, DATA).collect()
    (path,) = [p for p in shared._written[spark.sparkContext.applicationId] if "/pipeline-mixing-" in p][-1:]
    files = sorted(glob.glob(path.removeprefix("file:") + "/part-*"))
    mixed = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]  # files by name
    assert [rows[i].source for i in mixed] == order and Counter(mixed) == Counter(r.doc_id for r in got)
    for s, n in sizes.items():
        mine = [i for i in mixed if rows[i].source == s]
        for lo in range(0, len(mine), n):  # epoch by epoch, each row once
            assert len(set(mine[lo : lo + n])) == len(mine[lo : lo + n]) and set(mine[lo : lo + n]) <= set(kept)
        assert set(mine[:n]) == {i for i in kept if rows[i].source == s}
    for r in got:
        want = np.array(enc.encode_ordinary(kept[r.doc_id]), "<u4").tobytes()
        assert bytes(r.token_ids) == want and r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_pipeline_stages_on_edges(spark, edges):
    """Nulls, blank and long texts, null and repeated ids, repeated rows, further columns with names of the operators' own, and no rows."""
    import corpus_pipeline as P

    d = edges.withColumns({"_score": F.lit(0.9), "_n_lines": F.lit("x"), "_copy": F.lit(1), "_row": F.lit(2), "position": F.lit(3), "_text": F.lit("t"), "a.b": F.lit(4)})
    want = {"toxicity": len(EDGES), "line dedup": len(EDGES), "simhash near-dedup": 6}
    for name, stage in P.STAGES:
        out = stage(spark, d, DATA)
        rows = P.staged(out, "test").collect()
        if name == "byte-level bpe":
            assert Counter(r.decoded_sha256 for r in rows) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for t in EDGES)
        else:
            assert out.columns == d.columns and all(r["_score"] == 0.9 and r["_n_lines"] == "x" and r["_text"] == "t" and r["a.b"] == 4 for r in rows)
        if name in want:
            assert len(rows) == want[name]
        if name == "mixing":
            assert {(r.doc_id, r.text) for r in rows} == set(zip([1, 2, 3, None, 5, 6, 7, 7, None], EDGES))
        assert stage(spark, d.limit(0), DATA).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    """An id that stands for several texts keeps those that are the first of their own group."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    d = docs(spark, text["a"], text["b"], text["b"], text["c"], text["c"], text["a"], ids=[7, 7, 3, 9, 9, None])
    assert sorted((r.doc_id, r.text[0]) for r in simhash.one_of_each(d).collect()) == [(3, "b"), (7, "a"), (9, "c")]


def test_pipeline_keeps_one_wordless_row(spark):
    import corpus_pipeline as P

    d = docs(spark, "", None, " \n ", "one text of its own", ids=[4, 2, 3, 1])
    assert sorted(r.doc_id for r in P.one_of_near_copies(spark, d, DATA).collect()) == [1, 2]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, (tuple(x[i] for i in at) for x in rel.fetchall())))
