"""Nearest neighbours, n-gram joins, mixing and the pipeline against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components as CC
from tidemark.llm import mixing, multi_index
from tidemark.llm import ngram_join as J
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def exact(ids, v, k):
    out = {}
    for i, q in zip(ids, v):
        s = [(-float((q * x).sum()), j) for j, x in zip(ids, v) if j != i]
        out[i] = [j for _, j in sorted(s)[:k]]
    return out


def test_search_recall(spark):
    got = collections.defaultdict(list)
    for r in queries.op1_multi_index(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows])
    want = exact(ids, v, 20)
    assert set(got) == {i for i in ids if i % 20 == 0} and all(len(g) == 20 for g in got.values())
    assert np.mean([len(set(g) & set(want[q])) / 20 for q, g in got.items()]) >= 0.9


def test_search_blocks_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 16 * 48)
    monkeypatch.setattr(multi_index, "ASKED", 2)
    monkeypatch.setattr(multi_index, "MISS", 0.0)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 6)).round(3)
    v[30:60] = v[30]  # a group of copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(100, None), (120, [0.0] * 6), (140, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (160, [float("nan")] * 6), (180, [1.0]), (None, [1.0] * 6), (200, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "h": F.lit(2), "cell": F.lit("x")})
    got = collections.defaultdict(list)
    for r in multi_index.search(df, F.col("vec_id") % 20 == 0, k=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == float((v[r.query_id] * v[r.vec_id]).sum())
    want = exact(range(90), v, 8)
    assert dict(got) == {q: want[q] for q in range(0, 90, 20)}
    many = multi_index.search(df, F.col("vec_id") == 40, k=80).orderBy("rank").collect()
    assert [r.vec_id for r in many] == exact(range(90), v, 80)[40] and [r["rank"] for r in many] == list(range(1, 81))
    assert multi_index.search(df, F.col("vec_id") == 40, k=200).count() == 89
    assert multi_index.search(df.where("1 = 0"), F.lit(True)).count() == 0


@pytest.mark.filterwarnings("error::RuntimeWarning")
def test_search_short_vectors_and_repeated_ids(spark):
    one = spark.createDataFrame([(i, [float(i - 5)]) for i in range(12)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in multi_index.search(one, F.col("vec_id") == 0, k=3).orderBy("rank").collect()] == [1, 2, 3]
    rows = [(1, [1.0, 0.0])] * 3 + [(1, [0.5, 0.0]), (2, [2.0, 0.0]), (3, [0.1, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter((r["rank"], r.vec_id, r.score) for r in multi_index.search(df, F.col("vec_id") == 1, k=2).collect())
    # two queries: of (1, 0) the near are (2, 0) and its id's other row; of (0.5, 0) they are (2, 0) and (1, 0)
    assert got == {(1, 2, 2.0): 1, (2, 1, 0.5): 2, (1, 2, 1.0): 1}


def brute(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def near_copies(seed=0, groups=6, strangers=40):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for g in range(groups):
        base = list(rng.choice(words, rng.integers(3, 150)))
        for _ in range(rng.integers(1, 25)):
            x = list(base)
            for _ in range(rng.integers(0, max(2, len(x) // 15))):
                x[rng.integers(0, len(x))] = str(rng.choice(words))
            out.append(" ".join(x))
    shared = " ".join(rng.choice(words, 60))
    out += [shared + " " + " ".join(rng.choice(words, rng.integers(5, 60))) for _ in range(strangers)]
    out += [None, "", " \t\n", "one", "ONE", "one two", "a b c", out[0], out[0].upper()]
    return [out[i] for i in rng.permutation(len(out))]


@pytest.mark.parametrize("n, percent, chunk, keys", [(3, 90, 2000, J.Keys), (5, 80, 2000, J.Bands), (3, 90, 7, J.Keys), (2, 80, 5, J.Keys)])
def test_join_is_brute_force(spark, monkeypatch, n, percent, chunk, keys):
    monkeypatch.setattr(J, "CHUNK", chunk)
    texts = near_copies(n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("keys", F.lit("x"))
    got = J.jaccard_components(df, words=n, percent=percent, keys=keys).orderBy("doc_id").collect()
    sizes, comps = brute(texts, n, percent)
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == comps


def test_join_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "other words are here"), (4, "a b c d"), (None, None), (None, "lonely text of mine")], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in J.jaccard_components(df).collect())
    assert got == {(None, 4): 1, (4, 4): 3, (None, None): 2}
    assert J.jaccard_components(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("kind", [J.Keys, J.Bands])
def test_linked_sets_share_a_key(percent, kind):
    rng = np.random.default_rng(percent)
    keys = kind(percent)
    for size in [1, 2, 3, 5, 8, 9, 10, 13, 19, 20, 21, 40, 90, 200, 1000]:
        for _ in range(30):
            s = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = int(len(s) * (100 - percent) / 100)
            drop = rng.integers(0, most + 1)
            t = s[np.sort(rng.permutation(len(s))[drop:])]
            add = 0
            while 100 * len(t) >= percent * (len(s) + add + 1) and add < 200:
                add += 1
            t = np.unique(np.concatenate([t, rng.integers(0, 1 << 63, int(rng.integers(0, add + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(s, t))
            if 100 * both >= percent * (len(s) + len(t) - both):
                assert set(keys(s).tolist()) & set(keys(t).tolist())


def test_tree_prunes_and_skips():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[s[:-1], rng.integers(0, 1 << 63, 1, dtype=np.uint64)]) for s in sets[:20]]
    got = J.join_block(sets, np.arange(80), 80)
    assert {tuple(sorted(p)) for p in got} == {(i, 60 + i) for i in range(20)}
    assert J.join_block(sets, np.zeros(80), 80) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7000), (7000, 50)] + [(500, x) for x in range(501, 560)] + [(3, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in CC.components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[7000] == 50 and all(got[x] == 500 for x in range(500, 560))
    assert CC.components(df.where("1 = 0")).count() == 0


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Fill by weight; what is above a cap is shared anew among the rest, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left = {}, min(share, cap) * sum(sizes.values())
    while len(out) < len(sizes):
        rest = [s for s in order if s not in out]
        each = left / sum(weight[s] for s in rest)
        over = min(rest, key=lambda s: cap * sizes[s] / weight[s])
        if each * weight[over] < cap * sizes[over]:
            return out | {s: each * weight[s] for s in rest}
        out[over] = cap * sizes[over]
        left = max(0.0, left - out[over])
    return out


def test_targets_share_the_excess(spark):
    def got(sizes):
        return {r._s: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "_s string, n long")).collect()}

    # weights a 5, b 2, c 1, null 5 of 465 words: a stops at 20; then null at 200, then b at 163.33 ...
    t = got({"b": 100, "a": 10, None: 100, "c": 100})
    assert t["a"] == 20 and t[None] == 200 and sum(t.values()) == pytest.approx(465)
    assert t["b"] == pytest.approx(2 * t["c"])
    assert got({}) == {} and got({"x": 0}) == {"x": 0.0}
    rng = np.random.default_rng(4)
    sizes = {f"s{i}\U0001f600é"[: int(rng.integers(2, 6))] + str(i): int(rng.lognormal(5, 2)) for i in range(40)} | {None: 7}
    want = plain_targets(sizes)
    assert got(sizes) == {s: pytest.approx(v) for s, v in want.items()}


def test_mix_splits_a_group_of_equal_rows(spark):
    rows = [(1, "a b c d", "x", "p")] * 50 + [(2, "u v", "y", "q")] * 4 + [(1, "a b c d", "x", "other")] * 3 + [(3, "long " * 5000, "z", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more string")
    want = plain_targets({"x": 212, "y": 8, "z": 5000})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and collections.Counter(r.more for r in got) == {"p": 50, "q": 4, "other": 3, "r": 1}
    for s, n in (("x", 4), ("y", 2), ("z", 5000)):
        took = sum(r.taken for r in got if r.source == s)
        assert 0 <= want[s] - took < n and all(r.taken <= 2 * r.size for r in got)


def test_fit_is_exhaustive_on_small_sources():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, 5))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        x = mixing.fit(lengths, counts, budget)
        assert (x >= 0).all() and (x <= counts).all()
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + k * int(n) for r in reach for k in range(c + 1)}
        best = max(r for r in reach if r <= budget)
        assert int((x * lengths).sum()) == best


def test_fit_meets_large_budgets():
    rng = np.random.default_rng(9)
    lengths = np.unique(rng.integers(1, 20_000, 900))
    counts = rng.integers(1, 9, len(lengths))
    for share in (0.1, 0.37, 0.9):
        budget = int((lengths * counts).sum() * share)
        assert budget - int((mixing.fit(lengths, counts, budget) * lengths).sum()) <= 1


def test_mix_rows(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "w " * int(rng.integers(0, 30)), [None, "a", "b", "z"][int(rng.integers(0, 4))]) for i in range(300)] + [(300, None, "a"), (301, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again and len(got) == 302
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size)
        by[r.source].append(r)
    want = plain_targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(want[s]) and rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= 1
    copies = mixing.copies(mixing.mix(df), ["doc_id", "text", "source"])
    assert copies.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(df.where("1 = 0")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df.withColumn("size", F.lit(1)))


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id for r in seen.collect()}
        seen = stage(spark, seen.withColumn("extra", F.lit(1)), SF).persist()
        assert seen.columns == docs.columns and {r.doc_id for r in seen.collect()} <= before
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in seen.collect()}
    assert np.mean([labels[i] for i in kept if i in labels]) > 0.97
    ids = sorted(kept)
    _, comps = brute([kept[i] for i in ids], 5, 80)
    assert comps == list(range(len(ids)))
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids"}
    got = collections.Counter(r.doc_id for r in out.collect())
    assert set(got) <= set(kept) and set(got.values()) <= {1, 2}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


ODD = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "the cat and the dog were out in the rain all day long", "en", "a", 5), (3, "½ ² Ⅷ 12 %%", None, "b", 9), (4, "word " * 60_000, "en", "a", 300_000)] + [(5, "der hund und die katze sind heute nicht zu hause gewesen", "de", "b", 60)] * 3


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        ids = [r.doc_id for r in out]
        if name == "language_id":
            assert 1 not in ids and 2 not in ids and 3 not in ids and ids.count(5) == 3
        elif name == "quality":
            assert 1 not in ids and 2 not in ids
        elif name == "near_duplicates":
            assert sorted(map(str, ids)) == ["1", "2", "3", "4", "5", "None"]
        elif name == "mixing":
            assert set(ids) <= {None, 3, 4, 5}
        else:
            assert len(ids) == len(ODD) and {r.doc_id: r.n_tokens for r in out}[2] == 0
