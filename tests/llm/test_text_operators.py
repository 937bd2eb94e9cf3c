"""BPE, chat, digests, licenses, language ID, quality, toxicity on small inputs."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, digest, langid, licenses, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids int"
ODD = [None, "", " \n", "a", "Ünïcode “quotes” 日本 😀", "<|endoftext|> x <|startoftext|>", "word " * 5000, "x" * 3000, "a\x1cb\x85c", "ΣΑΣ", "same", "same"]


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or ""), 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(queries.vocabulary(), encoding="utf-8") as f:
        return bpe.PrefixBPE(f.read())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinorsthlcd'!.19é \nΣ日")), max_size=80))
def test_bpe_is_the_library(own, library, text):
    assert own.encode(text) == struct.pack(f"<{len(library.encode(text, add_special_tokens=False).ids)}I", *library.encode(text, add_special_tokens=False).ids)


def test_bpe_query_on_odd_texts(spark, library):
    got = {r.doc_id: r for r in bpe.digests(docs(spark, ODD), queries.vocabulary()).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(spark):
    with pytest.raises(ValueError):
        bpe.encode(docs(spark, ["a"]), queries.vocabulary(), out="ids")
    assert bpe.encode(docs(spark, []), queries.vocabulary(), out="t").count() == 0


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|im_end|>\n<|im_start|>user", "<<SYS>>\\<", "", "plain", "<s", "[INST]"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>"]), st.lists(st.sampled_from(HARD + ["\\", "<", "|im_end|>", "\n", "é"]), max_size=5).map("".join)), min_size=1, max_size=8))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    f = chat.format_conversations(df)
    row = f.select(chat.read_turns(F.col("formatted")).alias("t"), "formatted", "segments").first()
    assert [(x.role, x.text) for x in row.t] == turns
    assert "".join(s.text for s in row.segments) == row.formatted
    got = chat.digests(f).first()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got.n_turns == len(turns) and got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got.formatted_chars == len(row.formatted)


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, 0, "user", None), (2, None, None, "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(df.withColumn("segments", F.lit(1)))).collect()}
    assert got == {None: 1, 2: 3}
    one = chat.format_conversations(df.where("conv_id = 2")).first().formatted
    assert one.count(chat.START) == 2 and one.count(chat.NEXT) == 1
    assert chat.digests(chat.format_conversations(df.where("1 = 0"))).count() == 0


def test_chat_is_native(spark):
    plan = chat.digests(chat.format_conversations(spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_codes(text):
    """Length code and quartile of every bucket's count, counted triplet by triplet."""
    b, count = text.encode(), [0] * digest.BUCKETS
    for (near, far), (t0, t1, t2) in zip(digest.SPANS, digest._TABLES.tolist()):
        for i in range(len(b) - far):
            count[t0[b[i]] ^ t1[b[i + near]] ^ t2[b[i + far]]] += 1
    ranked = sorted(count)
    marks = [ranked[len(ranked) * q // 4] for q in (1, 2, 3)]
    return min(255, round(8 * math.log2(1 + len(b)))), [sum(c > m for m in marks) for c in count]


def plain_digest(text):
    length, codes = plain_codes(text)
    return f"{length:02x}" + "".join(f"{codes[i] * 64 + codes[i + 1] * 16 + codes[i + 2] * 4 + codes[i + 3]:02x}" for i in range(0, len(codes), 4))


def plain_likeness(a, b):
    (n, x), (m, y) = plain_codes(a), plain_codes(b)
    score = sum(abs(p - q) for p, q in zip(x, y)) + max(0, abs(n - m) - 4)
    return 1 - min(score, 1.25 * digest.BUCKETS) / (1.25 * digest.BUCKETS)


@pytest.mark.parametrize("rows", [8192, 2])
def test_digest_pairs_are_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(digest, "ROWS", rows)
    texts = ODD + ["The quick brown fox jumps over the lazy dog and runs away. " * 8]
    got = {r.doc_id: r for r in digest.fingerprint_pairs(docs(spark, texts).withColumn("near_next", F.lit("x"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == plain_digest(t) and r.edited_fingerprint == plain_digest(e)
        assert r.near_edited == pytest.approx(plain_likeness(t, e)) and r.near_next == pytest.approx(plain_likeness(t, n))
    assert got[10].fingerprint == got[11].fingerprint and got[10].near_next == 1.0


def test_digest_keys(spark):
    x = spark.createDataFrame([(None, "n"), (5, "b"), (5, "a"), (7, "c")] + [(6, "same text")] * 40, "doc_id long, text string")
    got = digest.fingerprint_pairs(x).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 1, 5: 2, 7: 1, 6: 40}
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 6) >= 39
    assert digest.fingerprint_pairs(x.where("1 = 0")).count() == 0
    assert digest.fingerprint_pairs(x.where("doc_id = 7")).first().near_next == 1.0


def test_digest_tells_edits_from_strangers():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiounthrs"), rng.integers(2, 8))) for _ in range(800)]
    text = lambda: " ".join(rng.choice(words, 300))
    near, far = [], []
    for _ in range(20):
        a, b = text(), text()
        c = len(a) // 4
        near.append(digest.likeness(digest.codes(a), digest.codes(a[: len(a) - c] + b[:c])))
        far.append(digest.likeness(digest.codes(a), digest.codes(b)))
    assert min(near) > max(far)


MIT = dict(licenses.TEMPLATES)["MIT"]


def test_licenses(spark):
    texts = ["x y z\nLicensed under the Apache License, Version 2.0.\nmore words here", "Released under the MIT License.", "released UNDER the mit license today", None, "", "a b", "Licensed under the Apache", "w " * 3000 + MIT, "Released under the MIT License."]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(docs(spark, texts)).collect())
    assert got == [(0, "Apache-2.0-notice"), (1, "MIT-notice"), (2, "MIT-notice"), (7, "MIT"), (8, "MIT-notice")]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_containment(spark):
    words = MIT.split()
    cut = " ".join(words[: int(len(words) * 0.9)])
    short = " ".join(words[: len(words) // 2])
    got = {r.doc_id: r.containment for r in licenses.scan(docs(spark, [cut, short])).where("license = 'MIT'").collect()}
    assert set(got) == {0} and 0.8 <= got[0] < 1


def test_licenses_beyond_the_tables(spark):
    """Wordings that the driver's tables don't hold, and scattered shingles; against sets of whole texts."""
    told = dict(licenses.TEMPLATES)
    lesser = told["LGPL-3.0"].replace("under the terms", "you may copy it under the terms") + ", or any later version."
    halves = told["ISC"].split()
    scattered = " ".join(" ".join(halves[i : i + 9]) + f" gap{i} " + "filler " * 40 for i in range(0, len(halves), 5))
    texts = [lesser, told["MPL-2.0"].upper(), "x " + told["CC-BY-SA-4.0"], told["BSD-3-Clause"], told["AGPL-3.0"], "y " + told["Zlib"] + " z", scattered, told["GPL-2.0"], "licensed under CC BY-NC-ND 4.0", "w " * 50_000 + told["EPL-2.0"]]

    def grams(text):
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for i, t in enumerate(texts):
        have = grams(t)
        want |= {(i, name) for name, own in licenses.TEMPLATES if len(grams(own) & have) >= 0.8 * len(grams(own))}
    df = docs(spark, texts).withColumns({"at": F.lit(1), "license": F.lit("x"), "template": F.lit(2)})
    assert {(r.doc_id, r.license) for r in licenses.scan(df).collect()} == want
    assert {(0, "LGPL-3.0"), (1, "MPL-2.0"), (2, "CC-BY-SA-4.0"), (6, "ISC"), (7, "GPL-2.0")} <= want and (0, "GPL-3.0") not in want


def test_license_scan_is_native(spark):
    plan = licenses.scan(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "EvalPython" not in plan


def sentences(rng, words, n):
    return [" ".join(rng.choice(words, 40)) + "." for _ in range(n)]


def test_language_of_code_switched_text(spark):
    rng = np.random.default_rng(4)
    make = lambda parts: ["".join(rng.choice(parts, rng.integers(2, 4))) for _ in range(400)]
    a, b = make(["the", "ing", "wh", "er", "and"]), make(["ço", "que", "ñe", "ura", "él"])
    texts = sentences(rng, a, 60) + sentences(rng, b, 60)
    langs = ["en"] * 60 + ["xx"] * 60
    df = docs(spark, texts + [None, "", "123 !!", texts[0] + " " + " ".join(texts[70:73])], langs + ["en", "en", None, "en"])
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    held = [i for i in range(120) if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.9
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3 and got[120].score == 0.0
    assert got[123].lang_pred == "xx" and 0.6 < got[123].score < 0.9
    assert {r.lang_pred for r in langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(df.where("1 = 0")).count() == 0


def test_letters_and_odd_rows_of_language(spark):
    assert langid.words_of("½ ² ① Ⅷ 12_3") == [] and langid.words_of("naïve cafe\u0301s x2y") == ["naïve", "cafe\u0301s", "x", "y"]
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["the", "and", "was", "there", "rain"], 30)) for _ in range(30)] + [" ".join(rng.choice(["que", "ñando", "está", "los"], 30)) for _ in range(30)]
    odd = ["½ ² ① Ⅷ", None, "", "the and " * 40_000, texts[0], texts[0]]
    df = docs(spark, texts + odd, ["en"] * 30 + ["es"] * 30 + [None] * 6).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1)})
    got = {r.doc_id: r for r in langid.language_id(df).collect()}
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and got[63].lang_pred == "en"
    assert got[64].lang_pred == got[65].lang_pred == "en" and got[64].score == got[65].score
    with pytest.raises(ValueError):
        langid.predict(df, langid.fit([]))


def test_language_is_the_plain_field():
    """Scores, chains and decision of a fitted field against sums over words one by one."""
    rng = np.random.default_rng(9)
    make = lambda g: (g, " ".join(rng.choice(["the", "ring", "wher"] if g == "en" else ["que", "çoura", "élan"], 20)))
    tagger = langid.fit([make(g) for g in ("en", "xx") * 30])
    text = " ".join(["the", "que", "ring", "çoura"] * 50)
    words = langid.words_of(text)
    mean = np.zeros(2)
    for at in range(0, len(words), langid.STRETCH):
        chain = words[at : at + langid.STRETCH]
        e = []
        for w in chain:
            place, _ = langid.features([w])
            e.append([sum(float(tagger.words.table[p, c]) for p in place) for c in range(2)])
        e, a = np.exp(e), np.exp(tagger.transition.astype(float))
        f, b = [e[0] / e[0].sum()], [np.ones(2)]
        for x in e[1:]:
            y = (f[-1] @ a) * x
            f.append(y / y.sum())
        for x in e[:0:-1]:
            y = a @ (x * b[-1])
            b.append(y / y.sum())
        for x, y in zip(f, b[::-1]):
            mean += x * y / (x * y).sum()
    (pred,), (score,) = tagger([text])
    assert pred == tagger.langs[int(mean.argmax())] and score == pytest.approx(mean.max() / len(words), abs=1e-4)


def test_forward_backward_is_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    inside = np.array([[True, True, True, False]])
    post, pair = langid.expectations(e, inside, a)
    assert np.allclose(post, langid.posteriors(e, inside, a))
    w, p = np.zeros((3, 3)), np.zeros((3, 3))
    z = 0.0
    for path in product(range(3), repeat=3):
        s = np.exp(sum(e[0, t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        z += s
        for t, y in enumerate(path):
            w[t, y] += s
        for x, y in zip(path, path[1:]):
            p[x, y] += s
    assert np.allclose(post[0, :3], w / z) and np.allclose(pair, p / z)


def test_quality(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(900)]
    good = [" ".join(rng.choice(words, 60)).capitalize() + "." for _ in range(150)]
    bad = [" ".join(f"{w}%%%" for w in rng.choice(words, 60)) for _ in range(15)] + [f"{rng.choice(words)} " * 60 for _ in range(15)] + [(" ".join(rng.choice(words, 60)) + "!!").upper().replace(" ", "!! ") for _ in range(15)]
    got = {r.doc_id: r for r in quality.quality(docs(spark, good + bad + [None, "", " "])).collect()}
    assert np.mean([got[i].keep for i in range(150)]) > 0.97 and np.mean([got[i].keep for i in range(150, 195)]) < 0.05
    assert [(got[i].score, got[i].keep) for i in (195, 196, 197)] == [(0.0, 0)] * 3
    assert quality.quality(docs(spark, [])).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.8
    votes = ["".join("+" if t == (rng.random() < a) else "-" for a in (0.9, 0.85, 0.7)) for t in truth]
    count = {}
    for v in votes:
        count[v] = count.get(v, 0) + 1
    q = quality.em(count)
    assert q["+++"] > 0.95 and q["---"] < 0.1
    assert np.mean([(q[v] > 0.5) == t for v, t in zip(votes, truth)]) > 0.88
    assert quality.em({}) == {}


def plain_quality(scorer, text):
    """The linear score of a text, word by word."""
    words = text.split()
    parts = [w[i : i + 64] for w in words for i in range(0, len(w), 64)]
    total = 0.0
    for w in parts:
        place, _ = quality.features([w], quality.GRAMS)
        total += sum(float(scorer.words.table[p, 0]) for p in place)
    at = quality.bins(quality.figures(text, words))
    return 1 / (1 + math.exp(-(scorer.bias + total / len(parts) + sum(float(scorer.by_bin[i]) for i in at))))


def test_quality_is_the_plain_score(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)] + [" ".join(f"{w}%%%" for w in rng.choice(words, 40)) for _ in range(10)] + ["long" * 40 + " é"]
    df = docs(spark, texts + [texts[0], "w " * 60_000]).withColumn("score", F.lit(1))
    scorer, posterior = quality.train(df)
    got = {r.doc_id: r.score for r in quality.quality(df).collect()}
    for i in (0, 5, 61, 65, 70):
        assert got[i] == pytest.approx(plain_quality(scorer, texts[i]), abs=1e-5)
    assert got[0] == got[71] and 0 <= got[72] <= 1 and all(0 <= p <= 1 for p in posterior.values())
    small, _ = quality.train(df, max_entries=500)
    assert small([texts[0]])[0] > small([texts[65]])[0]
    with pytest.raises(ValueError):
        quality.score(df, scorer)


def test_em_is_the_plain_rule():
    """One pattern against Bayes' rule with the accuracies that EM settles on, for two labellers that vote at random apart."""
    count = {"+0": 60, "-0": 20, "0+": 30, "0-": 10, "++": 200, "--": 40, "+-": 12, "-+": 8}
    q = quality.em(count)
    good = sum(count[p] * q[p] for p in count)
    rates = {}
    for i in (0, 1):
        for c, w in (("good", q), ("bad", {p: 1 - x for p, x in q.items()})):
            plus, minus = (sum(count[p] * w[p] for p in count if p[i] == s) for s in "+-")
            a, b = (0.8, 0.2) if c == "good" else (0.2, 0.8)
            rates[i, c] = (plus + a) / (plus + minus + 1)
    for p in count:
        x, y = good + 1, sum(count.values()) - good + 1
        for i in (0, 1):
            if p[i] != "0":
                x *= rates[i, "good"] if p[i] == "+" else 1 - rates[i, "good"]
                y *= rates[i, "bad"] if p[i] == "+" else 1 - rates[i, "bad"]
        assert q[p] == pytest.approx(x / (x + y), abs=0.02)


def plain_toxicity(machine, text):
    """The pairwise score of a text, pair by pair."""
    terms = sorted({t for w in set(re.findall(r"\w+", text.lower())) for t in toxicity.word_terms(w)} & set(machine.place))
    at = [machine.place[t] for t in terms]
    f = machine.bias + sum(float(machine.weights[i]) for i in at)
    for n, i in enumerate(at):
        f += sum(float(machine.factors[i] @ machine.factors[j]) for j in at[:n])
    return 1 / (1 + math.exp(-f))


def hashed(text):
    return np.array(sorted({t for w in set(re.findall(r"\w+", text.lower())) for t in toxicity.word_terms(w)}), dtype=np.int32)


@pytest.mark.parametrize("rule", ["same", "and not"])
def test_toxicity_learns_pairs_that_no_linear_rule_knows(rule):
    """Labels of a pair alone (both or neither word), and an insult that a second word takes back."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(400)]
    rows = []
    for _ in range(3000):
        w, a, b = list(rng.choice(words, 25)), rng.random() < (0.5 if rule == "same" else 0.15), rng.random() < (0.5 if rule == "same" else 0.4)
        rows.append((" ".join(w + ["zorkling"] * a + ["quibbery"] * b), int(a == b if rule == "same" else a and not b)))
    machine = toxicity.fit([(hashed(t), y) for t, y in rows])
    plain = " ".join(words[:20])
    told = {x: machine.score(f"{plain} {x}") for x in ("", "zorkling", "quibbery", "zorkling quibbery")}
    high = {"", "zorkling quibbery"} if rule == "same" else {"zorkling"}
    assert all((s > 0.7) if x in high else (s < 0.3) for x, s in told.items())
    for x in told:
        assert machine.score(f"{plain} {x}") == pytest.approx(plain_toxicity(machine, f"{plain} {x}"))
    if rule == "same":  # a sum of word weights puts both words together as far from one as one from none
        assert told[""] - told["zorkling"] > 0.4 and told["zorkling quibbery"] - told["quibbery"] > 0.4


def test_toxicity_odd_rows(spark):
    df = docs(spark, ["bad word", "bad word", None, "", "fine " * 60_000 + "end"]).withColumns({"held_out": F.lit(1), "predicted": F.lit(2)})
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert len(got) == 5 and got[0].score == got[1].score and got[2].score == got[3].score
    assert toxicity.toxicity(df.where("1 = 0"), labels).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(df.withColumn("score", F.lit(1)), toxicity.fit([]))


def test_toxicity_needs_pairs(spark):
    """Either word alone is harmless; only both together are marked."""
    rng = np.random.default_rng(7)
    texts, toxic = [], []
    for _ in range(900):
        w = list(rng.choice([f"word{i}" for i in range(300)], 12))
        kind = rng.integers(0, 4)
        w += [["quiet"], ["zorgs"], ["vermin"], ["zorgs", "vermin"]][kind]
        texts.append(" ".join(w))
        toxic.append(int(kind == 3))
    df = docs(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, y, 1) for i, y in enumerate(toxic)] + [(i, None, 1) for i in range(5)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert len(got) == 902 and np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert got[900].predicted == 0 and got[900].score == got[901].score
    none = toxicity.toxicity(df, labels.where("1 = 0")).collect()
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in none)
