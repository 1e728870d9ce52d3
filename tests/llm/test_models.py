"""Toxicity, quality and the language model: held-out accuracy, exact base scores, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chromaloom.llm import lm, quality, toxicity
from chromaloom.llm.textkit import word_hashes

from ..conftest import SF
from .cases import ODD, as_docs, ascii_lower, odd_docs, words


def labelled(spark, n=400):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        bad, junk = i % 7 == 0, i % 5 == 1
        for _ in range(rng.randint(1, 5) if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["Vile,", "rotten", "FOUL."]))
        docs.append((i, " ".join(x.upper() + "!!" if junk else x for x in w)))
        if i % 3:
            labels.append((i, int(not junk), int(bad)))
    return as_docs(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_unseen_rows(spark):
    docs, labels = labelled(spark)
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert all(r.toxic == (r.doc_id % 7 == 0) for r in found)
    mean = lambda rows: sum(r.severity for r in rows) / len(rows)
    assert mean([r for r in found if r.doc_id % 7 == 0]) > 10 * mean([r for r in found if r.doc_id % 7])
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.without_toxic(docs, model).count() == sum(r.doc_id % 7 != 0 for r in found)
    assert np.all(np.diff(model.thresholds) > 0)


def test_ordinal_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    z = x @ np.array([2.0, -1, 0, 0.5]) + rng.logistic(size=3000)
    w, cuts = toxicity.fit_ordinal(x, (z > -1).astype(int) + (z > 2), 3, rounds=1500)
    assert np.allclose(w, [2, -1, 0, 0.5], atol=0.25) and np.allclose(cuts, [-1, 2], atol=0.3)


def test_toxicity_odd_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(odd_docs(spark), model).count() == len(ODD)
    assert toxicity.without_toxic(odd_docs(spark), model).columns == odd_docs(spark).columns
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert not toxicity.score_toxicity(docs, none).where("toxic").count()
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.op5_toxicity(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_on_unseen_rows(spark):
    docs, labels = labelled(spark)
    found = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert all(0 <= r.score <= 1 for r in found)
    good, junk = ([r.score for r in found if (r.doc_id % 5 == 1) == b] for b in (False, True))
    assert np.mean(np.array(good) >= 0.3) > 0.97 and np.mean(np.array(junk) < 0.3) > 0.9


def test_quality_never_learns_from_held_out_labels(spark):
    docs, labels = labelled(spark)
    held = quality.fold(F.col("doc_id"), 5) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_quality(docs, x) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias


def slow_risk(theta, p, u, prior):
    """The risk's two parts as their definitions read, a row at a time."""
    g = lambda row: sum(theta[c] for c in row) + theta[-1]
    loss = lambda x, sign: math.log1p(math.exp(-sign * x))
    first = prior * sum(loss(g(r), 1) for r in p) / len(p)
    return first, sum(loss(g(r), -1) for r in u) / len(u) - prior * sum(loss(g(r), -1) for r in p) / len(p)


def test_risk_and_gradient_like_the_definition():
    rng = np.random.default_rng(5)
    p, u = (rng.integers(0, 4, (n, 3)) + np.arange(3) * 4 for n in (30, 50))
    signs = set()
    for prior in (0.3, 0.9, 0.97):
        theta = rng.normal(size=13) * 3
        theta[p[:20]] += 2
        rest, got = quality.nnpu_risk(theta, p, u, prior)
        first, second = slow_risk(theta, p, u, prior)
        assert np.isclose(rest, second)
        signs.add(second >= 0)
        goal = (lambda t, prior=prior: sum(slow_risk(t, p, u, prior))) if second >= 0 else (lambda t, prior=prior: -slow_risk(t, p, u, prior)[1])
        for j in range(13):
            step = np.eye(13)[j] * 1e-5
            assert abs((goal(theta + step) - goal(theta - step)) / 2e-5 - got[j]) < 1e-4
    assert len(signs) == 2


def test_prior_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(6)
    draw = lambda n, good: np.column_stack([np.where(good, rng.integers(2, 8, n), rng.integers(0, 4, n)) + j * 8 for j in range(4)])
    for prior in (0.2, 0.5, 0.85):
        p, u = draw(4000, np.ones(4000, bool)), draw(4000, rng.random(4000) < prior)
        found = (quality.shares_above(p, u, 32) / 4000 / quality.SHARES).min()
        assert abs(found - prior) < 0.06


def test_quality_in_shards(spark):
    docs, labels = labelled(spark, 900)
    rows = quality.shape_rows(docs)
    one, many = quality.fit_on(rows, labels), quality.fit_on(rows, labels, sample=120)
    for model in (one, many):
        assert 0.6 < model.prior < 0.95
        found = quality.score_on(rows, model).collect()
        assert np.mean([(r.score >= 0.3) == (r.doc_id % 5 != 1) for r in found]) > 0.95


def test_ordinal_scores_like_a_slow_loop(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    of = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        bare = re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(texts[r.doc_id]))
        n = Counter(int(word_hashes([w.encode()])[0][0]) for w in bare if w)
        z = sum(of[h] * (1 + math.log(c)) for h, c in n.items() if h in of)
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert math.isclose(r.severity, sum(p), rel_tol=1e-9) and math.isclose(r.toxicity, p[0], rel_tol=1e-9) and r.toxic == (p[0] >= model.cut)


def test_ordinal_gradient_lowers_the_loss_of_the_definition():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    grade = rng.integers(0, 3, 60)

    def loss(w, cuts):
        total = 0.0
        for row, g in zip(x, grade, strict=True):
            for j, cut in enumerate(cuts, 1):
                q = 1 / (1 + math.exp(cut - float(row @ w)))
                total -= math.log(q if g >= j else 1 - q)
        return total

    w, cuts = toxicity.fit_ordinal(x, grade, 3, rounds=3000)
    for j in range(3):
        for step in (-0.05, 0.05):
            assert loss(w, cuts) <= loss(w + step * np.eye(3)[j], cuts) + 1e-3
    assert loss(w, cuts) <= min(loss(w, cuts + [a, b]) for a in (-0.1, 0.1) for b in (-0.1, 0.1))


def test_quality_odd_rows(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels)
    assert quality.score_quality(odd_docs(spark), model).where("score between 0 and 1").count() == len(ODD)
    assert quality.fit_quality(docs, labels.limit(0)) == 0.5
    assert quality.score_quality(docs.limit(0), model).count() == 0
    for r in quality.op6_quality(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def base_scores(docs):
    tokens = lambda t: [*words(t), None]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = Counter(w for i, t in docs if train(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), not train(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for i, t in docs)


def found_scores(df):
    rows = df.collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)


def test_base_scores(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = as_docs(spark, docs)
    assert found_scores(lm.score_documents(df, block_bytes=20_000)) == base_scores(docs)
    held = lm.score_documents(df).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]  # the model predicts unseen documents better than counts of words


def test_lm_odd_rows(spark):
    assert found_scores(lm.score_documents(odd_docs(spark))) == base_scores(ODD)
    assert lm.score_documents(as_docs(spark, []).limit(0)).count() == 0
    only_held = lm.score_documents(as_docs(spark, [(None, "a b")])).first()
    assert only_held.n_known == 0 and only_held.train_tokens == 0


def test_probabilities_of_a_history_sum_to_one():
    rng = np.random.default_rng(1)
    codes = lm.Codes(list(range(1 << 20, (1 << 20) + lm.OWN)))
    low = np.concatenate((np.arange(1 << 20, (1 << 20) + lm.OWN), np.arange(lm.OWN) + (5 << 20))).astype(np.uint32)
    assert sorted(codes.of(low)) == list(range(lm.CLASSES * lm.CODES))
    rows = 1024
    model = lm.Model(codes, *(rng.normal(size=(rows, 32)).astype(np.float32) for _ in range(2)), rng.normal(size=32).astype(np.float32), rng.normal(size=(32, 32)).astype(np.float32))
    tok = np.stack([np.full(len(low), 3), np.full(len(low), 700), np.arange(len(low))], 1).ravel()  # one text for each word after the same two
    p = np.exp(model.log_probs(low, tok, np.arange(len(low) + 1) * 3)[2::3])
    assert np.isclose(p.sum(), 1, atol=1e-4) and p.min() > 0


def slow_mix(x):
    m = 2**64 - 1
    x &= m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def slow_scores(docs, rounds):
    """The model as its docstring reads, a token at a time: log10 probabilities of whole texts."""
    name = lambda w: int(lm.END) if w is None else int(word_hashes([w.encode()])[0][0])
    texts = [(i, [name(w) for w in [*words(t), None]]) for i, t in docs]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    c = Counter(w for i, t in texts if train(i) for w in t)
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    own = {w & 0xFFFFFFFF: r for r, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], signed(x[0])))[: lm.OWN])}
    code = lambda w: own.get(w & 0xFFFFFFFF, lm.OWN + (w & 511))
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[code(w)] += k
        v[code(w)] += 1
    rows = lm.table_rows(sum(c.values()))
    by = np.array([sum(n[32 * k + j] for j in range(32)) for k in range(32)])
    share = (by + 1) / (by + 1).sum()
    inner = np.array([[(n[32 * k + j] + 0.5) / (by[k] + 16) for j in range(32)] for k in range(32)])

    def tokens(t):
        for k, w in enumerate(t):
            one = t[k - 1] & 0xFFFFFFFF if k else 1
            two = t[k - 2] & 0xFFFFFFFF if k > 1 else 1 if k else 2
            cls = code(w) // 32
            f = [x & rows - 1 for x in (slow_mix(one * 3), slow_mix(one * 0x9E3779B97F4A7C15 + two), slow_mix(two * 5 + 9))]
            g = [cls * (rows // 32) + (x & rows // 32 - 1) for x in (slow_mix(one * 7 + 1), slow_mix(two * 11 + 2))]
            yield w, cls, code(w) % 32, f, g

    def softmax(bias, table, at):
        z = np.exp(np.log(bias) + sum(table[r] for r in at))
        return z / z.sum()

    seen, weights = [np.zeros((rows, 32)) for _ in range(2)], [np.zeros((rows, 32)) for _ in range(2)]
    for r in range(rounds + 2):
        expected = [np.zeros((rows, 32)) for _ in range(2)]
        for i, t in texts:
            for _, cls, k, f, g in tokens(t) if train(i) else ():
                for x in f:
                    seen[0][x, cls] += r == 0
                    expected[0][x] += softmax(share, weights[0], f) if r else 0
                for x in g:
                    seen[1][x, k] += r == 0
                    expected[1][x] += softmax(inner[cls], weights[1], g) if r else 0
        shares = share[None], np.repeat(inner, rows // 32, 0)
        if r:
            weights = [np.clip(w + (0.5 if r == 1 else 0.3) * np.log((o + 20 * p) / (e + 20 * p)), -8, 8) for w, o, e, p in zip(weights, seen, expected, shares, strict=True)]
    out = []
    for i, t in texts:
        p = 0.0
        for w, cls, k, f, g in tokens(t):
            smooth = 0.001 if code(w) < lm.OWN else 0.1
            p += math.log10(softmax(share, weights[0], f)[cls] * softmax(inner[cls], weights[1], g)[k] * (c[w] + smooth) / (n[code(w)] + smooth * (v[code(w)] + 1)))
        out.append((str(i), p))
    return sorted(out)


def test_scores_like_a_slow_loop(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(700)]
    docs = [(i, " ".join(vocab[int(700 * rng.random() ** 3)] for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(None, "a b"), (50, None), (51, "never seen words")]
    for rounds in (0, 1):
        got = sorted((str(r.doc_id), r.score) for r in lm.score_documents(as_docs(spark, docs), block_bytes=900, rounds=rounds).collect())
        for (i, p), (j, q) in zip(got, slow_scores(docs, rounds), strict=True):
            assert i == j and abs(p - q) < 1e-3 * max(1, abs(q)), (i, p, q)
