import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from chromaloom.llm import components, neardup

from ..conftest import SF
from .cases import ODD, as_docs, odd_docs, words


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, per_cent):
    sets = [shingles(t, k) for _, t in docs]
    shared, by = Counter(), {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for at in by.values():
        shared.update(combinations(at, 2))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            groups[find(i)] = min(groups.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(groups.get(find(i)))) for i, (d, _) in enumerate(docs))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("k,per_cent", [(3, 85), (5, 80)])
def test_components_like_brute_force(spark, k, per_cent):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijklmnopq") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))] for _ in range(20)]
    docs = []
    for i in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            if w:
                w[rng.randrange(len(w))] = rng.choice("xyz")
        docs.append((i, " ".join(w)))
    assert got(neardup.near_duplicates(as_docs(spark, docs), words=k, per_cent=per_cent, block=16)) == brute(docs, k, per_cent)


def test_boilerplate_makes_few_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    notice = [word() for _ in range(60)]
    docs = [(i, " ".join(notice + [word() for _ in range(60)])) for i in range(600)]
    docs += [(1000 + i, f"{docs[0][1]} {word()}") for i in range(400)]
    df = as_docs(spark, docs)
    count = neardup.bands_for(0.85) * neardup.ROWS
    classes = neardup._classes(neardup.written(neardup._signatures(df, "doc_id", "text", 3, count)))
    members = neardup._members(classes, 64)
    best = neardup._best(members, count, 85)
    assert members.where("blocks > 1").count() > 0 and best.count() <= 1000
    links = best.selectExpr("a as u", "b as v")
    needed = neardup._needed(neardup._blocks_met(members, classes, components.connected_components(links)), count, 85)
    assert needed.count() <= 1000  # unlike texts under one notice are no candidates
    assert got(neardup.near_duplicates(df, words=3, per_cent=85, block=64)) == brute(docs, 3, 85)


def test_ids_that_repeat_with_other_texts(spark):
    a, b = "one two three four five six seven", "all other words stand in this text here"
    docs = [(5, a), (6, a + " eight"), (6, b), (7, b)]
    assert got(neardup.near_duplicates(as_docs(spark, docs), words=3, per_cent=80)) == brute(docs, 3, 80)


def test_odd_rows(spark):
    # Rows without an id keep a component of their own that has no name.
    assert got(neardup.near_duplicates(odd_docs(spark), words=3, per_cent=85)) == brute(ODD, 3, 85)
    assert neardup.near_duplicates(as_docs(spark, []).limit(0)).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = neardup.op2_neardup(spark, SF)
    assert got(found) == brute(docs, 3, 85)
    assert found.where("kept").count() == found.select("component_id").distinct().count()


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**62, 3000).astype(np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[1000:])
    count = 2048
    sig = [neardup.packed_bits(neardup.minima(s, count))[None] for s in (a, b)]
    assert abs(neardup.estimated(*sig, count)[0, 0] - 1 / 3) < 0.06 and neardup.estimated(sig[0], sig[0], count)[0, 0] == 1


def test_chain_of_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (200, 100)}


def test_components_together_and_by_rounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(2**40 + i + 1, 2**40 + i) for i in range(60)]
    expected = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in expected:
        for a, b in edges:
            if a != b:
                expected[a] = expected[b] = min(expected[a], expected[b])
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (1 << 21, len(edges) - 20):
        found = components.connected_components(df, few).collect()
        assert len(found) == len(expected) and {r.node: r.root for r in found} == expected
    assert components.connected_components(df.where("u = v")).count() == 0


def test_few_edges_need_few_jobs(spark):
    edges = neardup.written(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"))
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        assert components.connected_components(edges).count() == 41
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 8


def test_stored_keys_with_repeats(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)], "id long, text string")
    ids = neardup.written(spark.createDataFrame([(i % 7,) for i in range(100)], "id long"))
    for most in (32 << 20, 200, 10):  # with repeats, without, and joined
        assert sorted(r.id for r in neardup.matched(docs, ids, ["id"], "left_semi", most, stored=True).collect()) == list(range(7))
        assert sorted(r.id for r in neardup.matched(docs, ids, ["id"], "left_anti", most, stored=True).collect()) == list(range(7, 50))


@pytest.mark.parametrize("count, per_cent", [(116, 85), (160, 80)])
def test_bit_counts_lose_few_links(count, per_cent):
    share = per_cent / 100 + (1 - per_cent / 100) / 2**neardup.BITS
    least = neardup.least_equal(count, share)
    below = lambda k: sum(math.comb(count, i) * share**i * (1 - share) ** (count - i) for i in range(k))
    kept = []
    for equal in range(count + 1):
        a, b = np.zeros(count, np.uint32), np.arange(count, dtype=np.uint32) >= equal
        sig = [neardup.packed_bits(x)[None] for x in (a, b.astype(np.uint32))]
        n = np.array([50])
        if neardup.candidates(sig[0], n, sig[1], n, count, per_cent)[0, 0] > -np.inf:
            kept.append(equal)
    assert below(kept[0]) <= 1e-9 and kept[0] == least


def test_groups_just_under_the_threshold(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(100)]
    docs = []
    for i in range(300):  # pairs of a similarity about the threshold: links are rare and chains of them make the groups
        w = list(base)
        for _ in range(rng.choice([2, 3, 3, 4])):
            w[rng.randrange(100)] = word()
        docs.append((i, " ".join(w)))
    for block in (32, 1024):
        assert got(neardup.near_duplicates(as_docs(spark, docs), words=3, per_cent=85, block=block)) == brute(docs, 3, 85)


def test_shared_counts_like_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 5, 90, 300, 700)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(5)))
    for width in (64, 1 << 14):
        (both,) = neardup.shared_counts(sets, [(i, j)], width)
        assert all(n == len(set(sets[a]) & set(sets[b])) for n, a, b in zip(both, i, j, strict=True) if a != b)
