"""The whole-track forms of the kNN, KS and score queries against brute force on the smallest tables."""

from collections import defaultdict

import numpy as np

from chromaloom.config import EngineConfig
from chromaloom.operators import shuffle
from chromaloom.operators.ks import ks_score
from chromaloom.plans.queries import QUERIES
from chromaloom.sources.views import contacts

from .conftest import SF

K = 100
ran = shuffle.shuffle_contacts


def nearest(points, refs, k):
    """Of each point that has k neighbours, their distances in ascending order."""
    out = {}
    for c, x, y in points:
        r = refs[c]
        if len(r) >= k:
            out[c, x, y] = np.sort(np.rint(np.sqrt(((r - (x, y)) ** 2).sum(1).astype(np.float64))).astype(np.int64))[:k]
    return out


def test_every_contact_like_brute_force(spark):
    far, every, points = {}, {}, set()
    for src in ("obs", "exp"):
        f, e = defaultdict(list), defaultdict(list)
        for r in contacts(spark, SF, src).collect():
            e[r.chrom1].append((r.start1, r.start2))
            if abs(r.start1 - r.start2) > 1024:
                f[r.chrom1] += [(r.start1, r.start2)] * r.contacts
                if src == "obs":
                    points.add((r.chrom1, r.start1, r.start2))
        far[src], every[src] = ({c: np.array(v) for c, v in d.items()} for d in (f, e))
    assert {c for c, *_ in points} == {"chr1", "chr2", "chr3"}
    obs, exp = nearest(points, far["obs"], K), nearest(points, far["exp"], 2 * K)
    for name, want in (("knn_obs", obs), ("knn_exp", exp)):
        got = {(r.chrom, r.start1, r.start2): r.distances for r in QUERIES[name](spark, SF).collect()}
        assert got.keys() == want.keys() and all(list(map(int, d.split(","))) == want[key].tolist() for key, d in got.items())
    keys = sorted(points)
    for name, o, e in (("ks_components", obs, exp), ("kk_score", nearest(points, every["obs"], K), nearest(points, every["exp"], 2 * K))):
        want = dict(zip(keys, ks_score(np.stack([o[x] for x in keys]), np.stack([e[x] for x in keys])), strict=True))
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == len(keys)
        for r in rows:
            score = r.score if name == "kk_score" else (r.max_d if -r.min_d < r.max_d else r.min_d) / 10
            assert abs(score - want[r.chrom, r.start1, r.start2]) < 1e-6


def test_shuffle_query_mixes_by_the_default(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(shuffle, "shuffle_contacts", lambda *a, **b: seen.update(sweeps=a[5]) or ran(*a[:5], 0, *a[6:], **b))
    QUERIES["shuffle_track"](spark, SF.replace("0.001", "0.01"))
    assert seen == {"sweeps": EngineConfig().shuffle}
