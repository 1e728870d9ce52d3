"""Catalog, shuffles, whole-track scoring and the local mode."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.config import EngineConfig
from chromaloom.operators import shuffle as H
from chromaloom.operators.ks import ks_score
from chromaloom.operators.score import score_points, score_track
from chromaloom.plans import jobs
from chromaloom.sources.catalog import TrackCatalog, read_intervals_tsv, write_tsv
from chromaloom.sources.views import chromosomes, contacts

from .conftest import SF
from .test_operators import frame


def test_catalog(spark, tmp_path):
    cat = TrackCatalog(spark, str(tmp_path / "db"))
    obs = contacts(spark, SF, "obs")
    write_tsv(obs, str(tmp_path / "obs.tsv"))
    cat.import_contacts("hic.obs", str(tmp_path / "obs.tsv"))
    assert cat.exists("hic.obs") and not cat.exists("hic.exp") and cat.ls() == ["hic.obs"]
    assert cat.read("hic.obs").count() == obs.count()
    rect = {"chrom1": "chr1", "start1": 0, "end1": 50_000, "start2": 0, "end2": 50_000}
    assert cat.extract("hic.obs", rect, (-20_000, -1023)).count() == obs.where("chrom1 = 'chr1' and start1 < 50000 and start2 < 50000 and start1 - start2 >= -20000 and start1 - start2 < -1023").count()
    with pytest.raises(ValueError):
        cat.write("twice", obs.unionByName(obs))
    with pytest.raises(KeyError):
        cat.read("none")
    banded = cat.extract("hic.obs", None, (-20_000, -1023))
    assert "dist" not in banded.columns and "GreaterThanOrEqual(dist,-20000)" in banded._jdf.queryExecution().toString()
    assert not any("twice" in n or n.startswith("_") for n in cat.ls())
    assert cat.rm("hic.obs") and not cat.exists("hic.obs") and not cat.rm("hic.obs")


def test_catalog_names_signals_and_sets(spark, tmp_path):
    cat = TrackCatalog(spark, str(tmp_path / "db"))
    assert cat.ls() == []
    two = contacts(spark, SF, "obs").limit(20)
    one = spark.createDataFrame([("chr1", 0, 10, 1.5), ("chr1", 30, 40, None), ("chr2", 5, 9, 2.0)], "chrom string, start long, end long, data double")
    sets = one.select("chrom", "start", "end").withColumn("strand", F.lit(1))
    for name, df in (("a1", two), ("a2.b", two), ("a3.b.c", two), ("a4.b.c.d", two), ("chip.k4", one), ("annots.ctcf.fwd", sets)):
        cat.write(name, df)
    assert cat.ls() == ["a1", "a2.b", "a3.b.c", "a4.b.c.d", "annots.ctcf.fwd", "chip.k4"] and cat.ls("b.c") == ["a3.b.c", "a4.b.c.d"]
    assert cat.exists("annots.ctcf.fwd") and not cat.exists("annots.ctcf") and cat.read("a4.b.c.d").count() == 20
    assert cat.read("chip.k4").count() == 3 and [r.start for r in cat.overlapping("chip.k4", "chr1", 9, 31).orderBy("start").collect()] == [0, 30]
    for bad in (lambda: cat.extract("chip.k4"), lambda: cat.overlapping("a1", "chr1", 0, 9), lambda: cat.write("x", two.select("chrom1"))):
        with pytest.raises(ValueError):
            bad()
    cat.write("chip.k4", one.limit(1))
    assert cat.read("chip.k4").count() == 1 and cat.rm("chip.k4") and "chip.k4" not in cat.ls()
    write_tsv(sets, str(tmp_path / "sets"))
    assert read_intervals_tsv(spark, str(tmp_path / "sets")).count() == 3 and read_intervals_tsv(spark, str(tmp_path / "sets"), data=True).columns[-1] == "data"


def test_shuffle_keeps_marginals(spark):
    rows = H.contact_rows(contacts(spark, SF, "obs").where("abs(start1 - start2) >= 1024 and start1 < start2"))
    got = H.shuffle_contacts(rows, 20, 2, seed=4, sweeps=1.5, max_rounds=12, salts=2)
    again = H.shuffle_contacts(rows, 20, 2, seed=4, sweeps=1.5, max_rounds=12, salts=2)
    before, after = rows.collect(), got.contacts.collect()
    assert Counter((r.chrom, r.x) for r in before) == Counter((r.chrom, r.x) for r in after)
    assert Counter((r.chrom, r.y) for r in before) == Counter((r.chrom, r.y) for r in after)
    assert got.sweeps > 0.5 and all(abs(r.x - r.y) + 1 >= 1024 for r in after)
    assert {(r.cid, r.y) for r in after} == {(r.cid, r.y) for r in again.contacts.collect()}
    assert got.history[-1]["total_variation"] < 0.25
    for how in ("area", "constant"):
        assert H.shuffle_contacts(rows, 20, 2, sweeps=0.3, max_rounds=2, proposal_from=how).sweeps > 0
    with pytest.raises(ValueError):
        H.shuffle_contacts(rows, 20, 2, proposal_from="none")


def test_each_chromosome_keeps_its_decay(spark):
    rng = np.random.default_rng(2)
    rows = []
    for chrom, lo, hi in (("chr1", 10, 15.9), ("chr2", 17, 20)):
        d, x = (2 ** rng.uniform(lo, hi, 4000)).astype(int) + 1024, rng.integers(0, 2_000_000, 4000)
        rows += [(chrom, int(a), int(a + b)) for a, b in zip(x, d, strict=True)]
    track = spark.createDataFrame(rows, "chrom1 string, start1 long, start2 long").groupBy("chrom1", "start1", "start2").agg(F.count("*").alias("contacts"))
    track = track.selectExpr("chrom1", "start1", "start1 + 1 as end1", "chrom1 as chrom2", "start2", "start2 + 1 as end2", "contacts")

    def beyond(df):
        far = F.sum(F.when(F.abs(F.col("start1") - F.col("start2")) > 65_536 + 1024, F.col("contacts")).otherwise(0)) / F.sum("contacts")
        return {r.chrom1: r.far for r in df.groupBy("chrom1").agg(far.alias("far")).collect()}

    report = []
    both = beyond(H.shuffle_track(track, resolution=10, sweeps=3, report=report))
    alone = {c: beyond(H.shuffle_track(track.where(F.col("chrom1") == c), resolution=10, sweeps=3))[c] for c in both}
    before = beyond(track)
    assert set(report[0].status.values()) == {"mixed"} and report[0].sweeps >= 3
    for c in both:
        assert abs(both[c] - alone[c]) < 0.01 and abs(both[c] - before[c]) < 0.03
    assert {h["chrom"] for h in report[0].history} == {"chr1", "chr2"}


def test_tile_steps_like_a_slow_loop():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40_000, (2, 200))
    keep = np.abs(x - y) > 1100
    x, y = x[keep], y[keep]
    cid = rng.integers(-(2**62), 2**62, len(x))
    size = 10 * 17
    d = H.Decay(10, 100, len(x), rng.normal(size=size), rng.normal(size=size))
    got, moved, _ = H.shuffled_tile(cid, x, y, d, 9000, range(3), 77)
    want, times, gain = y.copy(), np.zeros(len(x), int), d.gain()
    for k in range(3):
        ox, oy, salt = (H._salt(77, k, i) for i in (1, 2, 3))
        r = [int(H._mixed(np.array([c], np.int64).view(np.uint64) ^ np.uint64(salt))[0]) for c in cid]
        cells = {}
        for i in sorted(range(len(x)), key=lambda i: r[i] >> 28):
            cells.setdefault(((x[i] + ox % 9000) // 9000, (want[i] + oy % 9000) // 9000), []).append(i)
        for members in cells.values():
            for i, j in zip(members[::2], members[1::2]):
                bins = [int(d.bins(np.array([a]), np.array([b]))[0]) for a, b in ((x[i], want[j]), (x[j], want[i]), (x[i], want[i]), (x[j], want[j]))]
                u = (int(H._mixed(np.array([r[i] ^ r[j] >> 7], np.uint64))[0]) >> 11) / 2**53
                if min(bins[:2]) >= 0 and u < math.exp(min(0, gain[bins[0]] + gain[bins[1]] - gain[bins[2]] - gain[bins[3]])):
                    want[i], want[j] = want[j], want[i]
                    times[[i, j]] += 1
    assert (got == want).all() and (moved == times).all() and moved.sum() > 20
    assert sorted(got) == sorted(y)


def test_rounds_that_end_early_say_so(spark):
    rows = H.contact_rows(contacts(spark, SF, "obs").where("abs(start1 - start2) >= 1024 and start1 < start2"))
    got = H.shuffle_contacts(rows, 20, 2, sweeps=50, max_rounds=2)
    assert set(got.status.values()) == {"out of rounds"}
    lone = H.shuffle_contacts(rows.limit(1), 20, 2, sweeps=1, steps=1)
    assert set(lone.status.values()) == {"stuck"} and lone.contacts.count() == 1
    none = H.shuffle_contacts(rows.limit(0), 20, 2)
    assert none.status == {} and none.contacts.count() == 0
    with pytest.warns(UserWarning, match="out of rounds"):
        H.shuffle_track(contacts(spark, SF, "obs"), resolution=10, config=EngineConfig(min_shuffle_rows=10), max_rounds=1)
    rect = {"chrom1": "chr1", "start1": 0, "end1": 60_000, "start2": 0, "end2": 60_000}
    part = H.shuffle_track(contacts(spark, SF, "obs"), resolution=10, sweeps=0.5, config=EngineConfig(min_shuffle_rows=10), rect=rect)
    assert part.where("chrom1 <> 'chr1' or start1 >= 60000 or start2 >= 60000").isEmpty() and part.count() > 100


def test_shuffled_track_has_twice_the_contacts(spark):
    obs = contacts(spark, SF, "obs")
    upper = obs.where("start2 - start1 >= 1024").agg(F.sum("contacts")).first()[0]
    out = H.shuffle_track(obs, resolution=10, sweeps=0.5, config=EngineConfig(min_shuffle_rows=10))
    assert out.agg(F.sum("contacts")).first()[0] == 4 * upper
    small = H.shuffle_track(obs)
    assert small.agg(F.sum("contacts")).first()[0] == 2 * upper


def brute_scores(obs, exp, points, k, ke):
    def near(p, refs, n):
        d = sorted(np.rint(np.hypot(p[0] - a, p[1] - b)) for a, b, c in refs for _ in range(c))
        return d[:n] if len(d) >= n else None

    out = {}
    for p in points:
        o, e = near(p, obs, k), near(p, exp, ke)
        if o and e:
            out[p] = ks_score(np.array([o]), np.array([e]))[0]
    return out


def test_whole_track_like_brute_force(spark):
    chroms = chromosomes(spark, SF)
    obs, exp = contacts(spark, SF, "obs"), contacts(spark, SF, "exp")
    scores, status = score_track([obs], [exp], chroms, near_cis=60_000, expand=15_000, k=10, min_points=60, tile=20_000, halo=3_000)
    got = {(r.chrom1, r.start1, r.start2): r.score for r in scores.collect()}
    rows = {n: [(r.chrom1, r.start1, r.start2, r.contacts) for r in t.collect() if abs(r.start1 - r.start2) > 1024] for n, t in (("obs", obs), ("exp", exp))}
    want, made = {}, {}
    for t in status.collect():
        inside = [r for r in rows["obs"] if r[0] == t.chrom and t.start1 <= r[1] < t.end1 and t.start2 <= r[2] < t.end2]
        assert len(inside) == t.n_points
        made[t.tile] = t
        if len(inside) < 60:
            assert t.status == 0
            continue
        pts = {(a, b) for _, a, b, _ in inside if a <= b}
        region = lambda n, t=t: [(a, b, c) for ch, a, b, c in rows[n] if ch == t.chrom and t.start1 // 60_000 * 60_000 - 15_000 <= a < (t.start1 // 60_000 + 1) * 60_000 + 15_000 and t.start2 - 15_000 <= b < (t.start2 // 60_000 + 1) * 60_000 + 15_000]
        want |= {(t.chrom, *p): s for p, s in brute_scores(region("obs"), region("exp"), sorted(pts)[:25], 10, 20).items()}
    assert len(want) > 40 and {k: got.get(k) for k in want} == want
    assert jobs.missing_tiles(status, status).count() == 0


def test_scores_are_symmetric_and_gated(spark):
    rng = np.random.default_rng(1)
    a, b = ([("c", int(x), int(y), 1) for x, y in {tuple(p) for p in rng.integers(0, 40_000, (300, 2)).tolist()} if abs(x - y) > 1024] for _ in range(2))
    turned = lambda rows: [(c, y, x, n) for c, x, y, n in rows]
    region = {"chrom1": "c", "start1": 0, "end1": 50_000, "start2": 0, "end2": 50_000}
    get = lambda o, e: {(r.start1, r.start2): r.score for r in score_points([frame(spark, o)], [frame(spark, e)], frame(spark, o), region, k=10).collect()}
    one, two = get(a, b), get(turned(a), turned(b))
    assert len(one) == len(a) and {(y, x): s for (x, y), s in one.items()} == two
    assert score_points([frame(spark, a[:5])], [frame(spark, b)], frame(spark, a), region, k=10).count() == 0
    assert score_points([frame(spark, a)], [frame(spark, b)], frame(spark, a), region, k=10, k_exp=None).count() == len(a)


def test_jobs_and_local_mode(spark, tmp_path):
    cat = TrackCatalog(spark, str(tmp_path))
    obs = contacts(spark, SF, "obs")
    cat.write("obs", obs)
    c = EngineConfig(min_shuffle_rows=100, k=10, min_points=50, local_expand=20_000, shuffle=1, max_resolution=20)
    assert jobs.shuffle_to_track(cat, "obs", config=c) == "obs_shuffle"
    with pytest.raises(FileExistsError):
        jobs.shuffle_to_track(cat, "obs", config=c)
    status = jobs.score_to_track(cat, "obs_score", ["obs"], config=c)
    assert status.where("status = 1").count() == 3
    assert cat.read("obs_score").where("start1 > start2").isEmpty()
    focus = {"chrom1": "chr1", "start1": 20_000, "end1": 60_000, "start2": 20_000, "end2": 60_000}
    local = jobs.shuffle_and_score([obs], focus, 110_000, c)
    assert local.where("score between -100 and 100").count() == local.count() > 10
    with pytest.raises(ValueError):
        jobs.shuffle_and_score([obs], focus | {"chrom2": "chr2"}, 110_000, c)
    assert jobs.shuffle_and_score([obs], focus | {"start1": 1, "end1": 2}, 110_000, c) is None


def test_stream(spark, tmp_path):
    from chromaloom.streaming import incremental as S

    write_tsv(contacts(spark, SF, "obs"), str(tmp_path / "in"))
    stream = S.contact_stream(spark, str(tmp_path / "in"))
    q = S.running_counts(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == contacts(spark, SF, "obs").count()
    found = []
    S.on_new_tiles(stream, 50_000, str(tmp_path / "cp"), lambda df, epoch: found.append(df.count())).awaitTermination(60)
    assert sum(found) > 3


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
