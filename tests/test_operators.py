"""Hand-made cases of single operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaloom.config import EngineConfig
from chromaloom.functions.genomic import distance_bin
from chromaloom.operators import contacts as C
from chromaloom.operators import decay as D
from chromaloom.operators import enrich as E
from chromaloom.operators import intervals as I
from chromaloom.operators import viz as Z
from chromaloom.operators.knn import knn_join, nearest
from chromaloom.operators.ks import ks_extremes, ks_score


def walked(obs, exp):
    """The merge as its definition reads."""
    n1, n2 = len(obs) - 1, len(exp) - 1
    i = j = 1
    a = b = 0
    most = least = 0
    while i < n1 and j < n2:
        if obs[i] < exp[j]:
            i, a = i + 1, a + 1
        else:
            j, b = j + 1, b + 1
        n = a * n2 - b * n1
        most, least = max(most, n), min(least, n)
    return 1000 * most // (n1 * n2), -(1000 * -least // (n1 * n2))


def test_ks_by_hand():
    obs, exp = np.array([[0, 1, 2, 3, 4]]), np.array([[0, 5, 6, 7, 8, 9, 10, 11]])
    assert ks_score(obs, exp)[0] == 75.0
    same = np.ones((1, 6), int)
    assert ks_score(same, np.ones((1, 8), int))[0] < 0
    with pytest.raises(ValueError):
        ks_extremes(np.zeros((1, 3)), np.zeros((1, 8)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=4, max_size=14), st.lists(st.integers(0, 30), min_size=4, max_size=20))
def test_ks_like_the_walk(o, e):
    o, e = sorted(o), sorted(e)
    most, least = ks_extremes(np.array([o, o]), np.array([e, e]))
    assert (most[1], least[1]) == walked(o, e)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 12), st.integers(0, 80), st.booleans())
def test_nearest_like_brute_force(seed, k, n, dense):
    rng = np.random.default_rng(seed)
    r = rng.integers(0, 40 if dense else 100_000, (n, 2)).astype(float)
    w = rng.integers(1, 4, n)
    p = rng.integers(-50, 100_000, (7, 2)).astype(float)
    got, ok = nearest(p[:, 0], p[:, 1], r[:, 0], r[:, 1], w, k, np.full(7, np.inf))
    assert ok.all()
    for i in range(7):
        d = np.sort(np.repeat(np.hypot(*(r - p[i]).T), w))[:k] if n else np.zeros(0)
        assert np.allclose(got[i][: len(d)], d) and np.isinf(got[i][len(d) :]).all()


def test_knn_across_tiles(spark):
    rng = np.random.default_rng(3)
    refs = [("a", int(x), int(y), int(n)) for x, y, n in zip(*rng.integers(0, 5000, (2, 300)), rng.integers(1, 4, 300), strict=True)]
    pts = [(i, "a", int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-1000, 9000, (60, 2)))] + [(99, "b", 1, 1)]
    ref = spark.createDataFrame(refs, "chrom string, x long, y long, n long")
    got = {r.point_id: r.distances for r in knn_join(spark.createDataFrame(pts, "point_id long, chrom string, x long, y long"), ref, 9, tile=4096, halo=2048, max_refs=40).collect()}
    assert got == {r.point_id: r.distances for r in knn_join(spark.createDataFrame(pts, "point_id long, chrom string, x long, y long"), ref, 9, tile=700, halo=300).collect()}
    # So narrow that most points reach the last round, whose references come in blocks.
    lone = [(i, c, 60_000 + x, y) for i, c, x, y in pts]
    blocks = {r.point_id: r.distances for r in knn_join(spark.createDataFrame(lone, "point_id long, chrom string, x long, y long"), ref, 9, tile=512, max_refs=50).collect()}
    for i, c, x, y in lone:
        assert blocks.get(i) == (sorted(round(math.hypot(x - a, y - b)) for ch, a, b, n in refs for _ in range(n) if ch == c)[:9] or None)
    for i, c, x, y in pts:
        near = sorted(round(math.hypot(x - a, y - b)) for ch, a, b, n in refs for _ in range(n) if ch == c)[:9]
        assert got.get(i) == (near or None)


def frame(spark, rows):
    return spark.createDataFrame([(c, a, a + 1, c, b, b + 1, n) for c, a, b, n in rows], "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, contacts long")


def test_distance_edges(spark):
    df = frame(spark, [("c", 0, d, 1) for d in (1023, 1024, 1025)])
    assert sorted(r.start2 for r in C.pool([df], None, 1024).collect()) == [1025]
    from chromaloom.functions.genomic import beyond

    assert sorted(r.start2 for r in df.where(beyond(1024, inclusive=True)).collect()) == [1024, 1025]
    bins = [r[0] for r in df.select(distance_bin(10, 1024)).collect()]
    assert bins == [math.floor(math.log2(1 + d) * 10) - 100 for d in (1023, 1024, 1025)]


def test_replication_and_mirror(spark):
    df = frame(spark, [("c", 1, 5, 1), ("c", 2, 6, 2), ("c", 3, 7, 3), ("c", 4, 8, 0)])
    assert C.replicate(df).count() == 6
    assert {(r.start1, r.start2) for r in C.mirror(df.limit(1)).collect()} == {(1, 5), (5, 1)}
    assert C.count_pairs(C.replicate(df)).count() == 3


def test_tiles_and_clipping(spark):
    chroms = spark.createDataFrame([("c", 0, 10)], "chrom string, start long, end long")
    got = sorted((r.start1, r.end1, r.start2, r.end2, r.region_start1, r.region_end2) for r in I.tiles(chroms, 5, 2).collect())
    assert got == [(0, 5, 0, 5, 0, 7), (0, 5, 5, 10, 0, 10), (5, 10, 5, 10, 3, 10)]
    wide = spark.createDataFrame([("c", -3, 4), ("c", 8, 30), ("c", 40, 50), ("x", 0, 1)], "chrom string, start long, end long")
    assert sorted((r.start, r.end) for r in I.clip_to_chromosomes(wide, chroms).collect()) == [(0, 4), (8, 10)]


def test_bins(spark):
    d = spark.createDataFrame([(x,) for x in (-25, -24, -20, 0, 1, 25)], "d long")
    assert [r[0] for r in d.select(E.bin_of(d.d, 25, 5)).collect()] == [1, 1, 1, 5, 6, 10]


def test_pairs_are_strict(spark):
    a = spark.createDataFrame([("c", 100, 110)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 100 + d, 120 + d) for d in (10, 11, 49, 50)], "chrom string, start long, end long")
    assert sorted(r.start2 for r in E.feature_pairs(a, b, 10, 50).collect()) == [111, 149]


@pytest.mark.parametrize("n,multi,bins", [(100, 2, 51), (10, 4, 3)])
def test_rebin_even(spark, n, multi, bins):
    g = spark.createDataFrame([(i, j, 1, 1) for i in range(1, n + 1) for j in (1, 2)], "bin1 int, bin2 int, obs long, exp long")
    got = {r.bin1: r.obs for r in E.rebinned(g, n // 2, 1, multi).groupBy("bin1").sum("obs").withColumnRenamed("sum(obs)", "obs").collect()}
    assert len(got) == bins and sum(got.values()) == 2 * n and got[0] == 2 * multi
    with pytest.raises(ValueError):
        E.rebinned(g, n // 2, 1, 3)


def test_rebin_odd(spark):
    g = spark.createDataFrame([(i, 1, 1) for i in range(1, 6)], "bin1 int, bin2 int, obs long")
    got = {r.bin1: r.obs for r in E.rebinned(g, 5, 2, 6).groupBy("bin1").sum("obs").withColumnRenamed("sum(obs)", "obs").collect()}
    assert got == {-1: 1, 0: 3, 1: 1}


def test_grid_values(spark):
    g = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 2, 3), (2, 1, 0, 4)], "bin1 int, bin2 int, obs long, exp long")
    got = {(r.bin1, r.bin2): r.value for r in E.grid_values(g).collect()}
    assert got[1, 1] == pytest.approx(math.log2(0.5 / 0.125)) and got[2, 1] is None
    with pytest.raises(ValueError):
        E.grid_values(g, "other")


def test_palette(spark):
    p = Z.score_palette()
    assert len(p) == 201 and p[100] == "#D3D3D3" and p[0] == "#000000" and p[200] == "#FFFF00"
    by_hand = {1: "D3D3D3", 15: "D3D3D3", 16: "D3D3D3", 25: "FFC0CB", 26: "FFC0CB", 45: "FF0000", 46: "FF0000", 60: "FFA500", 85: "FFFF00", 86: "FFFF00", -15: "D3D3D3", -20: "ADD8E6", -50: "0000FF", -85: "000000", 53: "FF5200"}
    assert {k: p[100 + k] for k in by_hand} == {k: "#" + v for k, v in by_hand.items()}
    with pytest.raises(ValueError):
        Z.palette_stops(("red", "blue"), (3,))
    assert Z.palette_frame(spark).where("score = 0").first().level == 101
    with pytest.raises(ValueError):
        Z.map_points(spark.range(1))


def test_lanes_and_pictures(spark):
    pts = spark.createDataFrame([(10, 30, 5.0), (30, 10, 1.0), (20, 90, -40.5)], "start1 long, start2 long, score double")
    drawn = Z.scored_points(pts).collect()
    assert [(r.x, r.y, r.level) for r in drawn] == [(55.0, 35.0, 60), (20.0, 10.0, 106)]
    assert Z.svg_map(Z.scored_points(pts)).count("<circle") == 2
    sig = spark.createDataFrame([("c", 0, 10, 1.0), ("c", 10, 20, None)], "chrom string, start long, end long, data double")
    ann = spark.createDataFrame([("c", 5, 50, 1), ("c", 7, 9, -1)], "chrom string, start long, end long, strand int")
    lanes = Z.tracks_and_annotations("c", 2, 30, {"s": sig}, {"a": ann}, genes=ann).collect()
    assert [(r.lane, r.start, r.end) for r in lanes if r.lane == "s"] == [("s", 2, 10)] and len(lanes) == 5
    assert {r.sign for r in Z.annotation_lane(ann, "c", 0, 99, True).collect()} == {"+", "-"}
    cells = spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], "bin1 int, bin2 int, value double")
    assert Z.svg_grid(cells).count("<rect") == 2 and "#FF8080" in Z.svg_grid(cells) and "#CCCCCC" in Z.svg_grid(cells)
    assert "#FFFF00" in Z.svg_grid(cells, (0, 0.5), palette=("black", "yellow"))


def test_decay():
    assert D.auto_resolution(10, 1024, 1024) == 0 and D.auto_smooth(500) == 20
    raw = np.arange(60.0) + 1
    assert np.allclose(D.smooth_vector(raw, 5), raw)
    flat = np.concatenate((np.zeros(10), np.full(50, 7.0)))
    out = D.smooth_vector(flat, 3)
    assert (out[:3] == 0).all() and np.allclose(out[14:], 7)
    live = D.expected_decay(np.array([0, 0, 100.0, 200.0, 3.0]), 0)
    assert live[0] == D.LOG_ZERO and live[4] == D.LOG_ZERO and live[3] == pytest.approx(math.log(200 + 5 / 303))
    p = D.corrected_proposal(np.log(np.full(3, 1 / 3)), np.array([50, 100, 0.0]), np.log(np.array([100.0, 50, 10])))
    assert p[1] > p[0] > p[2] == pytest.approx(D.LOG_ZERO, abs=3)


def test_config(tmp_path):
    f = tmp_path / "c.conf"
    f.write_text("k = 50\nscore_filter = 12.5 # note\n")
    c = EngineConfig.from_file(str(f), EngineConfig(k=7))
    assert c.k == 7 and c.score_filter == 12.5
    assert EngineConfig.from_file(str(f), EngineConfig(k=7), reset=True).k == 50
    f.write_text("k = 1\nk = 2\n")
    with pytest.raises(ValueError):
        EngineConfig.from_file(str(f))
    f.write_text("kk = __import__('os')\n")
    with pytest.raises(ValueError):
        EngineConfig.from_file(str(f))


def test_config_round_trip(tmp_path):
    c = EngineConfig(k=33, score_pal_zero="red")
    c.dump(str(tmp_path / "c"))
    assert EngineConfig.from_file(str(tmp_path / "c"), reset=True) == c and c.get_list("score_pal_neg")[-1] == "black"


def test_config_comments_and_colours(tmp_path):
    (tmp_path / "c").write_text("# all = of it\nk = 33 # neighbours\nscore_pal_zero = red # plain\ntrack_colors = ('#42413F', '#E69F00')  # two\n")
    c = EngineConfig.from_file(str(tmp_path / "c"))
    assert (c.k, c.score_pal_zero, c.track_colors) == (33, "red", ("#42413F", "#E69F00"))


def test_proposals():
    assert np.exp(D.constant_proposal(7)).sum() == pytest.approx(1)
    area = np.exp(D.area_proposal(200, 10, 0, 1e6))
    assert area.sum() == pytest.approx(1) and area[50] > area[10]
    assert np.exp(D.sampled_proposal(np.array([0, 3.0, 1]), 0)).sum() == pytest.approx(1)


def test_virtual_track(spark):
    from chromaloom.operators.virtual import VirtualTrack, screen

    track = frame(spark, [("c", 10, 20, 5), ("c", 14, 22, 9), ("c", 30, 90, 1), ("d", 10, 20, 7)])
    rects = frame(spark, [("c", 11, 20, 1), ("c", 29, 88, 1), ("c", 500, 600, 1)]).drop("contacts")
    v = VirtualTrack("v", track, "max", "contacts", (-3, 3), (-3, 3))
    assert {r.start1: r.v for r in v.over(rects).collect()} == {11: 9, 29: 1, 500: None}
    assert {r.start1: r.v for r in v.shifted((-1, 0), (0, 1)).over(rects, bucket=4).collect()} == {11: 5, 29: None, 500: None}
    assert [r.start1 for r in screen(v, rects, 5).collect()] == [11] and screen(v, rects, 0, (-60, -58)).first().start1 == 29
