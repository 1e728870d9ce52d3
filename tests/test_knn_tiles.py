"""The first tiles of the kNN join are wide enough to hold more than a handful of references."""

import numpy as np

from chromaloom.operators import knn
from chromaloom.operators.knn import _first_round


def test_first_tiles_are_wide_and_halos_narrow(spark):
    """A tile of 2**18 with a halo as wide sent every reference to nine tiles of few points."""
    refs = spark.range(10_000).selectExpr("'c' as chrom", "id % 100 * 100000 as x", "id div 100 * 100000 as y", "1L as n", "0 as src")
    tile, rim = _first_round(refs, [4], 1 << 18, 9_900_000)
    assert tile == (1 << 18) * 32 and 0 < rim < tile // 8


def test_several_tiles_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xy, n = rng.integers(0, 6_000_000, (1500, 2)), rng.integers(1, 4, 1500)
    refs = spark.createDataFrame([("c", int(x), int(y), int(w)) for (x, y), w in zip(xy, n, strict=True)], "chrom string, x long, y long, n long")
    points = refs.selectExpr("x * 10000000 + y as point_id", "chrom", "x", "y").distinct()
    monkeypatch.setattr(knn, "_REFS", 120)
    got = {r.point_id: r.distances for r in knn.knn_join(points, refs, 9).collect()}
    every = np.repeat(xy, n, axis=0)
    want = {int(x) * 10_000_000 + int(y): np.rint(np.sort(np.sqrt(((every - (x, y)) ** 2).sum(1)))[:9]).astype(int).tolist() for x, y in xy}
    assert got == want
