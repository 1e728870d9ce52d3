import pytest

from chromaloom.operators import enrich as E
from chromaloom.operators.decay import decay_histogram
from chromaloom.plans.plots import axis_ticks, plot_feature_grid, plot_scored_map, stacked
from chromaloom.sources.fixtures import sample_catalog
from chromaloom.sources.views import features

from .conftest import SF


def test_grid_from_the_sample_catalog(spark, tmp_path):
    cat = sample_catalog(spark, SF, str(tmp_path / "db"))
    assert sample_catalog(spark, SF, str(tmp_path / "db")).ls() == ["hic.obs", "hic.obs_shuffle"]
    obs, exp = cat.read("hic.obs"), cat.read("hic.obs_shuffle")
    grid, size = E.feature_grid(features(spark, SF, 1), features(spark, SF, 2), obs, exp, None, None, 5000, 500, 20_000, 60_000)
    total, values = plot_feature_grid([grid, grid], 5000, 500, 2000, path=str(tmp_path / "grid.svg"))
    assert total.count() == 25 and values.where("value is not null").count() > 10 and (tmp_path / "grid.svg").read_text().count("<rect") == 25
    assert size.first().grid_size > 0 and E.as_matrix(total, "obs", [-2, -1, 0, 1, 2]).count() == 5
    near, _ = E.feature_grid(features(spark, SF, 1), features(spark, SF, 2), obs, exp, None, None, 5000, 500, 20_000, 60_000, mode="nearest")
    assert near.agg({"obs": "sum"}).first()[0] <= grid.agg({"obs": "sum"}).first()[0]


def test_scored_map(spark, tmp_path):
    cat = sample_catalog(spark, SF, str(tmp_path / "db"))
    pts = cat.read("hic.obs").selectExpr("chrom1", "start1", "start2", "contacts * 5.0D as score")
    ann = features(spark, SF, 1)
    sig = ann.selectExpr("chrom", "start", "end", "1.5D as data")
    svg = plot_scored_map(pts, "chr1", (20_000, 40_000), {"signal": sig}, {"parts": ann}, genes=ann)
    assert svg.count("<circle") > 5 and svg.count("<rect") > 5
    assert svg.count("<line") == 1 and "#42413F" in svg and "#CC79A7" in svg and "20,000" in svg
    plain = plot_scored_map(pts, "chr1", (20_000, 40_000), {"signal": sig}, {"parts": ann}, axis=False, track_colors=("#111111",), annotation_colors=("#222222",), ylims={"signal": (0, 3)}, stacking="dense", ideogram=ann)
    assert "<line" not in plain and "#111111" in plain and "#222222" in plain and "#888888" in plain
    with pytest.raises(ValueError):
        plot_scored_map(pts, "chr1", (0, 9), stacking="none")
    assert stacked([(0, 5), (4, 8), (5, 9), (8, 9)]) == [0, 1, 0, 1] and axis_ticks(20_000, 40_000) == [20_000, 25_000, 30_000, 35_000, 40_000]
    assert decay_histogram(cat.read("hic.obs"), 10, 1024).count() > 10
