"""Enrichment of contacts around pairs of features: range joins, 2-D histograms, re-binning, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_pairs(first: DataFrame, second: DataFrame, min_dist: int, max_dist: int) -> DataFrame:
    """Pairs on a chromosome with min_dist < start2 - start1 < max_dist, strictly.

    A pair meets in the bucket of the second start, which is the bucket of the first or the next one.
    """
    b = F.floor(F.col("start") / max_dist)
    a = first.distinct().select("chrom", F.col("start").alias("start1"), F.col("end").alias("end1"), F.explode(F.array(b, b + 1)).alias("bucket"))
    c = second.distinct().select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"), b.alias("bucket"))
    gap = F.col("start2") - F.col("start1")
    return a.join(c, ["chrom", "bucket"]).where((gap > min_dist) & (gap < max_dist)).select("chrom", "start1", "end1", "start2", "end2")


def midpoints(pairs: DataFrame) -> DataFrame:
    """The middle base of each side of a pair."""
    mid = lambda s, e: F.col(s) + F.floor((F.col(e) - F.col(s)) / 2)
    return pairs.select("chrom", mid("start1", "end1").alias("anchor1"), mid("start2", "end2").alias("anchor2"))


def boxed(points: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """Points (chrom1, start1, start2, ...) with the anchors whose box of ``reach`` on both axes, ends included, holds them.

    Anchors are sent to the buckets, twice ``reach`` wide, that their box touches: four at most.
    """
    wide = 2 * reach + 1
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / wide), F.floor((F.col(c) + reach) / wide)))
    a = anchors.select(F.col("chrom").alias("chrom1"), "anchor1", "anchor2", touched("anchor1").alias("bx")).withColumn("by", touched("anchor2"))
    p = points.withColumns({"bx": F.floor(F.col("start1") / wide), "by": F.floor(F.col("start2") / wide)})
    near = (F.abs(F.col("start1") - F.col("anchor1")) <= reach) & (F.abs(F.col("start2") - F.col("anchor2")) <= reach)
    return p.join(a, ["chrom1", "bx", "by"]).where(near).drop("bx", "by")


def score_filtered(anchors: DataFrame, scores: DataFrame, reach: int, least: float) -> DataFrame:
    """Anchor pairs with a score over ``least`` in their box."""
    high = boxed(scores.where(F.col("score") > least).select("chrom1", "start1", "start2"), anchors, reach)
    return anchors.join(high.select(F.col("chrom1").alias("chrom"), "anchor1", "anchor2").distinct(), ["chrom", "anchor1", "anchor2"], "left_semi")


def bin_of(offset: Column, reach: int, resolution: int) -> Column:
    """Right-closed bins from 1; the lowest edge belongs to the first."""
    return F.greatest(F.lit(1), F.ceil((offset + reach) / resolution)).cast("int")


def grid_counts(contacts: DataFrame, anchors: DataFrame, reach: int, resolution: int, min_dist: int, max_dist: int, mode: str = "all") -> DataFrame:
    """bin1, bin2, n: distinct contacts of the band min_dist < start2 - start1 <= max_dist around the anchors.

    ``mode`` "nearest" counts a contact at its nearest anchor pair only.
    """
    d = F.col("start1") - F.col("start2")
    points = contacts.where((d >= -max_dist) & (d < -min_dist)).select("chrom1", "start1", "start2").distinct()
    hits = boxed(points, anchors.distinct(), reach)
    d1, d2 = F.col("start1") - F.col("anchor1"), F.col("start2") - F.col("anchor2")
    if mode == "nearest":
        least = F.min_by(F.struct("anchor1", "anchor2"), F.struct(F.abs(d1) + F.abs(d2), "anchor1", "anchor2"))
        hits = hits.groupBy("chrom1", "start1", "start2").agg(least.alias("a")).select("start1", "start2", "a.anchor1", "a.anchor2")
    return hits.groupBy(bin_of(d1, reach, resolution).alias("bin1"), bin_of(d2, reach, resolution).alias("bin2")).agg(F.count("*").alias("n"))


def lattice(spark, reach: int, resolution: int) -> DataFrame:
    bins = spark.range(1, 2 * reach // resolution + 1)
    return bins.select(F.col("id").cast("int").alias("bin1"), F.explode(F.sequence(F.lit(1), F.lit(2 * reach // resolution))).alias("bin2"))


def feature_grid(first: DataFrame, second: DataFrame, obs: DataFrame, exp: DataFrame, scores: DataFrame | None = None, score_filter: float | None = 30.0, reach: int = 25_000, resolution: int = 500, min_dist: int = 200_000, max_dist: int = 1_000_000, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """(bin1, bin2, obs, exp) over the full lattice, and a row with the number of anchor pairs, grid_size."""
    anchors = midpoints(feature_pairs(first, second, min_dist, max_dist))
    if scores is not None and score_filter is not None:
        anchors = score_filtered(anchors, scores, reach, score_filter)
    grid = lattice(obs.sparkSession, reach, resolution)
    for name, track in (("obs", obs), ("exp", exp)):
        n = grid_counts(track, anchors, reach, resolution, min_dist, max_dist, mode).withColumnRenamed("n", name)
        grid = grid.join(n, ["bin1", "bin2"], "left").fillna(0, [name])
    return grid, anchors.agg(F.count("*").alias("grid_size"))


def sum_grids(grids: list[DataFrame]) -> DataFrame:
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out.groupBy("bin1", "bin2").agg(F.sum("obs").alias("obs"), F.sum("exp").alias("exp"))


def rebinned(grid: DataFrame, reach: int, old: int, new: int) -> DataFrame:
    """Cells summed around the centre: with an edge at 0 the ratio must be even and the central bin spans it; else odd."""
    multi, half = new // old, reach // old
    if new % old:
        raise ValueError(f"{new} is not a multiple of {old}")
    centred = (2 * reach // old) % 2 == 0
    if centred and multi % 2:
        raise ValueError(f"the ratio {multi} is odd, and an edge lies at 0")
    if not centred and multi % 2 == 0:
        raise ValueError(f"the ratio {multi} is even, and a bin spans 0")

    def to(c: str) -> Column:
        if centred:
            p = F.when(F.col(c) > half, F.col(c) - half).otherwise(half + 1 - F.col(c))
            n = F.when(p <= multi // 2, 0).otherwise(1 + F.floor((p - 1 - multi // 2) / multi))
            return F.when(F.col(c) > half, n).otherwise(-n).cast("int")
        middle = half + 1
        p = F.abs(F.col(c) - middle)
        n = F.floor((p + (multi - 1) // 2) / multi)
        return (F.signum(F.col(c) - middle) * n).cast("int")

    sums = [F.sum(c).alias(c) for c in grid.columns if c not in ("bin1", "bin2")]
    return grid.groupBy(to("bin1").alias("bin1"), to("bin2").alias("bin2")).agg(*sums)


def grid_values(grid: DataFrame, kind: str = "enrichment") -> DataFrame:
    """bin1, bin2, value: log2 of the ratio of shares, or log10 of a share; null where a count is 0."""
    total = grid.agg(F.sum("obs").alias("_o"), F.sum("exp").alias("_e"))
    g = grid.join(F.broadcast(total))  # one row
    share = {"obs": F.col("obs") / F.col("_o"), "exp": F.col("exp") / F.col("_e")}
    if kind == "enrichment":
        value = F.when((F.col("obs") > 0) & (F.col("exp") > 0), F.log2(share["obs"] / share["exp"]))
    elif kind in ("observed", "expected"):
        c = kind[:3]
        value = F.when(F.col(c) > 0, F.log10(share[c]))
    else:
        raise ValueError(f"no such kind of grid: {kind}")
    return g.select("bin1", "bin2", value.alias("value"))


def as_matrix(grid: DataFrame, value: str, bins: list[int]) -> DataFrame:
    """A row for each bin1 and a column for each of ``bins``."""
    return grid.groupBy("bin1").pivot("bin2", bins).agg(F.first(value)).orderBy("bin1")
