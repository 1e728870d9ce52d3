"""Scoring of contacts against their neighbours: given frames, a focus region, whole tracks by tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require
from .contacts import distinct_points, pool
from .intervals import tiles_without
from .knn import tiled
from .ks import ks_score

_ID = ("chrom", "start1", "start2")


def _points(df: DataFrame, chrom: str = "chrom1") -> DataFrame:
    require(df, "start1", "start2")
    key = F.col(chrom) if chrom in df.columns else F.lit("")
    once = df.select(key.alias("chrom"), F.col("start1").cast("long").alias("start1"), F.col("start2").cast("long").alias("start2")).distinct()
    return once.select(F.struct("chrom", "start1", "start2").alias("point_id"), "chrom", F.col("start1").alias("x"), F.col("start2").alias("y"))


def _refs(df: DataFrame, count: str | None) -> DataFrame:
    key = F.col("chrom1") if "chrom1" in df.columns else F.lit("")
    return df.select(key.alias("chrom"), F.col("start1").alias("x"), F.col("start2").alias("y"), (F.col(count) if count else F.lit(1)).cast("long").alias("n")).where("n >= 1")


def _finish(d: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"score": pa.array(ks_score(d[0], d[1]) if len(d[0]) else np.zeros(0))}


def kk_norm(obs: DataFrame, exp: DataFrame, points: DataFrame, k: int = 100, k_exp: int = 100, **how) -> DataFrame:
    """(chrom, start1, start2, score) of the points against the frames as given: no counts, no distance filter.

    Points without enough neighbours have no row. k and k_exp are 4 at least.
    """
    if min(k, k_exp) < 4:
        raise ValueError("k and k_exp must be 4 at least")
    out = tiled(_points(points), {"obs": _refs(obs, None), "exp": _refs(exp, None)}, {"obs": k, "exp": k_exp}, _finish, "score double", **how)
    return out.select("point_id.*", "score")


def score_points(obs: list[DataFrame], exp: list[DataFrame], points: DataFrame, region: dict, min_dist: int = 1024, k: int = 100, k_exp: int | None = 0, **how) -> DataFrame:
    """Scores of the points against pooled contacts of the region, counted as often as their multiplicity.

    ``k_exp``: 0 for twice k; None for k scaled by the ratio of expected to observed contacts. Fewer than k observed
    or expected contacts give no rows.
    """
    o, e = pool(obs, region, min_dist), pool(exp, region, min_dist)
    n_obs, n_exp = (df.agg(F.coalesce(F.sum("contacts"), F.lit(0))).first()[0] for df in (o, e))
    if k_exp is None:
        k_exp = round(k * n_exp / n_obs) if n_obs else k
    k_exp = k_exp or 2 * k
    if min(n_obs, n_exp) < k:
        o = o.limit(0)
    out = tiled(_points(points), {"obs": _refs(o, "contacts"), "exp": _refs(e, "contacts")}, {"obs": k, "exp": k_exp}, _finish, "score double", **how)
    return out.select("point_id.*", "score")


def score_region(obs: list[DataFrame], exp: list[DataFrame], focus: dict, region: dict, points: list[DataFrame] | None = None, min_dist: int = 1024, k: int = 100, k_exp: int | None = 0, min_points: int = 1000, **how) -> DataFrame:
    """Scores of the distinct contacts in ``focus``; fewer than ``min_points`` pooled rows there give no rows."""
    pooled = pool(points or obs, focus, min_dist)
    if pooled.limit(min_points).count() < min_points:
        pooled = pooled.limit(0)
    return score_points(obs, exp, distinct_points(pooled), region, min_dist, k, k_exp, **how)


def score_track(obs: list[DataFrame], exp: list[DataFrame], chroms: DataFrame, points: list[DataFrame] | None = None, near_cis: int = 5_000_000, expand: int = 2_000_000, k: int = 100, min_dist: int = 1024, min_points: int = 1000, **how) -> tuple[DataFrame, DataFrame]:
    """Scores of all upper-triangle contacts, each against the contacts of its tile's region, and a status per tile.

    A tile with fewer than ``min_points`` contacts, or a region with fewer than k observed or expected ones, has status 0.
    """
    pts = pool(points or obs, None, min_dist)
    # A contact's tile is its pair of tile starts; that the grid has it follows from the chromosome's size, a row a chromosome.
    size = F.broadcast(chroms.select(F.col("chrom").alias("chrom1"), F.col("end").alias("size")))
    at = lambda c: (F.floor(F.col(c) / near_cis) * near_cis).alias(c)
    mine = pts.withColumns({"t1": at("start1"), "t2": at("start2")})
    mine = mine.where("start1 <= end1 and t1 >= 0 and t1 <= t2").join(size, "chrom1").where("t2 < size").withColumn("tile", F.concat_ws(":", "chrom1", "t1", "t2"))
    counts = mine.groupBy("chrom1", "t1", "t2").agg(F.count("*").alias("n_points"))
    ready = counts.where(F.col("n_points") >= min_points).select("chrom1", "t1", "t2")
    upper = mine.where("start1 <= start2").join(ready, ["chrom1", "t1", "t2"], "left_semi").select(F.col("tile").alias("chrom1"), "start1", "start2").distinct()

    def seen(tracks: list[DataFrame]) -> DataFrame:
        ref = pool(tracks, None, min_dist)
        near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - expand) / near_cis), F.floor((F.col(c) + expand) / near_cis)))
        dealt = ref.withColumn("t1", near("start1")).withColumn("t2", near("start2")).withColumns({c: F.col(c) * near_cis for c in ("t1", "t2")})
        return dealt.join(ready, ["chrom1", "t1", "t2"], "left_semi").select(F.concat_ws(":", "chrom1", "t1", "t2").alias("chrom1"), "start1", "start2", "contacts")

    out = tiled(_points(upper), {"obs": _refs(seen(obs), "contacts"), "exp": _refs(seen(exp), "contacts")}, {"obs": k, "exp": 2 * k}, _finish, "score double", **how)
    scores = out.select(F.substring_index("point_id.chrom", ":", 1).alias("chrom1"), "point_id.start1", (F.col("point_id.start1") + 1).alias("end1"), F.substring_index("point_id.chrom", ":", 1).alias("chrom2"), "point_id.start2", (F.col("point_id.start2") + 1).alias("end2"), "score", F.col("point_id.chrom").alias("tile"))
    made = scores.groupBy("tile").agg(F.count("*").alias("n_scores"))
    # Tiles with contacts, and the rest of the grid.
    end = lambda c: F.least(F.col(c) + near_cis, F.col("size"))
    some = counts.join(size, "chrom1").withColumn("tile", F.concat_ws(":", "chrom1", "t1", "t2")).join(made, "tile", "left")
    some = some.select("tile", F.col("chrom1").alias("chrom"), F.col("t1").alias("start1"), end("t1").alias("end1"), F.col("t2").alias("start2"), end("t2").alias("end2"), "n_points", F.coalesce("n_scores", F.lit(0).cast("long")).alias("n_scores"))
    rest = tiles_without(chroms, near_cis, counts.select(F.col("chrom1").alias("chrom"), F.col("t1").alias("start1"), F.col("t2").alias("start2")))
    zero = F.lit(0).cast("long")
    rest = rest.select(F.concat_ws(":", "chrom", "start1", "start2").alias("tile"), "chrom", "start1", "end1", "start2", "end2", zero.alias("n_points"), zero.alias("n_scores"))
    status = some.unionByName(rest).withColumn("status", (F.col("n_scores") > 0).cast("int"))
    return scores.drop("tile"), status
