"""Whole-track jobs and the local mode: shuffle, score, and both for one region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.contacts import pool
from ..operators.decay import adjusted_expand, auto_resolution, auto_smooth
from ..operators.intervals import pending
from ..operators.score import kk_norm, score_track
from ..operators.shuffle import contact_rows, shuffle_contacts, shuffle_track
from ..sources.catalog import TrackCatalog
from ..sources.views import extent


def shuffle_to_track(catalog: TrackCatalog, obs: str, exp: str | None = None, config: EngineConfig | None = None, **how) -> str:
    """Builds the expected track ``exp`` (default ``<obs>_shuffle``) of a stored one; all chromosomes in one job."""
    exp = exp or f"{obs}_shuffle"
    if not catalog.exists(obs):
        raise KeyError(f"no track {obs}")
    if catalog.exists(exp):
        raise FileExistsError(f"track {exp} exists")
    catalog.write(exp, shuffle_track(catalog.read(obs), config=config, **how))
    return exp


def score_to_track(catalog: TrackCatalog, score: str, obs: list[str], exp: list[str] | None = None, points: list[str] | None = None, chroms: DataFrame | None = None, config: EngineConfig | None = None, **how) -> DataFrame:
    """Scores stored tracks into the track ``score``; returns the status of each tile."""
    c = config or EngineConfig()
    exp = exp or [f"{o}_shuffle" for o in obs]
    for name in [*obs, *exp, *(points or [])]:
        if not catalog.exists(name):
            raise KeyError(f"no track {name}")
    if catalog.exists(score):
        raise FileExistsError(f"track {score} exists")
    read = lambda names: [catalog.read(n) for n in names]
    if chroms is None:
        both = [t.select("chrom1", "start1", "start2") for t in read([*obs, *exp])]
        chroms = extent(pool(both))
    scores, status = score_track(read(obs), read(exp), chroms, read(points) if points else None, c.near_cis, c.expand, c.k, c.min_dist, c.min_points, **how)
    catalog.write(score, scores)
    return status


def missing_tiles(status: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles that no status lists: what is left to do after a stop."""
    keys = ["chrom", "start1", "start2"]
    return pending(tiles, status.select(*keys), keys)


def local_parameters(span: int, far: int, n_points: int, config: EngineConfig) -> dict:
    """Resolution from the focus points, smoothing and the expansion that fills the last distance bin."""
    resolution = auto_resolution(n_points, config.min_dist, far, config.max_resolution)
    return {"resolution": resolution, "smooth": auto_smooth(resolution), "expand": adjusted_expand(span, config.local_expand, resolution)}


def shuffle_and_score(obs: list[DataFrame], interval: dict, chrom_size: int, config: EngineConfig | None = None, seed: int = 1, sweeps: float | None = None, distinct: bool = False) -> DataFrame | None:
    """Local mode: shuffles a region around the interval and scores the interval's upper points against it.

    None if the region holds under ``min_points`` contacts. Pooled points are scored as they are, or once each with ``distinct``.
    """
    c = config or EngineConfig()
    if interval.get("chrom2", interval["chrom1"]) != interval["chrom1"]:
        raise ValueError("local mode takes one chromosome")
    points = pool(obs, interval, c.min_dist).where("start1 < start2")
    n, far = points.agg(F.count("*"), F.coalesce(F.max(F.col("start2") - F.col("start1")), F.lit(0))).first()
    if not n:
        return None
    p = local_parameters(interval["end2"] - interval["start1"], far, n, c)
    lo = max(0, int(min(interval["start1"], interval["start2"]) - p["expand"]))
    hi = min(chrom_size, int(max(interval["end1"], interval["end2"]) + p["expand"]))
    region = {"chrom1": interval["chrom1"], "start1": lo, "end1": hi, "start2": lo, "end2": hi}
    around = pool(obs, region, c.min_dist)
    rows = contact_rows(around, symmetric=True)
    if rows.limit(c.min_points).count() < c.min_points:
        return None
    if p["resolution"] == 0:
        shuffled = rows.select("chrom", "x", "y")
    else:
        shuffled = shuffle_contacts(rows, p["resolution"], p["smooth"], c.min_dist, seed, c.shuffle if sweeps is None else sweeps, (c.grid_small, c.grid_high, c.grid_increase), c.grid_step_iter, c.correction_factor).contacts
    frame = lambda d, x, y: d.select(F.col("chrom").alias("chrom1"), F.col(x).alias("start1"), F.col(y).alias("start2"))
    exp = frame(shuffled, "x", "y").unionByName(frame(shuffled, "y", "x"))
    scores = kk_norm(frame(rows, "x", "y"), exp, points, c.k, 2 * c.k)
    if distinct:
        return scores
    return points.select(F.col("chrom1").alias("chrom"), "start1", "start2").join(scores, ["chrom", "start1", "start2"])
