"""Distance decay: histogram by log-distance bin, smoothing, log-space regularisation, proposal correction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genomic import distance_bin

#: The value that stands for log zero in the decay vectors.
LOG_ZERO = -125.0


def decay_histogram(df: DataFrame, resolution: int, min_dist: int, count: str | None = None) -> DataFrame:
    """dbin, n: contacts (or the sum of their counts) per log-distance bin."""
    n = F.sum(count) if count else F.count("*")
    return df.groupBy(distance_bin(resolution, min_dist).alias("dbin")).agg(n.cast("long").alias("n"))


def smoothed_interior(hist: DataFrame, smooth: int, last_bin: int | None = None) -> DataFrame:
    """dbin, mean: centred means over 2 * smooth + 1 bins, absent bins counted as 0, of the bins with a full window."""
    top = hist.agg(F.max("dbin").alias("top")) if last_bin is None else None
    span = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("dbin")) if top is not None else hist.sparkSession.range(last_bin + 1).withColumnRenamed("id", "dbin")
    full = span.join(hist, "dbin", "left").select("dbin", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("dbin").rowsBetween(-smooth, smooth)  # a histogram has some thousand bins whatever the input
    out = full.select("dbin", F.sum("n").over(w).alias("total"), F.count("*").over(w).alias("width"))
    return out.where(F.col("width") == 2 * smooth + 1).select("dbin", (F.col("total") / (2 * smooth + 1)).alias("mean"))


def smooth_vector(raw: np.ndarray, smooth: int) -> np.ndarray:
    """Centred means inside; the outer ``smooth`` bins follow the regression line of the outermost 2 * smooth + 1 bins, cut at 0
    and 0 while only empty bins have been met; the next ``smooth`` bins fade from the line to the mean."""
    raw = np.asarray(raw, np.float64)
    if smooth <= 0:
        return raw.copy()
    width = 2 * smooth + 1
    if len(raw) < 2 * width:
        smooth = max(0, (len(raw) // 2 - 1) // 2)
        return smooth_vector(raw, smooth)
    out = np.empty_like(raw)
    out[smooth:-smooth] = np.convolve(raw, np.ones(width) / width, "valid")
    for side in (1, -1):
        r, o = raw[::side], out[::side]
        slope, base = np.polyfit(np.arange(width), r[:width], 1)
        line = base + slope * np.arange(2 * smooth)
        met = np.cumsum(r[:smooth]) > 0
        o[:smooth] = np.where(met, np.maximum(line[:smooth], 0), 0)
        fade = np.arange(smooth) / smooth
        o[smooth : 2 * smooth] = (1 - fade) * line[smooth:] + fade * o[smooth : 2 * smooth]
    return out


def log_vector(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, np.log(np.where(v > 0, v, 1)), LOG_ZERO)


def regularized(log_decay: np.ndarray, n: int, least: float = 5.0) -> np.ndarray:
    """log(decay + 5 / n); bins that stay under ``least`` become log zero."""
    out = np.logaddexp(log_decay, math.log(5) - math.log(max(n, 1)))
    return np.where(np.exp(out) < least, LOG_ZERO, out)


def expected_decay(observed: np.ndarray, smooth: int) -> np.ndarray:
    return regularized(log_vector(smooth_vector(observed, smooth)), int(observed.sum()))


def corrected_proposal(proposal: np.ndarray, observed: np.ndarray, expected: np.ndarray, factor: float = 0.25) -> np.ndarray:
    """Raises the proposal of bins that hold more contacts than expected; normalised in log space."""
    live = (np.exp(expected) > np.exp(LOG_ZERO) * 2) & (observed > 0)
    out = np.where(live, proposal + np.log(np.maximum(observed, 1)) - expected + math.log(factor), LOG_ZERO)
    return out - np.logaddexp.reduce(out) if live.any() else out


def constant_proposal(size: int) -> np.ndarray:
    return np.full(size, -math.log(size)) if size else np.zeros(0)


def area_proposal(size: int, resolution: int, min_bin: int, max_dist: float) -> np.ndarray:
    """Shares of the plane in each log-distance strip of a square of side ``max_dist``."""
    edge = np.minimum(2 ** ((np.arange(size + 1) + min_bin) / resolution) - 1, max_dist)
    area = (max_dist - edge[:-1]) ** 2 - (max_dist - edge[1:]) ** 2
    return log_vector(area / area.sum()) if area.sum() > 0 else constant_proposal(size)


def sampled_proposal(counts: np.ndarray, smooth: int) -> np.ndarray:
    """Log shares of the smoothed counts of proposals."""
    v = smooth_vector(counts, smooth)
    return log_vector(v / v.sum()) if v.sum() > 0 else constant_proposal(len(counts))


def auto_resolution(n: int, min_dist: int, max_dist: int, most: int = 400) -> int:
    return max(0, min(math.floor((n / 200) / (math.log2(max_dist) - math.log2(min_dist))), most)) if max_dist > min_dist else 0


def auto_smooth(resolution: int) -> int:
    return min(resolution // 10, 20)


def adjusted_expand(span: int, expand: int, resolution: int) -> float:
    """The expansion that completes the last log-distance bin of a region of ``span``."""
    if resolution <= 0:
        return float(expand)
    return (2 ** (math.ceil(math.log2(span + 2 * expand) * resolution) / resolution) - span) / 2


def k_exp_ratio(k: int, n_obs: Column, n_exp: Column) -> Column:
    return F.round(F.lit(k) * n_exp / n_obs).cast("long")
