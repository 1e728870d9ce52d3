"""Signed two-sample Kolmogorov-Smirnov score of neighbour distances.

Of k ascending distances the first and the last are left out. Walking through both lists
in order of distance, expected first among equals, an observed distance adds 1/(k - 1) and an
expected one takes 1/(k_exp - 1), until either list is used up. The greatest and the least
value on the way, cut to three decimals, give the score: 100 times the one of larger
size, the negative one if they are equal. Positive means that observed neighbours are nearer.
All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ks_extremes(obs: np.ndarray, exp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest (>= 0) and least (<= 0) value in thousandths, for rows of ascending distances."""
    k, ke = obs.shape[1], exp.shape[1]
    if k < 4 or ke < 4:
        raise ValueError("k and k_exp must be 4 at least")
    n1, n2 = k - 1, ke - 1
    whole = n1 * n2
    most, least = np.zeros(len(obs), np.int64), np.zeros(len(obs), np.int64)
    rank = np.arange(1, n1 + n2 - 1, dtype=np.int64)
    for s in range(0, len(obs), 1024):
        # Both lists in one order, expected first among equals: the lowest bit says which it is.
        walk = np.sort(np.concatenate([obs[s : s + 1024, 1:n1].astype(np.int64) * 2 + 1, exp[s : s + 1024, 1:n2].astype(np.int64) * 2], axis=1), axis=1)
        o = walk & 1
        a = np.cumsum(o, axis=1)
        b = rank - a
        n = np.where((a - o < n1 - 1) & (b - (1 - o) < n2 - 1), a * n2 - b * n1, 0)
        most[s : s + 1024], least[s : s + 1024] = n.max(1, initial=0), n.min(1, initial=0)
    return 1000 * most // whole, -(1000 * -least // whole)


def ks_score(obs: np.ndarray, exp: np.ndarray) -> np.ndarray:
    most, least = ks_extremes(obs, exp)
    return np.where(-least < most, most, least) / 10.0


def ks_components(ranked: DataFrame, k: int, k_exp: int) -> DataFrame:
    """point_id, max_d, min_d in thousandths from long rows (point_id, src, rn, dist), by a running window per point."""
    kept = ranked.where(((F.col("src") == "obs") & F.col("rn").between(2, k - 1)) | ((F.col("src") == "exp") & F.col("rn").between(2, k_exp - 1)))
    ev = kept.select("point_id", "dist", "rn", (F.col("src") == "obs").cast("int").alias("o"))
    w = Window.partitionBy("point_id").orderBy("dist", "o", "rn").rowsBetween(Window.unboundedPreceding, 0)
    cu = ev.select("point_id", "o", F.sum("o").over(w).alias("a"), F.sum(1 - F.col("o")).over(w).alias("b"))
    live = (F.col("a") - F.col("o") < k - 2) & (F.col("b") - (1 - F.col("o")) < k_exp - 2)
    n = F.when(live, F.col("a") * (k_exp - 1) - F.col("b") * (k - 1)).otherwise(0)
    whole = (k - 1) * (k_exp - 1)
    out = cu.withColumn("n", n).groupBy("point_id").agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    return out.select("point_id", F.expr(f"(1000 * greatest(0, hi)) div {whole}").alias("max_d"), F.expr(f"(1000 * least(0, lo)) div {whole}").alias("min_d"))


def score_of(components: DataFrame) -> DataFrame:
    s = F.when(-F.col("min_d") < F.col("max_d"), F.col("max_d")).otherwise(F.col("min_d"))
    return components.select("point_id", (s / 10.0).alias("score"))
