"""Operators on contact tracks: pooling, filtering, replication, mirroring, counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genomic import beyond, in_band


def in_rectangle(rect: dict) -> Column:
    """Points of a rectangle with half-open sides; chrom2 defaults to chrom1."""
    c1, c2 = rect["chrom1"], rect.get("chrom2", rect["chrom1"])
    sides = (F.col("start1") >= rect["start1"]) & (F.col("start1") < rect["end1"]) & (F.col("start2") >= rect["start2"]) & (F.col("start2") < rect["end2"])
    return (F.col("chrom1") == c1) & (F.col("chrom2") == c2) & sides


def pool(tracks: list[DataFrame], rect: dict | None = None, min_dist: int | None = None) -> DataFrame:
    """UNION ALL of the tracks' contacts in a rectangle that lie farther than ``min_dist`` (strictly) from the diagonal."""
    out = reduce(DataFrame.unionByName, tracks)
    if rect is not None:
        out = out.where(in_rectangle(rect))
    return out.where(beyond(min_dist)) if min_dist is not None else out


def replicate(df: DataFrame, count: str = "contacts") -> DataFrame:
    """Each row as often as its count says; rows with a count under 1 vanish."""
    return df.where(F.col(count) >= 1).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long")))).drop("_copy")


def mirror(df: DataFrame) -> DataFrame:
    """The contacts and the same with their sides exchanged."""
    swap = {"chrom1": "chrom2", "start1": "start2", "end1": "end2"}
    swap |= {v: k for k, v in swap.items()}
    return df.unionByName(df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns]))


def distinct_points(df: DataFrame) -> DataFrame:
    return df.select("chrom1", "start1", "end1", "chrom2", "start2", "end2").distinct()


def count_pairs(df: DataFrame) -> DataFrame:
    """Unique contacts with their number of rows."""
    return df.groupBy("chrom1", "start1", "chrom2", "start2").agg(F.count("*").alias("contacts")).select(
        "chrom1", "start1", (F.col("start1") + 1).alias("end1"), "chrom2", "start2", (F.col("start2") + 1).alias("end2"), "contacts"
    )


def weighted_sum(tracks: list[DataFrame], low: int, high: int, count: str = "contacts") -> DataFrame:
    """Per chromosome the sum of counts over all tracks inside the band."""
    return pool(tracks).where(in_band(low, high)).groupBy(F.col("chrom1").alias("chrom")).agg(F.sum(count).alias("total"))
