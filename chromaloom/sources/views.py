"""Contacts, chromosomes and features as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, src: str | None = None) -> DataFrame:
    """chrom, start1, start2, src, contacts: rows that may repeat a contact."""
    line = table(spark, sf_dir, "lineitem")
    if src:
        line = line.where(F.col("l_linestatus") == "O" if src == "obs" else F.col("l_linestatus") != "O")
    return line.select(
        F.concat(F.lit("chr"), (1 + F.col("l_linenumber") % 3).cast("string")).alias("chrom"),
        (F.col("l_partkey") * 500 + F.col("l_suppkey")).alias("start1"),
        (F.col("l_orderkey") * 67 + F.col("l_linenumber")).alias("start2"),
        F.when(F.col("l_linestatus") == "O", "obs").otherwise("exp").alias("src"),
        (1 + F.col("l_quantity").cast("long") % 3).alias("contacts"),
    )


def contacts(spark: SparkSession, sf_dir: str, src: str | None = None) -> DataFrame:
    """Unique contacts (chrom1, start1, end1, chrom2, start2, end2, contacts[, src]) of one source, or of both with ``src``."""
    rows = reads(spark, sf_dir, src)
    keys = ["chrom", "start1", "start2"] + ([] if src else ["src"])
    unique = rows.groupBy(*keys).agg(F.sum("contacts").alias("contacts"))
    six = [F.col("chrom").alias("chrom1"), "start1", (F.col("start1") + 1).alias("end1"), F.col("chrom").alias("chrom2"), "start2", (F.col("start2") + 1).alias("end2"), "contacts"]
    return unique.select(*six, *([] if src else ["src"]))


def chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end: each chromosome from 0 to its greatest coordinate + 1."""
    return extent(reads(spark, sf_dir).withColumnRenamed("chrom", "chrom1"))


def extent(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("chrom1").alias("chrom")).agg((F.max(F.greatest("start1", "start2")) + 1).alias("end")).select("chrom", F.lit(0).cast("long").alias("start"), "end")


def features(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """chrom, start, end of two sets of anchors: parts, orders."""
    name, key, step = (("part", "p_partkey", 500), ("orders", "o_orderkey", 67))[which - 1]
    rows = table(spark, sf_dir, name)
    start = F.col(key) * step
    return rows.select(F.concat(F.lit("chr"), (1 + F.col(key) % 3).cast("string")).alias("chrom"), start.alias("start"), (start + 50).alias("end"))
