"""Contacts that arrive as a stream: pooled counts per coordinate, and the work that new contacts make necessary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTACTS


def contact_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CONTACTS).csv(path, sep="\t", header=True)


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts of each coordinate pair over all that has arrived; for output modes update or complete."""
    return stream.groupBy("chrom1", "start1", "chrom2", "start2").agg(F.sum("contacts").alias("contacts"))


def touched_tiles(batch: DataFrame, width: int) -> DataFrame:
    """The tiles whose scores new contacts make stale."""
    return batch.select(F.col("chrom1").alias("chrom"), (F.floor(F.col("start1") / width) * width).alias("start1"), (F.floor(F.col("start2") / width) * width).alias("start2")).distinct()


def on_new_tiles(stream: DataFrame, width: int, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """Calls ``work`` with the touched tiles of each micro-batch, each batch once per committed epoch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: work(touched_tiles(df, width), epoch)).trigger(availableNow=True).start()
