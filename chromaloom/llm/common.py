"""What the operators of this subpackage share: reading tables, checkpoints, shipping code."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; one of our own only where it is unset and everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as Parquet in the shared folder, read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended; it does so only when the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for whose texts ``keep`` says so; no shuffle, and no need of a key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, max_bytes=2 << 20):
            mask = keep(part.column(part.schema.get_field_index(text_col)).to_pylist())
            yield part.filter(pa.array(np.asarray(mask, bool)))

    return docs.mapInArrow(run, docs.schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Python gets so many rows at a time in the jobs that run inside: rows sorted by likeness bring long texts one after the other."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def grouped(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys side by side in one partition, for ``whole_groups``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal keys (integers, not null) from sorted batches, and the groups' edges; only a group cut by a batch waits."""
    held: pa.Table | None = None

    def edges(t: pa.Table) -> np.ndarray:
        differ = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            differ |= v[1:] != v[:-1]
        return np.concatenate(([0], np.flatnonzero(differ) + 1, [t.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        at = edges(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
        held = t.slice(at[-2])
    if held is not None:
        yield held, edges(held)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def matched(docs: DataFrame, ids: DataFrame, keys: list[str], how: str, most: int = 32 << 20, stored: bool = False) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the keys. Up to ``most`` bytes of keys are broadcast, so that no text is shuffled; more are joined.

    ``stored`` ids are cheap to read twice; they are not written again if they fit with their repeats.
    """
    size = sum((F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) + 16 for k in keys), F.lit(0)).cast("long")
    fits = lambda x: (x.agg(F.sum(size)).first()[0] or 0) <= most
    ids = ids.select(keys)
    if stored and fits(ids):
        return docs.join(F.broadcast(ids), keys, how)
    ids = written(ids.distinct())
    return docs.join(F.broadcast(ids) if fits(ids) else ids, keys, how)
