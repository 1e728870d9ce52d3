"""Schemas of the engine's tables: chromosomes, intervals, 2-D contacts, scores, 1-D signal."""

from pyspark.sql import types as T

CHROMS = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
INTERVALS = T.StructType([*CHROMS.fields, T.StructField("strand", T.IntegerType())])
_SIX = [T.StructField(n, T.StringType() if n.startswith("chrom") else T.LongType()) for n in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")]
CONTACTS = T.StructType([*_SIX, T.StructField("contacts", T.LongType())])
SCORES = T.StructType([*_SIX, T.StructField("score", T.DoubleType())])
SIGNAL = T.StructType([*CHROMS.fields, T.StructField("data", T.DoubleType())])
COORDS = ("chrom1", "start1", "end1", "chrom2", "start2", "end2")


def require(df, *columns: str) -> None:
    """Raises ValueError unless ``df`` has all ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
