"""Tracks, signals and interval sets as Parquet directories; 2-D tracks by chromosome, with the distance from the diagonal for pushdown."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTACTS, COORDS, INTERVALS, SCORES, SIGNAL, require

KINDS = ("track", "signal", "intervals")
DIST = "dist"


def read_contacts_tsv(spark: SparkSession, path: str, value: str = "contacts") -> DataFrame:
    schema = CONTACTS if value == "contacts" else SCORES
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_shuffled_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw shuffled pairs: start1, start2 under a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="start1 long, start2 long")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_intervals_tsv(spark: SparkSession, path: str, data: bool = False) -> DataFrame:
    """chrom, start, end with a strand, or with a value under ``data``; under a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=SIGNAL if data else INTERVALS)


def repeated_coordinates(df: DataFrame) -> DataFrame:
    return df.groupBy(*COORDS).count().where("count > 1")


class TrackCatalog:
    """Named tables under a root path that Spark can read: 2-D contacts or scores, 1-D signal, interval sets.

    A name's parts, split at dots, are folders. A 2-D track has the six coordinates; it is partitioned by chromosome, and holds the
    distance from the diagonal, start1 - start2, as a column that filters on bands and distances are pushed to. Other tables have chrom, start, end.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, kind: str = "track"):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name.replace('.', '/')}.{kind}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _kind(self, name: str) -> str | None:
        return next((k for k in KINDS if (found := self._path(name, k))[0].exists(found[1])), None)

    def exists(self, name: str) -> bool:
        """Whether there is a track, a signal or a set of intervals of that name."""
        return self._kind(name) is not None

    def ls(self, pattern: str = "") -> list[str]:
        """The names that hold ``pattern``, at any depth."""
        fs, _ = self._path("x")
        root = fs.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(self.root))
        names, todo = [], [root] if fs.exists(root) else []
        while todo:
            for s in fs.listStatus(todo.pop()):
                own = s.getPath().toString().removeprefix(root.toString() + "/")
                stem, dot, kind = own.rpartition(".")
                if dot and kind in KINDS:
                    names.append(stem.replace("/", "."))
                elif s.isDirectory() and not s.getPath().getName().startswith(("_", ".")):
                    todo.append(s.getPath())
        return sorted(n for n in names if pattern in n)

    def rm(self, name: str) -> bool:
        kind = self._kind(name)
        if kind is None:
            return False
        fs, path = self._path(name, kind)
        return fs.delete(path, True)

    def write(self, name: str, df: DataFrame, allow_duplicates: bool = False) -> None:
        """Stores a table, a 2-D track if it has the six coordinates, clustered by chromosome and position.

        The rows are made once: they are written aside, checked there and then published. Repeated coordinates of a track raise unless allowed.
        """
        flat = not set(COORDS) <= set(df.columns)
        if flat:
            require(df, "chrom", "start", "end")
            kind, keys = "signal" if "data" in df.columns else "intervals", ["chrom", "start"]
        else:
            require(df, *COORDS)
            kind, keys = "track", ["chrom1", "start1"]
            df = df.withColumn(DIST, F.col("start1") - F.col("start2"))
        fs, aside = self._path(f"_{name}-{uuid.uuid4().hex}", kind)
        rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write
        (rows if flat else rows.partitionBy("chrom1")).parquet(str(aside))
        if kind == "track" and not allow_duplicates:
            made = self.spark.read.schema(df.schema).parquet(str(aside))
            if not repeated_coordinates(made).isEmpty():
                fs.delete(aside, True)
                raise ValueError(f"{name}: coordinates are not unique")
        _, path = self._path(name, kind)
        self.rm(name)
        fs.mkdirs(path.getParent())
        if not fs.rename(aside, path):
            raise OSError(f"{aside} could not be renamed to {path}")

    def import_contacts(self, name: str, *paths: str, allow_duplicates: bool = False) -> None:
        self.write(name, reduce(DataFrame.unionByName, [read_contacts_tsv(self.spark, p) for p in paths]), allow_duplicates)

    def import_scores(self, name: str, *paths: str) -> None:
        self.write(name, reduce(DataFrame.unionByName, [read_contacts_tsv(self.spark, p, "score") for p in paths]))

    def _stored(self, name: str) -> tuple[str, DataFrame]:
        kind = self._kind(name)
        if kind is None:
            raise KeyError(f"no track {name} in {self.root}")
        return kind, self.spark.read.parquet(str(self._path(name, kind)[1]))

    def read(self, name: str) -> DataFrame:
        kind, df = self._stored(name)
        return df.select("chrom1", *[c for c in df.columns if c not in ("chrom1", DIST)]) if kind == "track" else df

    def extract(self, name: str, rect: dict | None = None, band: tuple[int, int] | None = None) -> DataFrame:
        """Rows whose point lies in the rectangle (chrom1, start1, end1, chrom2, start2, end2) and whose start1 - start2 lies in the band."""
        from ..operators.contacts import in_rectangle

        kind, df = self._stored(name)
        if kind != "track":
            raise ValueError(f"{name} is not a 2-D track")
        if rect:
            df = df.where(in_rectangle(rect))
        if band:
            df = df.where((F.col(DIST) >= band[0]) & (F.col(DIST) < band[1]))
        return df.select("chrom1", *[c for c in df.columns if c not in ("chrom1", DIST)])

    def overlapping(self, name: str, chrom: str, start: int, end: int) -> DataFrame:
        """The rows of a signal or a set of intervals that overlap a region, as they are."""
        kind, df = self._stored(name)
        if kind == "track":
            raise ValueError(f"{name} is a 2-D track")
        return df.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
