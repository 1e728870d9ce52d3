"""Virtual tracks: a named aggregate of a 2-D track over a window around each interval, and screening by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {"max": F.max, "min": F.min, "sum": F.sum, "weighted.sum": F.sum, "avg": F.avg, "count": lambda c: F.count("*")}


@dataclass(frozen=True)
class VirtualTrack:
    """``func`` of column ``value`` of ``track`` over [start + shift start, end + shift end) on each axis."""

    name: str
    track: DataFrame
    func: str = "max"
    value: str = "score"
    shift1: tuple[int, int] = (0, 0)
    shift2: tuple[int, int] = (0, 0)

    def shifted(self, shift1: tuple[int, int], shift2: tuple[int, int]) -> VirtualTrack:
        return VirtualTrack(self.name, self.track, self.func, self.value, shift1, shift2)

    def over(self, rects: DataFrame, bucket: int | None = None) -> DataFrame:
        """``rects`` (chrom1, start1, end1, chrom2, start2, end2) and a column of the track's name; null where no point lies.

        Rectangles go to the buckets they touch, points to one, so the join is on equal keys.
        """
        if self.func not in _AGGREGATES:
            raise ValueError(f"no such function: {self.func}")
        six = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]
        r = rects.select(*six).distinct().withColumns({"lo1": F.col("start1") + self.shift1[0], "hi1": F.col("end1") + self.shift1[1], "lo2": F.col("start2") + self.shift2[0], "hi2": F.col("end2") + self.shift2[1]})
        if bucket is None:
            bucket = max(1, r.agg(F.max(F.greatest(F.col("hi1") - F.col("lo1"), F.col("hi2") - F.col("lo2")))).first()[0] or 1)
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket)))
        r = r.where("lo1 < hi1 and lo2 < hi2").withColumn("bx", span("lo1", "hi1")).withColumn("by", span("lo2", "hi2"))
        p = self.track.select(F.col("chrom1").alias("c1"), F.col("chrom2").alias("c2"), F.col("start1").alias("x"), F.col("start2").alias("y"), F.col(self.value).alias("v"))
        p = p.withColumns({"px": F.floor(F.col("x") / bucket), "py": F.floor(F.col("y") / bucket)})
        same = (F.col("c1") == F.col("chrom1")) & (F.col("c2") == F.col("chrom2")) & (F.col("px") == F.col("bx")) & (F.col("py") == F.col("by"))
        inside = (F.col("x") >= F.col("lo1")) & (F.col("x") < F.col("hi1")) & (F.col("y") >= F.col("lo2")) & (F.col("y") < F.col("hi2"))
        found = r.join(p, same).where(inside).groupBy(*six).agg(_AGGREGATES[self.func]("v").alias(self.name))
        return rects.join(found, six, "left")

    def over_pairs(self, first: DataFrame, second: DataFrame, min_dist: int, max_dist: int) -> DataFrame:
        """The rows of ``feature_pairs`` and a column of the track's name; null where no point lies.

        Points meet the windows of first and of second features, and what they find goes to the first features before pairs are made of them: no pair is shuffled.
        """
        if self.func not in _AGGREGATES:
            raise ValueError(f"no such function: {self.func}")
        sides, widest = [], []
        for i, (rows, shift) in enumerate(((first, self.shift1), (second, self.shift2)), 1):
            r = rows.select("chrom", F.col("start").alias(f"start{i}"), F.col("end").alias(f"end{i}")).distinct()
            lo, hi = F.col(f"start{i}") + shift[0], F.col(f"end{i}") + shift[1]
            wide = r.agg(F.max(hi - lo)).first()[0] or 0
            bucket = max(1, wide)
            widest.append(wide)
            r = r.where(lo < hi).withColumns({f"lo{i}": lo, f"hi{i}": hi}).withColumn(f"b{i}", F.explode(F.sequence(F.floor(F.col(f"lo{i}") / bucket), F.floor((F.col(f"hi{i}") - 1) / bucket))))
            sides.append((r, bucket))
        # A point in both windows lies in this band off the diagonal.
        d = F.col("start2") - F.col("start1")
        p = self.track.where("chrom1 = chrom2").where((d > min_dist + self.shift2[0] - self.shift1[0] - widest[0]) & (d < max_dist + self.shift2[0] + widest[1] - self.shift1[0]))
        p = p.select(F.col("chrom1").alias("chrom"), F.col("start1").alias("x"), F.col("start2").alias("y"), F.col(self.value).alias("v"))
        hit = p.withColumn("b1", F.floor(F.col("x") / sides[0][1])).join(sides[0][0], ["chrom", "b1"]).where("x >= lo1 and x < hi1")
        hit = hit.withColumn("b2", F.floor(F.col("y") / sides[1][1])).join(sides[1][0], ["chrom", "b2"]).where("y >= lo2 and y < hi2")
        found = hit.where((d > min_dist) & (d < max_dist)).groupBy("chrom", "start1", "end1", "start2", "end2").agg(_AGGREGATES[self.func]("v").alias("v"))
        found = found.groupBy("chrom", "start1", "end1").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("start2", "end2"), "v"))).alias("found"))
        b = lambda c: F.floor(F.col(c) / max_dist)
        a = first.select("chrom", F.col("start").alias("start1"), F.col("end").alias("end1")).distinct().join(found, ["chrom", "start1", "end1"], "left")
        a = a.withColumn("bucket", F.explode(F.array(b("start1"), b("start1") + 1)))
        c = second.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2")).distinct().withColumn("bucket", b("start2"))
        both = a.join(c, ["chrom", "bucket"]).where((d > min_dist) & (d < max_dist))
        return both.select("chrom", "start1", "end1", "start2", "end2", F.element_at("found", F.struct("start2", "end2")).alias(self.name))


def screen(track: VirtualTrack, rects: DataFrame, least: float, band: tuple[int, int] | None = None) -> DataFrame:
    """Rectangles in the band where the virtual track is greater than ``least``."""
    if band:
        d = F.col("start1") - F.col("start2")
        rects = rects.where((d >= band[0]) & (d < band[1]))
    return track.over(rects).where(F.col(track.name) > least).drop(track.name)
