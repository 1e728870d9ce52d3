"""Plot-ready frames: rotated maps, score colours, lanes of signal and annotations; a small SVG writer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..schemas import require
from .intervals import overlaps

# RGB of the named colours that palettes may use.
COLOURS = {"lightgrey": (211, 211, 211), "pink": (255, 192, 203), "red": (255, 0, 0), "orange": (255, 165, 0), "yellow": (255, 255, 0), "lightblue": (173, 216, 230), "blue": (0, 0, 255), "black": (0, 0, 0), "white": (255, 255, 255)}


def map_points(points: DataFrame, interval: tuple[int, int] | None = None, rotate: bool = True) -> DataFrame:
    """x, y and the other columns: a triangle over the diagonal, or the square as it is. The range defaults to that of start1."""
    require(points, "start1", "start2")
    others = [c for c in points.columns if c not in ("x", "y")]
    if interval is not None:
        lo, hi = interval
        points = points.where(F.col("start1").between(lo, hi) & F.col("start2").between(lo, hi))
    if not rotate:
        return points.select(F.col("start1").alias("x"), F.col("start2").alias("y"), *others)
    return points.where("start2 > start1").select(((F.col("start1") + F.col("start2")) / 2).alias("x"), ((F.col("start2") - F.col("start1")) / 2).alias("y"), *others)


def map_range(points: DataFrame) -> DataFrame:
    return points.agg(F.min("start1").alias("start"), F.max("start1").alias("end"))


def scored_points(points: DataFrame, interval: tuple[int, int] | None = None, rotate: bool = True) -> DataFrame:
    """``map_points`` in the order of drawing, by score, with the palette index 101 + floor(score)."""
    require(points, "start1", "start2", "score")
    return map_points(points, interval, rotate).withColumn("level", (101 + F.floor("score")).cast("int")).orderBy("score")


def palette_stops(colours: tuple[str, ...], breaks: tuple[int, ...]) -> list[tuple[int, str]]:
    """(level, colour) between which a palette is linear: a colour is reached at its break and left after it."""
    if len(breaks) < len(colours):
        raise ValueError("a break for each colour is needed")
    return sorted({(b + after, c) for i, (c, b) in enumerate(zip(colours, breaks, strict=False)) for after in ((1,) if i == 0 else (0, 1))}, key=lambda x: x[0])


def colours_at(levels: np.ndarray, stops: list[tuple[int, str]]) -> list[str]:
    """Colours of levels by interpolation of each channel; levels outside the stops have the colour of the nearest."""
    at = [x for x, _ in stops]
    rgb = [np.rint(np.interp(levels, at, [COLOURS[c][k] for _, c in stops])).astype(int) for k in range(3)]
    return [f"#{r:02X}{g:02X}{b:02X}" for r, g, b in zip(*rgb, strict=True)]


def score_palette(config: EngineConfig | None = None) -> list[str]:
    """201 colours for scores from -100 to 100: either side has its own stops, and zero its own colour."""
    c = config or EngineConfig()
    levels = np.arange(1, 101)
    below, above = (colours_at(levels, palette_stops(*x)) for x in ((c.score_pal_neg, c.score_pal_neg_breaks), (c.score_pal_pos, c.score_pal_pos_breaks)))
    return [*reversed(below), *colours_at(np.zeros(1), [(0, c.score_pal_zero)]), *above]


def palette_frame(spark: SparkSession, config: EngineConfig | None = None) -> DataFrame:
    colours = score_palette(config)
    rows = F.posexplode(F.array(*map(F.lit, colours))).alias("at", "colour")
    return spark.range(1).select(rows).select((F.col("at") - 100).alias("score"), (F.col("at") + 1).alias("level"), "colour")


def signal_lane(signal: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """1-D values in a region, without missing ones."""
    return overlaps(signal.where(F.col("data").isNotNull()), chrom, start, end)


def annotation_lane(annotations: DataFrame, chrom: str, start: int, end: int, by_strand: bool = False) -> DataFrame:
    """Intersections with a region; with ``by_strand`` a sign: strand 1 is +, all else -."""
    hit = overlaps(annotations, chrom, start, end)
    return hit.withColumn("sign", F.when(F.col("strand") == 1, "+").otherwise("-")) if by_strand else hit


def tracks_and_annotations(chrom: str, start: int, end: int, signals: dict[str, DataFrame], annotations: dict[str, DataFrame], genes: DataFrame | None = None) -> DataFrame:
    """One frame of all lanes, from top to bottom: lane, kind, start, end, value."""
    none = F.lit(None).cast("double")
    lanes = []
    if genes is not None:
        lanes.append(overlaps(genes, chrom, start, end).select(F.lit("genes").alias("lane"), F.lit("gene").alias("kind"), "start", "end", none.alias("value")))
    lanes += [signal_lane(d, chrom, start, end).select(F.lit(n).alias("lane"), F.lit("signal").alias("kind"), "start", "end", F.col("data").alias("value")) for n, d in signals.items()]
    lanes += [overlaps(d, chrom, start, end).select(F.lit(n).alias("lane"), F.lit("annotation").alias("kind"), "start", "end", none.alias("value")) for n, d in annotations.items()]
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out


def svg_map(points: DataFrame, width: int = 900, height: int = 450, size: float = 1.0, most: int = 200_000) -> str:
    """An SVG of scored points in the order of drawing. A picture holds ``most`` points; more raise."""
    colours = score_palette()
    rows = points.select("x", "y", "level").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points do not make a picture; narrow the interval")
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    x0, x1 = min(r.x for r in rows), max(r.x for r in rows)
    y1 = max(r.y for r in rows) or 1
    dot = lambda r: f'<circle cx="{(r.x - x0) / max(x1 - x0, 1) * width:.1f}" cy="{height - r.y / y1 * height:.1f}" r="{size}" fill="{colours[min(max(r.level, 1), 201) - 1]}"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(map(dot, rows))}</svg>'


def svg_grid(cells: DataFrame, zlim: tuple[float, float] = (-1, 1), side: int = 400, palette: tuple[str, ...] = ("blue", "white", "red")) -> str:
    """An SVG heat map of (bin1, bin2, value) in colours spread evenly over ``zlim``; grey where there is no value; at most 1000 x 1000 bins."""
    rows = cells.limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("too many bins for a picture")
    names1, names2 = sorted({r.bin1 for r in rows}), sorted({r.bin2 for r in rows})
    at1, at2 = {b: i for i, b in enumerate(names1)}, {b: i for i, b in enumerate(names2)}
    step = side / max(len(names1), len(names2), 1)
    known = [r.value for r in rows if r.value is not None]
    stops = list(zip(np.linspace(*zlim, len(palette)).tolist(), palette, strict=True))
    fill = iter(colours_at(np.array(known, np.float64), stops))
    body = "".join(f'<rect x="{at1[r.bin1] * step:.2f}" y="{at2[r.bin2] * step:.2f}" width="{step:.2f}" height="{step:.2f}" fill="{next(fill) if r.value is not None else "#CCCCCC"}"/>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{side}" height="{side}">{body}</svg>'
