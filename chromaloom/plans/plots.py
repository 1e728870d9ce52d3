"""Compositions that end in a picture: a summed feature grid, a scored map over lanes of signal and annotations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.enrich import grid_values, rebinned, sum_grids
from ..operators.viz import scored_points, svg_grid, svg_map, tracks_and_annotations


def plot_feature_grid(grids: list[DataFrame], reach: int, grid_resolution: int, plot_resolution: int, kind: str = "enrichment", zlim: tuple[float, float] = (-1, 1), path: str | None = None, palette: tuple[str, ...] = ("blue", "white", "red"), side: int = 400) -> tuple[DataFrame, DataFrame]:
    """Sums replicate grids cell by cell, re-bins them if the resolutions differ, and returns (sums, values); writes an SVG to ``path``."""
    total = sum_grids(grids)
    if plot_resolution != grid_resolution:
        total = rebinned(total, reach, grid_resolution, plot_resolution)
    values = grid_values(total, kind)
    if path:
        Path(path).write_text(svg_grid(values, zlim, side, palette))
    return total, values


def stacked(spans: list[tuple[int, int]]) -> list[int]:
    """The row of each span, from 0, such that none of a row overlap; as few rows as there are spans over one base."""
    ends: list[int] = []
    row = [0] * len(spans)
    for i in sorted(range(len(spans)), key=spans.__getitem__):
        row[i] = next((k for k, end in enumerate(ends) if end <= spans[i][0]), len(ends))
        ends[row[i] : row[i] + 1] = [spans[i][1]]
    return row


def axis_ticks(start: int, end: int, many: int = 5) -> list[int]:
    """Round positions, some ``many`` of them, at steps of 1, 2 or 5 times a power of ten."""
    step = next(m * 10**e for e in range(20) for m in (1, 2, 5) if (end - start) / (m * 10**e) <= many)
    return list(range(-(-start // step) * step, end + 1, step))


def _svg_lane(rows: list, kind: str, scale, top: float, tall: float, size: float, colour: str, ylim: tuple[float, float] | None, stacking: str) -> list[str]:
    """Rectangles of one lane: bars over the lower limit for a signal, boxes for the rest, in rows of their own if they overlap and are squished."""
    box = lambda r, y, h: f'<rect x="{scale(r.start):.2f}" y="{y:.2f}" width="{max(scale(r.end) - scale(r.start), 0.5):.2f}" height="{h:.2f}" fill="{colour}"/>'
    if kind == "signal":
        low, high = ylim or (0.0, max((r.value for r in rows), default=1) or 1)
        heights = [tall * size * min(max((r.value - low) / ((high - low) or 1), 0), 1) for r in rows]
        return [box(r, top + tall - h, h) for r, h in zip(rows, heights, strict=True)]
    at = stacked([(r.start, r.end) for r in rows]) if stacking == "squish" else [0] * len(rows)
    each = tall * size / (max(at, default=0) + 1)
    return [box(r, top + k * each, each * 0.8) for r, k in zip(rows, at, strict=True)]


def plot_scored_map(points: DataFrame, chrom: str, interval: tuple[int, int], signals: dict[str, DataFrame] | None = None, annotations: dict[str, DataFrame] | None = None, genes: DataFrame | None = None, width: int = 900, height: int = 750, most: int = 100_000, ideogram: DataFrame | None = None, axis: bool = True, track_colors: tuple[str, ...] | None = None, annotation_colors: tuple[str, ...] | None = None, ylims: dict[str, tuple[float, float]] | None = None, stacking: str = "squish", point_size: float = 1.0, gene_size: float = 0.7, track_size: float = 0.8, annotation_size: float = 0.7, config: EngineConfig | None = None) -> str:
    """An SVG of five rows: a rotated scored map in three, and in two an axis, and lanes of an ideogram, genes, signals and annotations.

    Colours are dealt to the lanes in turn, by default those of ``config``. ``ylims`` are limits of signals by name; ``stacking`` "squish" puts
    overlapping genes and annotations in rows of their own, "dense" on one.
    """
    if stacking not in ("squish", "dense"):
        raise ValueError(f"no such stacking: {stacking}")
    c, (start, end) = config or EngineConfig(), interval
    upper = height * 3 // 5
    inside = points.where(F.col("chrom1") == chrom) if "chrom1" in points.columns else points
    body = [svg_map(scored_points(inside, interval), width, upper, point_size)]
    scale = lambda x: (x - start) / max(end - start, 1) * width
    signals, annotations = signals or {}, annotations or {}
    frames = annotations | ({"ideogram": ideogram} if ideogram is not None else {})
    top = upper
    if axis:
        body.append(f'<line x1="0" y1="{top}" x2="{width}" y2="{top}" stroke="black"/>')
        body += [f'<text x="{scale(t):.1f}" y="{top + 14}" font-size="10">{t:,}</text>' for t in axis_ticks(start, end)]
        top += 20
    if signals or frames or genes is not None:
        rows = tracks_and_annotations(chrom, start, end, signals, frames, genes).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} lane items do not make a picture; narrow the interval")
        lanes = [("ideogram", "annotation", "#888888", annotation_size)] if ideogram is not None else []
        lanes += [("genes", "gene", "#000000", gene_size)] if genes is not None else []
        for names, kind, colours, size in ((signals, "signal", track_colors or c.track_colors, track_size), (annotations, "annotation", annotation_colors or c.annotation_colors, annotation_size)):
            lanes += [(n, kind, colours[i % len(colours)], size) for i, n in enumerate(names)]
        tall = (height - top) / len(lanes)
        for k, (name, kind, colour, size) in enumerate(lanes):
            mine = [r for r in rows if r.lane == name and r.kind == kind]
            body += _svg_lane(mine, kind, scale, top + k * tall, tall, size, colour, (ylims or {}).get(name), stacking)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(body)}</svg>'
