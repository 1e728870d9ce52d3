"""Exact k nearest neighbours in the plane, as a join on tiles.

Points are dealt to square tiles, and a reference is sent to those tiles that hold points and whose square, widened by a
halo, holds it. The first tiles hold some ten thousands of references, and their halo is narrow against them, so few references go to several. In a task a point's k-th neighbour is final if it is nearer than the border
of what the task can see. Points that are not final go to the next round with tiles and
halo four times as wide as the last halo. Points that no halo short of everything settles meet all references of their
chromosome in the last round, block by block, and the blocks' nearest are merged. Chromosomes with fewer references than
asked for are left out at once. Rounds are written, so a lost executor costs one. Inside a task references are sorted into fine cells,
so that work follows the local density. References with a count are met once and weigh
as many neighbours as the count says; none is replicated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import written as _written

_REFS = 50_000


def nearest(px: np.ndarray, py: np.ndarray, rx: np.ndarray, ry: np.ndarray, weight: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) ascending distances from points to weighted references, and which rows are final: k-th distance within ``reach``.

    Rows with fewer than k neighbours are filled with infinity.
    """
    out = np.full((len(px), k), np.inf)
    if not len(rx) or not len(px):
        return out, np.isinf(reach)
    often = np.clip(weight, 0, k)
    span = max(rx.max() - rx.min(), ry.max() - ry.min(), 1)
    # So wide that the k-th neighbour mostly lies within one cell.
    cell = max(1.0, span / max(1.0, np.sqrt(len(rx) / max(1.0, 0.45 * k / max(1.0, often.mean())))))
    todo = np.arange(len(px))
    while len(todo):
        gx, gy = np.floor(rx / cell).astype(np.int64), np.floor(ry / cell).astype(np.int64)
        x0, y0 = gx.min() - 1, gy.min() - 1
        wide = int(gy.max() - y0 + 2)
        key = (gx - x0) * wide + (gy - y0)
        order = np.argsort(key, kind="stable")
        keys = key[order]
        cx, cy = np.clip(np.floor(px[todo] / cell).astype(np.int64), x0, gx.max() + 1), np.clip(np.floor(py[todo] / cell).astype(np.int64), y0, gy.max() + 1)
        whole = wide <= 5 and gx.max() - x0 <= 4 or cell >= 4 * span + 1
        left = []
        own = (cx - x0) * wide + (cy - y0)
        by = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[by])) + 1
        for group in np.split(by, cuts):
            a, b = cx[group[0]], cy[group[0]]
            if whole:
                at = order
            else:
                lo = np.searchsorted(keys, [(x - x0) * wide + max(b - 1 - y0, 0) for x in (a - 1, a, a + 1)], "left")
                hi = np.searchsorted(keys, [(x - x0) * wide + min(b + 1 - y0, wide - 1) for x in (a - 1, a, a + 1)], "right")
                at = np.concatenate([order[s:e] for s, e in zip(lo, hi, strict=True)])
            who = todo[group]
            sure = np.full(len(who), np.inf) if whole else np.minimum.reduce([px[who] - (a - 1) * cell, (a + 2) * cell - px[who], py[who] - (b - 1) * cell, (b + 2) * cell - py[who]])
            at = np.repeat(at, often[at])  # a cell's width follows the weights, so there are as few of these
            ax, ay = rx[at], ry[at]
            step = max(1, min(512, 4_000_000 // max(1, len(at))))
            for s in range(0, len(who), step):
                w = who[s : s + step]
                d = _k_smallest(np.sqrt((px[w][:, None] - ax) ** 2 + (py[w][:, None] - ay) ** 2), k)
                ok = (d[:, -1] < sure[s : s + step]) | whole
                out[w[ok]] = d[ok]
                left.append(w[~ok & (sure[s : s + step] < reach[w])])  # others have too few within reach and are not final
        todo = np.concatenate(left) if left else np.zeros(0, np.int64)
        cell *= 2
    return out, (out[:, -1] <= reach) | np.isinf(reach)


def _k_smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k smallest distances, ascending; infinity where there are fewer."""
    if not d.size:
        return np.full((len(d), k), np.inf)
    m = min(k, d.shape[1])
    least = lambda a: np.sort(np.partition(a, m - 1, axis=1)[:, :m] if m < a.shape[1] else a, axis=1)
    near = least(d)
    return near if m == k else np.concatenate([near, np.full((len(d), k - m), np.inf)], axis=1)


def _rows(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids = t.column("point_id").combine_chunks()
    if pa.types.is_struct(ids.type):  # Spark's schema of the result has fields that may be null
        ids = ids.cast(pa.struct([pa.field(f.name, f.type) for f in ids.type]))
    return ids, *(t.column(c).to_numpy().astype(np.float64) for c in ("x", "y"))


def _distances(px: np.ndarray, py: np.ndarray, right: pa.Table, need: list[int], reach: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each reference set the k least distances, and which points are final in all sets."""
    src, n = right.column("src").to_numpy(), right.column("n").to_numpy()
    rx, ry = (right.column(c).to_numpy().astype(np.float64) for c in ("x", "y"))
    got = [nearest(px, py, rx[src == i], ry[src == i], n[src == i], k, reach) for i, k in enumerate(need)]
    return [d for d, _ in got], np.logical_and.reduce([ok for _, ok in got]) if len(px) else np.zeros(0, bool)


def _finished(ids: pa.Array, found: list[np.ndarray], final: np.ndarray, finish: Callable[[list[np.ndarray]], dict[str, pa.Array]]) -> pa.Table:
    """Rows of the final points that have enough neighbours, and the ids of the points that are not final."""
    full = np.logical_and.reduce([np.isfinite(d[:, -1]) for d in found]) if len(final) else final
    made = finish([np.rint(d[final & full]).astype(np.int64) for d in found])
    rows, rest = np.flatnonzero(final & full), np.flatnonzero(~final)
    cols = {"point_id": pa.concat_arrays([ids.take(pa.array(rows)), ids.take(pa.array(rest))]), "settled": pa.array(np.arange(len(rows) + len(rest)) < len(rows))}
    return pa.table(cols | {name: pa.concat_arrays([a, pa.nulls(len(rest), a.type)]) for name, a in made.items()})


def _in_tiles(todo: DataFrame, every: DataFrame, need: list[int], finish: Callable, schema: str, tile: int, id_type: str, halo: int) -> DataFrame:
    """One round: a tile's points against the references of the tile and of a halo around it, as wide as the tile at most."""
    at = lambda c: F.floor(F.col(c) / tile)
    pts = todo.select("point_id", "chrom", "x", "y", at("x").alias("tx"), at("y").alias("ty"))
    # Written, so that Spark knows how few they are and sends no reference twice where it can be helped.
    wanted = _written(todo.select("chrom", at("x").alias("tx"), at("y").alias("ty")).distinct())
    seen = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    ref = every.withColumn("tx", seen("x")).withColumn("ty", seen("y")).join(wanted, ["chrom", "tx", "ty"], "left_semi")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, px, py = _rows(left)
        reach = np.zeros(0)
        if left.num_rows:
            x0, y0 = left.column("tx")[0].as_py() * tile, left.column("ty")[0].as_py() * tile
            reach = np.minimum.reduce([px - (x0 - halo), x0 + tile + halo - px, py - (y0 - halo), y0 + tile + halo - py]) - 1
        return _finished(ids, *_distances(px, py, right, need, reach), finish)

    keys = ["chrom", "tx", "ty"]
    return pts.groupBy(*keys).cogroup(ref.groupBy(*keys)).applyInArrow(work, f"point_id {id_type}, settled boolean, {schema}")


def _in_blocks(todo: DataFrame, every: DataFrame, need: list[int], finish: Callable, schema: str, max_refs: int, id_type: str, many: int = 2000) -> DataFrame:
    """The rest of the points against everything on their chromosome: blocks of points meet blocks of references, and the nearest of all blocks are merged."""
    sizes = every.groupBy("chrom").agg(F.ceil(F.count("*") / max_refs).cast("int").alias("rbs"))
    sizes = F.broadcast(todo.groupBy("chrom").agg(F.ceil(F.count("*") / many).cast("int").alias("pbs")).join(sizes, "chrom"))  # a row a chromosome
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pts = todo.join(sizes, "chrom").withColumn("pb", F.pmod(F.xxhash64("point_id"), "pbs").cast("int")).withColumn("rb", each("rbs")).drop("pbs", "rbs")
    ref = every.join(sizes, "chrom").withColumn("rb", F.pmod(F.xxhash64("x", "y"), "rbs").cast("int")).withColumn("pb", each("pbs")).drop("pbs", "rbs")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, px, py = _rows(left)
        found, _ = _distances(px, py, right, need, np.full(len(px), np.inf))
        both = np.concatenate(found, 1)
        place = [left.column(c).cast(t).combine_chunks() for c, t in (("chrom", pa.string()), ("pb", pa.int32()))]
        return pa.table({"point_id": ids, "chrom": place[0], "pb": place[1], "d": pa.array([r.tobytes() for r in both], pa.binary())})

    keys = ["chrom", "pb", "rb"]
    near = pts.groupBy(*keys).cogroup(ref.groupBy(*keys)).applyInArrow(work, f"point_id {id_type}, chrom string, pb int, d binary")
    key = near.withColumn("key", F.xxhash64("point_id"))

    def merge(t: pa.Table) -> pa.Table:
        code = t.column("key").to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
        d = np.frombuffer(b"".join(t.column("d").to_pylist()), np.float64).reshape(t.num_rows, -1)[order]
        found, at = [], 0
        for k in need:
            best = np.full((len(first), k), np.inf)
            for i, (lo, hi) in enumerate(zip(first, np.append(first[1:], len(order)), strict=True)):
                best[i] = np.sort(d[lo:hi, at : at + k].ravel())[:k]
            found.append(best)
            at += k
        ids, _, _ = _rows(t.select(["point_id"]).append_column("x", pa.nulls(t.num_rows, pa.float64())).append_column("y", pa.nulls(t.num_rows, pa.float64())))
        return _finished(ids.take(pa.array(order[first])), found, np.ones(len(first), bool), finish)

    return key.groupBy("chrom", "pb").applyInArrow(merge, f"point_id {id_type}, settled boolean, {schema}")


def _first_round(every: DataFrame, need: list[int], tile: int, far: int) -> tuple[int, int]:
    """Width of the first tiles, doubled while the densest holds ``_REFS`` references at most, and of their halo."""
    at = lambda c, w: F.floor(F.col(c) / w)
    sums = [F.sum(F.when(F.col("src") == i, F.col("n"))).alias(f"n{i}") for i in range(len(need))]
    cells = _written(every.groupBy("chrom", at("x", tile).alias("cx"), at("y", tile).alias("cy")).agg(F.count("*").alias("rows"), *sums))
    density = cells.agg(*[F.avg(f"n{i}") for i in range(len(need))]).first()  # a mean over the cells that hold any
    rim = max(int(np.ceil(1.6 * tile * np.sqrt(k / np.pi / d))) for k, d in zip(need, density, strict=True))
    times = 1
    while tile * times * 2 <= far:
        if cells.groupBy("chrom", at("cx", 2 * times), at("cy", 2 * times)).agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] > _REFS:
            break
        times *= 2
    return tile * times, min(rim, tile * times)


def tiled(points: DataFrame, refs: dict[str, DataFrame], ks: dict[str, int], finish: Callable[[list[np.ndarray]], dict[str, pa.Array]], schema: str, tile: int | None = None, halo: int | None = None, max_refs: int = 1_000_000) -> DataFrame:
    """Rows (point_id, *schema) made by ``finish`` from the distance matrices of each reference set in order.

    points: point_id (different for each point), chrom, x, y. refs: chrom, x, y, n (multiplicity). A point with fewer neighbours than asked for in some set is left out.
    Tiles start so narrow that none holds more than ``max_refs`` references, however dense the diagonal is. ``halo``, if given, bounds the first tiles.
    Without ``tile`` the first tiles are so wide that the densest holds some ten thousands of references, with a halo by the mean density of places that hold any.
    """
    names = list(refs)
    every = None
    for i, name in enumerate(names):
        part = refs[name].select("chrom", "x", "y", F.col("n").cast("long").alias("n"), F.lit(i).alias("src"))
        every = part if every is None else every.unionByName(part)
    need = [ks[n] for n in names]
    every = _written(every)
    id_type = points.schema["point_id"].dataType.simpleString()
    # The references of each chromosome; a genome has few.
    enough = every.groupBy("chrom").agg(*[F.sum(F.when(F.col("src") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(need))], F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far")).collect()
    rich = [r.chrom for r in enough if all(r[f"n{i}"] >= k for i, k in enumerate(need))]
    far = max((r.far for r in enough), default=0)
    every = every.where(F.col("chrom").isin(rich))
    todo = _written(points.where(F.col("chrom").isin(rich)).select("point_id", "chrom", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))
    wide = tile is None
    tile = min(tile or 1 << 18, halo or tile or 1 << 18)
    while tile > 1024:
        densest = every.groupBy("chrom", F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)).count().agg(F.max("count")).first()[0] or 0
        if densest <= max_refs:
            break
        # The count falls with the square of the width at most.
        tile = max(1024, tile // max(2, 1 << int(np.ceil(np.log2(densest / max_refs) / 2))))
    rim = tile
    if wide and not halo and rich and densest <= _REFS // 4:
        tile, rim = _first_round(every, need, tile, far)
    done = None
    while tile <= 4 * far:
        found = _written(_in_tiles(todo, every, need, finish, schema, tile, id_type, rim))
        part = found.where("settled").drop("settled")
        done = part if done is None else done.unionByName(part)
        left = found.where("not settled").select("point_id")
        if left.isEmpty():
            return done
        todo = _written(todo.join(left, "point_id", "left_semi"))
        tile = rim = 4 * rim
    part = _in_blocks(todo, every, need, finish, schema, max_refs, id_type).drop("settled")
    return part if done is None else done.unionByName(part)


def knn_join(points: DataFrame, refs: DataFrame, k: int, **how) -> DataFrame:
    """point_id, distances: the k rounded distances to the nearest references, ascending."""

    def finish(d: list[np.ndarray]) -> dict[str, pa.Array]:
        m = d[0]
        return {"distances": pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))}

    return tiled(points, {"ref": refs}, {"ref": k}, finish, "distances array<long>", **how)


def knn_ranked(points: DataFrame, refs: DataFrame, k: int, **how) -> DataFrame:
    """Long form: point_id, rn (from 1), dist."""
    return knn_join(points, refs, k, **how).select("point_id", F.posexplode("distances").alias("rn", "dist")).withColumn("rn", F.col("rn") + 1)
