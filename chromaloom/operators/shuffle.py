"""Expected contact maps by marginal-preserving randomised swap rounds.

A step moves a grid of square cells by a random offset, pairs the contacts of each cell at
random and proposes to swap the second coordinates of each pair. Rows and both marginals
are kept exactly; the Metropolis rule with a target decay and a proposal bias keeps the distance decay. Target and bias
belong to a chromosome: chromosomes are shuffled in one job, each by its own decay, and none waits for or bends another.

A round deals the contacts to square tiles, some cells wide and moved by a random offset as well, and makes many steps
inside each tile in numpy, so one exchange serves many steps; the bias is corrected between rounds, which begin with few steps.
Dense tiles are made narrower, and if cells alone are dense, contacts near the diagonal are dealt to salted groups, both by counts of the data. All randomness is a hash of
seed, round, step and contact, so a lost executor replays the same round. ``swap_round`` is one step in DataFrame functions alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.genomic import beyond, distance_bin, hash28, min_distance_bin
from ..sources.stages import written as _written
from .contacts import count_pairs, in_rectangle, mirror, replicate
from .decay import LOG_ZERO, area_proposal, auto_resolution, auto_smooth, constant_proposal, corrected_proposal, expected_decay, sampled_proposal

#: Tiles are this many cells wide, unless that makes them hold more than DENSE contacts.
SPAN, DENSE = 8, 2_000_000


@dataclass(frozen=True)
class ShuffleResult:
    contacts: DataFrame  # chrom, cid, x, y
    sweeps: float  # the least of all chromosomes
    history: list[dict]
    status: dict[str, str] = field(default_factory=dict)  # of each chromosome: mixed, stuck, or out of rounds


def paired(rows: DataFrame, seed: int, number: int, cell: int, salts: int = 1) -> DataFrame:
    """Rows (chrom, cid, x, y) with their partner's cid, x and y; an odd row out has none."""
    shift = lambda axis: F.pmod(hash28(F.lit(seed), F.lit(number), F.lit(axis)), F.lit(cell))
    h = hash28(F.lit(seed), F.lit(number), F.col("cid"))
    dealt = rows.withColumns({"gx": F.floor((F.col("x") + shift("x")) / cell), "gy": F.floor((F.col("y") + shift("y")) / cell), "h": h})
    dealt = dealt.withColumn("salt", F.pmod(F.col("h"), F.lit(salts)))
    w = Window.partitionBy("chrom", "gx", "gy", "salt").orderBy("h", "cid")
    ranked = dealt.withColumn("rn", F.row_number().over(w))
    odd = F.col("rn") % 2 == 1
    partner = lambda c: F.when(odd, F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    return ranked.select("chrom", "cid", "x", "y", partner("cid").alias("pcid"), partner("x").alias("px"), partner("y").alias("py"))


def swap_round(rows: DataFrame, seed: int, number: int, cell: int, resolution: int, min_dist: int, log_ratio, salts: int = 1) -> DataFrame:
    """One step: chrom, cid, x, y, moved. ``log_ratio`` makes the log of target over proposal of a bin column, or is a table
    (chrom, dbin, value) of some thousand rows; bins that it lacks are log zero."""
    p = paired(rows, seed, number, cell, salts)
    b = lambda x, y: distance_bin(resolution, min_dist, F.col(x), F.col(y))
    p = p.withColumns({"b_i": b("x", "y"), "b_j": b("px", "py"), "b_ij": b("x", "py"), "b_ji": b("px", "y")})
    if isinstance(log_ratio, DataFrame):
        for c in ("b_i", "b_j", "b_ij", "b_ji"):
            look = F.broadcast(log_ratio.select("chrom", F.col("dbin").alias(c), F.col("value").alias(f"l{c}")))
            p = p.join(look, ["chrom", c], "left")
        value = lambda c: F.coalesce(F.col(f"l{c}"), F.lit(LOG_ZERO))
    else:
        value = lambda c: log_ratio(F.col(c))
    gain = value("b_ij") + value("b_ji") - value("b_i") - value("b_j")
    u = hash28(F.lit(seed), F.lit(number), F.lit("u"), F.least("cid", "pcid")) / F.lit(float(1 << 28))
    ok = F.col("pcid").isNotNull() & (F.col("b_ij") >= 0) & (F.col("b_ji") >= 0) & (u < F.exp(F.least(F.lit(0.0), gain)))
    moved = F.coalesce(ok, F.lit(False))
    return p.select("chrom", "cid", "x", F.when(moved, F.col("py")).otherwise(F.col("y")).alias("y"), moved.alias("moved"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _salt(*parts: int) -> int:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = _mixed(h + np.uint64(p % (1 << 64)) + np.uint64(0x9E3779B97F4A7C15))
    return int(h[0])


@dataclass
class Decay:
    """A chromosome's distance bins, its target and its bias."""

    resolution: int
    min_bin: int
    total: int
    expected: np.ndarray
    proposal: np.ndarray
    done: float = 0.0
    idle: int = 0

    def gain(self) -> np.ndarray:
        """The log of target over bias; a bin without a target is not worth a move, whatever its bias."""
        return np.where(self.expected > LOG_ZERO, self.expected - self.proposal, LOG_ZERO)

    def correct(self, observed: np.ndarray, factor: float) -> None:
        """A bin that has a target but no contact yet counts as one contact; without a bias it would draw all moves."""
        met = np.where(self.expected > LOG_ZERO, np.maximum(observed, 1), observed)
        self.proposal = corrected_proposal(self.proposal, met, self.expected, factor)

    def start(self, observed: np.ndarray, smooth: int, proposal: np.ndarray) -> None:
        self.expected = expected_decay(observed, smooth)
        live = self.expected > LOG_ZERO
        least = proposal[live & (proposal > LOG_ZERO)].min(initial=0.0)
        self.proposal = np.where(live, np.maximum(proposal, least), proposal)

    def bins(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The distance bin, -1 under the least distance; cut to the bins there are."""
        b = np.floor(np.log(1 + np.abs(x - y).astype(np.float64)) / np.log(2.0) * self.resolution).astype(np.int64) - self.min_bin
        return np.where(b < 0, -1, np.minimum(b, len(self.expected) - 1) if len(self.expected) else b)


def shuffled_tile(cid: np.ndarray, x: np.ndarray, y: np.ndarray, decay: Decay, cell: int, steps: range, seed: int, accept: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y after the steps, how often each row moved, and the bins of all proposals of the last step. Pairs share a cell of the step's grid."""
    y, moved, proposed = y.copy(), np.zeros(len(x), np.int64), np.zeros(0, np.int64)
    gain = decay.gain()
    b = decay.bins(x, y)
    h = cid.view(np.uint64)
    for k in steps:
        gx, gy = (x + _salt(seed, k, 1) % cell) // cell, (y + _salt(seed, k, 2) % cell) // cell
        gx -= gx.min()
        gy -= gy.min()
        code = (gx * (int(gy.max()) + 1) + gy).astype(np.uint64)
        r = _mixed(h ^ np.uint64(_salt(seed, k, 3)))
        order = np.argsort(code << np.uint64(36) | r >> np.uint64(28))
        place = code[order]
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        first = np.flatnonzero((nth[:-1] % 2 == 0) & (place[1:] == place[:-1]))
        i, j = order[first], order[first + 1]
        b_ij, b_ji = decay.bins(x[i], y[j]), decay.bins(x[j], y[i])
        if not accept:
            proposed = np.concatenate((b_ij, b_ji))
            continue
        # A distance that belongs to the least one's bin or farther, and the Metropolis rule.
        u = (_mixed(r[i] ^ (r[j] >> np.uint64(7))) >> np.uint64(11)) / float(1 << 53)
        ok = (b_ij >= 0) & (b_ji >= 0) & (u < np.exp(np.minimum(0.0, gain[b_ij] + gain[b_ji] - gain[b[i]] - gain[b[j]])))
        i, j = i[ok], j[ok]
        y[i], y[j], b[i], b[j] = y[j], y[i], b_ij[ok], b_ji[ok]
        moved[i] += 1
        moved[j] += 1
    return y, moved, proposed


def _dealt(rows: DataFrame, seed: int, number: int, cell: int, span: dict[str, int], salts: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows side by side by tile: (chrom, tx, ty, salt)."""
    pick = lambda of: F.coalesce(*[F.when(F.col("chrom") == c, F.lit(int(v))) for c, v in of.items()], F.lit(1))
    width = pick(span) * cell
    at = lambda axis, no: F.floor((F.col(axis) + F.pmod(F.lit(_salt(seed, number, no) >> 2), width)) / width)
    dealt = rows.withColumns({"tx": at("x", 8), "ty": at("y", 9)})
    many = F.when(F.abs(F.col("tx") - F.col("ty")) <= 1, pick({c: v[0] for c, v in salts.items()})).otherwise(pick({c: v[1] for c, v in salts.items()}))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(seed), F.lit(number)), many))
    keys = ["chrom", "tx", "ty", "salt"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles from sorted batches, one at a time; salts bound their size."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("chrom", "tx", "ty", "salt"))

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(batch.schema.get_field_index("chrom")).dictionary_encode().indices.to_numpy()
        differ = names[1:] != names[:-1]
        for c in ("tx", "ty", "salt"):
            v = batch.column(batch.schema.get_field_index(c)).to_numpy()
            differ |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(differ) + 1).tolist(), batch.num_rows]
        for n, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if held and (n or key(held[-1], 0) != key(batch, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


_ROWS = "chrom string, cid long, x long, y long, dbin int, moved int"


def _round(rows: DataFrame, decays: dict[str, Decay], seed: int, number: int, cell: int, steps: int, span: dict[str, int], salts: dict[str, tuple[int, int]], accept: bool = True) -> DataFrame:
    """``_ROWS`` after a round; without ``accept`` the bins of what one step would propose, in dbin."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            chrom = t.column("chrom")[0].as_py()
            d = decays[chrom]
            cid, x, y = (t.column(c).to_numpy() for c in ("cid", "x", "y"))
            # Steps of one tile differ from those of others in their offsets, so that borders do not align.
            own = _salt(seed, number, *(t.column(c)[0].as_py() for c in ("tx", "ty", "salt"))) >> 1
            y, moved, proposed = shuffled_tile(cid, x, y, d, cell, range(steps), own, accept)
            if accept:
                arrays = [cid, x, y, d.bins(x, y).astype(np.int32), moved.astype(np.int32)]
            else:
                zero = np.zeros(len(proposed), np.int64)
                arrays = [zero, zero, zero, proposed.astype(np.int32), zero.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(arrays[0]), pa.string()), *map(pa.array, arrays)], ["chrom", "cid", "x", "y", "dbin", "moved"])

    return _dealt(rows, seed, number, cell, span, salts).mapInArrow(run, _ROWS)


def _binned(rows: DataFrame, decays: dict[str, Decay]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, x, y = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            names = np.array(names, object)
            bins = np.zeros(len(x), np.int32)
            for c in set(names.tolist()):
                of = names == c
                bins[of] = decays[c].bins(x[of], y[of])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins), pa.array(np.zeros(len(x), np.int32))], ["chrom", "cid", "x", "y", "dbin", "moved"])

    return rows.select("chrom", "cid", "x", "y").mapInArrow(run, _ROWS)


def _counted(rows: DataFrame, decays: dict[str, Decay]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Of each chromosome the histogram of bins and the number of moves: some thousand rows."""
    hist, moves = {c: np.zeros(len(d.expected)) for c, d in decays.items()}, dict.fromkeys(decays, 0)
    for r in rows.groupBy("chrom", "dbin").agg(F.count("*").alias("n"), F.sum("moved").alias("m")).collect():
        if r.dbin >= 0:
            hist[r.chrom][r.dbin] = r.n
        moves[r.chrom] += r.m
    return hist, moves


def _density(rows: DataFrame, cell: int) -> tuple[dict[str, int], dict[str, tuple[int, int]]]:
    """Tiles' widths in cells and salts (near the diagonal, elsewhere) of each chromosome, by the fullest cells."""
    g = rows.groupBy("chrom", F.floor(F.col("x") / cell).alias("a"), F.floor(F.col("y") / cell).alias("b")).agg(F.count("*").alias("n"))
    g = g.groupBy("chrom", (F.abs(F.col("a") - F.col("b")) <= 1).alias("near")).agg(F.max("n").alias("n"))
    most = {(r.chrom, r.near): r.n for r in g.collect()}
    span, salts = {}, {}
    for c in {c for c, _ in most}:
        near, far = most.get((c, True), 1), most.get((c, False), 1)
        # A tile has about span near cells along the diagonal and span * span others.
        span[c] = next((s for s in (SPAN, 4, 2) if 3 * s * near <= DENSE and s * s * far <= DENSE), 1)
        salts[c] = tuple(max(1, -(-n // DENSE)) for n in (near, far))
    return span, salts


def shuffle_contacts(rows: DataFrame, resolution: int | dict[str, int], smooth: int | dict[str, int], min_dist: int = 1024, seed: int = 1, sweeps: float = 80, cells: tuple[int, int, int] = (500_000, 1_000_000, 500_000), step_sweeps: float = 40, factor: float = 0.25, max_rounds: int | None = None, salts: int | None = None, proposal_from: str = "contacts", steps: int = 32) -> ShuffleResult:
    """Rounds on mirrored rows (chrom, cid, x, y) until every chromosome has ``sweeps`` accepted swaps for each contact.

    The cell grows from cells[0] by cells[2] to cells[1] every ``step_sweeps`` sweeps; a chromosome in which two rounds of the full number of
    steps bring no move is stuck and ends. ``max_rounds``, if set, ends all; ``status`` says how each ended.
    ``resolution`` and ``smooth`` may differ by chromosome. ``salts`` replaces those that the data ask for.
    ``proposal_from``: "contacts" for the bins that a step without swaps would propose, "area" for the strips' areas, "constant".
    """
    if proposal_from not in ("contacts", "area", "constant"):
        raise ValueError(f"no such proposal: {proposal_from}")
    rows = rows.select("chrom", F.col("cid") if rows.schema["cid"].dataType.simpleString() == "bigint" else F.xxhash64("cid").alias("cid"), F.col("x").cast("long"), F.col("y").cast("long"))
    rows = _written(rows)
    least, most = F.min(F.least("x", "y")), F.max(F.greatest("x", "y"))
    decays: dict[str, Decay] = {}
    extent = {}
    for r in rows.groupBy("chrom").agg(F.count("*").alias("n"), least.alias("lo"), most.alias("hi")).collect():
        res = resolution[r.chrom] if isinstance(resolution, dict) else resolution
        extent[r.chrom] = float(r.hi - r.lo)
        size = max(1, int(np.floor(res * np.log2(1 + r.hi - r.lo))) - min_distance_bin(res, min_dist) + 2)
        decays[r.chrom] = Decay(res, min_distance_bin(res, min_dist), r.n, np.zeros(size), np.zeros(size))
    span, dense = _density(rows, cells[1])
    if salts is not None:
        dense = dict.fromkeys(decays, (salts, salts))
    of = lambda c: smooth[c] if isinstance(smooth, dict) else smooth
    rows = _written(_binned(rows, decays))
    observed, _ = _counted(rows, decays)
    if proposal_from == "contacts":
        proposed, _ = _counted(_round(rows, decays, seed, -1, cells[0], 1, span, dense, accept=False), decays)
    for c, d in decays.items():
        if proposal_from == "contacts":
            bias = sampled_proposal(proposed[c], of(c))
        elif proposal_from == "area":
            bias = area_proposal(len(d.expected), d.resolution, d.min_bin, extent[c])
        else:
            bias = constant_proposal(len(d.expected))
        d.start(observed[c], of(c), bias)
    cell, grown, history, number = cells[0], 0.0, [], 0
    ended: dict[str, str] = {}
    stay = None  # rows of chromosomes that have ended
    while len(ended) < len(decays) and (max_rounds is None or number < max_rounds):
        slowest = min(d.done for c, d in decays.items() if c not in ended)
        if slowest - grown >= step_sweeps and cell < cells[1]:
            cell, grown = min(cells[1], cell + cells[2]), slowest
        many = min(steps, 1 << number // 2)
        rows = _written(_round(rows, {c: d for c, d in decays.items() if c not in ended}, seed, number, cell, many, span, dense))
        observed, moves = _counted(rows, decays)
        for c, d in decays.items():
            if c in ended:
                continue
            d.correct(observed[c], factor)
            d.done += moves[c] / 2 / d.total
            d.idle = 0 if moves[c] else d.idle + (many == steps)
            history.append({"chrom": c, "round": number, "cell": cell, "steps": many, "moved": moves[c], "sweeps": d.done, "total_variation": float(np.abs(observed[c] - np.exp(d.expected)).sum() / 2 / d.total)})
        new = {c: "mixed" if d.done >= sweeps else "stuck" for c, d in decays.items() if c not in ended and (d.done >= sweeps or d.idle >= 2)}
        if new:
            ended |= new
            part = rows.where(F.col("chrom").isin(list(new)))
            stay = part if stay is None else stay.unionByName(part)
            rows = rows.where(~F.col("chrom").isin(list(new)))
        number += 1
    out = rows if stay is None else stay.unionByName(rows)
    status = {c: ended.get(c, "out of rounds") for c in decays}
    return ShuffleResult(out.select("chrom", "cid", "x", "y"), min([d.done for d in decays.values()], default=0.0), history, status)


def contact_rows(track: DataFrame, symmetric: bool = False) -> DataFrame:
    """chrom, cid, x, y: contacts by multiplicity, mirrored unless they are symmetric already. cid is a hash that numbers equal rows apart."""
    one = track.where("contacts >= 1").select(F.col("chrom1").alias("chrom"), F.col("start1").alias("x"), F.col("start2").alias("y"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("contacts").cast("long"))).alias("copy"))
    both = one.withColumn("side", F.lit(0))
    if not symmetric:
        both = both.unionByName(one.select("chrom", F.col("y").alias("x"), F.col("x").alias("y"), "copy", F.lit(1).alias("side")))
    return both.select("chrom", F.xxhash64("chrom", "x", "y", "copy", "side").alias("cid"), "x", "y")


def shuffle_track(track: DataFrame, min_dist: int = 1024, max_dist: int | None = None, resolution: int | None = None, smooth: int | None = None, config: EngineConfig | None = None, seed: int = 1, rect: dict | None = None, report: list | None = None, **how) -> DataFrame:
    """The expected track of an observed one: unique contacts with their counts, each in both orientations.

    Contacts at ``min_dist`` or farther in the upper triangle, of ``rect`` if given, are taken by multiplicity. Under 2000 of them on a
    chromosome, or at resolution 0, the expected track is the observed one and its mirror image. A chromosome that did not reach the
    sweeps asked for is warned of; ``report``, a list, gets the ``ShuffleResult``.
    """
    c = config or EngineConfig()
    upper = track.where(beyond(min_dist, inclusive=True)).where("start1 < start2")
    if rect is not None:
        upper = upper.where(in_rectangle(rect))
    if max_dist is not None:
        upper = upper.where(F.col("start2") - F.col("start1") <= max_dist)
    n = {r.chrom1: (r.n, r.far) for r in upper.groupBy("chrom1").agg(F.sum("contacts").alias("n"), F.max("end2").alias("far")).collect()}
    far = max_dist or max((f for _, f in n.values()), default=0)
    sweeps = how.pop("sweeps", c.shuffle)
    res = {}
    for chrom, (rows, _) in n.items():
        r = auto_resolution(rows, min_dist, far, c.max_resolution) if resolution is None else resolution
        if rows >= c.min_shuffle_rows and r:
            res[chrom] = r
    mixed = F.col("chrom1").isin(list(res))
    out = count_pairs(mirror(replicate(upper.where(~mixed))))
    if not res:
        return out
    smooths = {chrom: auto_smooth(r) if smooth is None else smooth for chrom, r in res.items()}
    got = shuffle_contacts(contact_rows(upper.where(mixed)), res, smooths, min_dist, seed, sweeps, (c.grid_small, c.grid_high, c.grid_increase), c.grid_step_iter, c.correction_factor, **how)
    if report is not None:
        report.append(got)
    short = sorted(f"{chrom}: {why}" for chrom, why in got.status.items() if why != "mixed")
    if short:
        warnings.warn(f"not mixed as asked for: {short}", stacklevel=2)
    both = got.contacts.select("chrom", "x", "y").unionByName(got.contacts.select("chrom", F.col("y").alias("x"), F.col("x").alias("y")))
    done = both.groupBy("chrom", "x", "y").agg(F.count("*").alias("contacts")).select(F.col("chrom").alias("chrom1"), F.col("x").alias("start1"), (F.col("x") + 1).alias("end1"), F.col("chrom").alias("chrom2"), F.col("y").alias("start2"), (F.col("y") + 1).alias("end2"), "contacts")
    return out.unionByName(done)
