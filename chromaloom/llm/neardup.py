"""Operator 2: near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass hashes each document's distinct word shingles and takes minima under
   ``rows * bands`` hash functions; groups of ``rows`` full minima make the band keys, and
   the low ``bits`` bits of all minima are packed as the signature. The number of bands
   follows from the threshold, so that a pair at it misses all bands with probability
   under ``miss`` (1e-9).
2. Documents of the same set (128-bit digest) form one class; classes go on.
3. Candidates are pairs of classes that share a band bucket and whose signatures' equal-bit
   counts, corrected for chance agreement, do not rule out the threshold. Buckets are cut by
   hash into blocks of about ``block`` classes, so no task holds a whole bucket; only
   signatures (some 50 bytes a class and bucket) move here.
4. First every class brings its best candidate among the smaller classes of its bucket blocks, one pair a
   class; a bucket's least class is in each of its blocks. These are confirmed on the full sets, in tiles, to
   which a text is sent once, and components of the confirmed links are made.
5. Then only buckets that still hold two components are met again, pair of blocks by pair of blocks: a
   tile first names its classes that have a candidate in another component, then gets their texts, and decides all such pairs on the
   full sets by bit counts over the shingles that two of its classes share. A pair is decided in the first of its common buckets alone.
   No row is made for a pair; a tile returns a spanning forest of its links between components.
6. Components of the confirmed links give the component ids. Classes with over 1/4096 of all rows, at most
   4096 of them, are joined to their documents by broadcast, so no exchange piles up a large class.

Documents are compared by sets of 64-bit shingle hashes: two different shingles of a pair agree by chance with
probability under 10**-9 for sets of 10**5, and then move the similarity by one shingle. Classes are told by 128 bits.

Defined cases: a document without words, or null, has the empty set and is linked with
nothing; fewer words than a shingle make one shingle; repeated rows are copies of each
other; rows with a null id take part, but never name a component, and texts that only rows without an id hold are
linked with their copies only; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, matched, small_batches, table, whole_groups, written
from .components import connected_components
from .textkit import lowered, mix64, slices, word_hashes

ROWS = 4
BITS = 2


def bands_for(threshold: float, miss: float = 1e-9) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h, off = word_hashes([lowered(t) for t in texts])
    out = []
    if len(h) >= words:
        rolled = np.zeros(len(h) - words + 1, np.uint64)
        for j in range(words):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - words + 1 + j])
    for i in range(len(texts)):
        lo, hi = int(off[i]), int(off[i + 1])
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            x = np.full(1, hi - lo, np.uint64)
            for j in range(lo, hi):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_by_bytes(texts: list[str | None], words: int, most: int = 1 << 20) -> list[np.ndarray]:
    """``shingle_sets`` of some ``most`` characters at a time."""
    out, at, size = [], 0, 0
    for k, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= most or k == len(texts):
            out += shingle_sets(texts[at:k], words)
            at, size = k, 0
    return out


def minima(shingles: np.ndarray, count: int, chunk: int = 8192) -> np.ndarray:
    """Minima of ``count`` multiply-add hashes of 32 bits."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, count, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, count, dtype=np.int64).astype(np.uint64)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), chunk):
        np.minimum(least, (shingles[lo : lo + chunk, None] * a + b).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def packed_bits(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima as rows of 64-bit words, one row for each bit."""
    count = -(-len(least) // 64) * 64
    low = np.zeros(count, np.uint32)
    low[: len(least)] = least
    return np.stack([np.packbits((low >> np.uint32(b)) & np.uint32(1), bitorder="little").view(np.uint64) for b in range(bits)])


def estimated(a: np.ndarray, b: np.ndarray, count: int, bits: int = BITS) -> np.ndarray:
    """Similarity of all rows of a (n, bits, words) to all of b, from equal low bits, corrected for chance equality."""
    differ = np.zeros((len(a), len(b), a.shape[2]), np.uint64)
    for i in range(bits):
        differ |= a[:, None, i] ^ b[None, :, i]
    equal = 1 - np.bitwise_count(differ).sum(2) / count
    by_chance = 1 / 2**bits
    return (equal - by_chance) / (1 - by_chance)


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int, count: int) -> DataFrame:
    """id, text_key, n, digest (null for the empty set), bands, sig."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=1 << 20):
            n, digests, bands, sigs = [], [], [], []
            for s in shingle_sets(part.column(2).to_pylist(), words):
                n.append(len(s))
                if not len(s):
                    digests, bands, sigs = [*digests, None], [*bands, None], [*sigs, None]
                    continue
                digests.append(_digest(s))
                least = minima(s, count)
                keys = least.reshape(-1, ROWS).astype(np.uint64)
                key = np.arange(count // ROWS, dtype=np.uint64)  # a band's number is part of its keys
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + keys[:, r] + np.uint64(1))
                bands.append(key.view(np.int64))
                sigs.append(packed_bits(least).tobytes())
            arrays = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text_key", "n", "digest", "bands", "sig"])

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {id_type}, text_key long, n long, digest binary, bands array<long>, sig binary")


def _digest(shingles: np.ndarray) -> bytes:
    x = mix64(shingles + np.uint64(0x51ED270B))
    return np.array([x.sum(dtype=np.uint64), mix64(x ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64).tobytes()


@lru_cache(maxsize=8)
def least_equal(count: int, share: float, missed: float = 1e-9) -> int:
    """The largest number of equal minima under which a pair with ``share`` of equal ones in the mean falls with probability ``missed`` at most."""
    below = 0.0
    for k in range(count + 1):
        below += math.comb(count, k) * share**k * (1 - share) ** (count - k)
        if below > missed:
            return k
    return count


def candidates(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, count: int, per_cent: int) -> np.ndarray:
    """Estimated similarity of all rows of a to all of b; -inf where the bits or the set sizes rule a link out."""
    t, by_chance = per_cent / 100, 1 / 2**BITS
    least = (least_equal(count, t + (1 - t) * by_chance) - 0.5) / count
    near = estimated(sig_a, sig_b, count)
    fits = 100 * np.minimum(n_a[:, None], n_b[None]) >= per_cent * np.maximum(n_a[:, None], n_b[None])
    return np.where((near >= (least - by_chance) / (1 - by_chance)) & fits, near, -np.inf)


def _unpacked(t: pa.Table) -> np.ndarray:
    flat = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64)
    return flat.reshape(t.num_rows, BITS, -1)


def _classes(sigs: DataFrame) -> DataFrame:
    """cid, digest, first_id, size, n, bands, sig of every set of shingles; cid numbers them, so keys are 8 bytes from here on."""
    by = sigs.where("digest is not null").groupBy("digest")
    found = by.agg(F.min("id").alias("first_id"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    return written(found.withColumn("cid", F.monotonically_increasing_id()))


def _members(classes: DataFrame, block: int) -> DataFrame:
    """key, cid, lead (least class of the bucket), blocks, tiles, n, sig: the classes of every bucket that two share."""
    buckets = classes.select("cid", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("cid").alias("lead")).where("m > 1")
    # Blocks are smaller where texts are long, so that a tile's sets stay small.
    cut = lambda many, heavy: F.ceil(F.greatest(F.col("m") / many, F.col("weight") / heavy)).cast("int")
    # Written, so that both sides of the join have an exchange of their own and a common bucket's side can be split.
    shared = written(shared.select("key", "lead", cut(block, 1 << 19).alias("blocks"), cut(128, 1 << 17).alias("tiles")))
    return written(buckets.drop("n").join(shared, "key").join(classes.select("cid", "n", "sig"), "cid"))


def _best(members: DataFrame, count: int, per_cent: int) -> DataFrame:
    """a, b, key, tiles: of each class the candidate of highest estimate among the smaller ones of its bucket blocks."""
    own = F.array(F.pmod(F.hash("cid", "key"), "blocks"))
    part = F.explode(F.when(F.col("cid") == F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own))
    rows = members.select("key", part.alias("part"), "cid", "tiles", "n", "sig")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in whole_groups(batches, ["key", "part"]):
            sig, n, cid = _unpacked(t), t.column("n").to_numpy(), t.column("cid").to_numpy()
            out = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                for a in range(lo, hi, 256):
                    b = min(a + 256, hi)
                    near = candidates(sig[a:b], n[a:b], sig[lo:b], n[lo:b], count, per_cent)
                    near[np.arange(lo, b)[None] >= np.arange(a, b)[:, None]] = -np.inf  # smaller classes only
                    at = near.argmax(1)
                    best = near[np.arange(b - a), at]
                    out.append((np.flatnonzero(best > -np.inf) + a, at[best > -np.inf] + lo, best[best > -np.inf]))
            i, j, est = (np.concatenate([x[k] for x in out]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(cid[i]), pa.array(cid[j]), pa.array(est), t.column("key").take(i).combine_chunks(), t.column("tiles").take(i).combine_chunks()], ["a", "b", "est", "key", "tiles"])

    found = grouped(rows, ["key", "part"], ["cid"]).mapInArrow(run, "a long, b long, est double, key long, tiles int")
    return found.groupBy("a").agg(F.max(F.struct("est", "b", "key", "tiles")).alias("x")).select("a", "x.b", "x.key", "x.tiles")


def _blocks_met(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """key, one, two, own, cid, comp, n, sig, bands: the classes of buckets that hold two components, for each pair of blocks (one, two) that their block is in."""
    seen = written(members.select("key", "cid", "blocks").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root"))
    open_keys = written(seen.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"))
    rows = seen.join(open_keys, "key").join(classes.select("cid", "n", "sig", "bands"), "cid")
    rows = rows.withColumn("own", F.pmod(F.hash("cid", "key"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "cid", "comp", "n", "sig", "bands")


class _Tile:
    """The rows of a pair of blocks, in ascending order of their block."""

    def __init__(self, t: pa.Table, lo: int, hi: int):
        part = t.slice(lo, hi - lo)
        self.key, two = part.column("key")[0].as_py(), part.column("two")[0].as_py()
        self.sig = _unpacked(part)
        self.n, self.cid, self.comp, own = (part.column(c).to_numpy() for c in ("n", "cid", "comp", "own"))
        bands = part.column("bands").combine_chunks()
        self.bands = bands.flatten().to_numpy().reshape(len(part), -1)
        # Rows of ``one`` come first; inside one block all meet all before them.
        self.split = int(np.searchsorted(own, two))

    def pairs(self, count: int, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs (i, j) of different components that have this bucket as the first in common."""
        whole = self.split == 0
        for a in range(self.split, len(self.cid), 256):
            b = min(a + 256, len(self.cid))
            end = b if whole else self.split
            near = candidates(self.sig[a:b], self.n[a:b], self.sig[:end], self.n[:end], count, per_cent) > -np.inf
            near &= self.comp[a:b][:, None] != self.comp[:end][None]
            if whole:
                near &= np.arange(end)[None] < np.arange(a, b)[:, None]
            i, j = np.nonzero(near)
            i += a
            for s in range(0, len(i), 1 << 16):
                x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                same = self.bands[x] == self.bands[y]
                first = self.bands[x, same.argmax(1)] == self.key
                if first.any():
                    yield x[first], y[first]


def _needed(met: DataFrame, count: int, per_cent: int) -> DataFrame:
    """key, one, two, own, cid, comp, n, sig, bands: the rows of ``met`` that have a candidate in their tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in whole_groups(batches, ["key", "one", "two"]):
            keep = np.zeros(t.num_rows, bool)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                for i, j in _Tile(t, lo, hi).pairs(count, per_cent):
                    keep[i + lo] = keep[j + lo] = True
            yield from t.filter(pa.array(keep)).to_batches(max_chunksize=20_000)

    return grouped(met, ["key", "one", "two"], ["own", "cid"]).mapInArrow(run, met.schema)


def shared_counts(sets: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], width: int = 1 << 14) -> list[np.ndarray]:
    """The number of common shingles of each pair, by bit counts over the shingles of two sets at least, ``width`` of them at a time."""
    out = [np.zeros(len(i), np.int64) for i, _ in pairs]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    known, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[times[code] > 1]
    at = place[code[times[code] > 1]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for lo in range(0, int((times > 1).sum()), width):
        s, e = np.searchsorted(at, [lo, lo + width])
        bits = np.zeros((len(sets), width), bool)
        bits[of[s:e], at[s:e] - lo] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for total, (i, j) in zip(out, pairs, strict=True):
            for p in range(0, len(i), 8192):
                total[p : p + 8192] += np.bitwise_count(packed[i[p : p + 8192]] & packed[j[p : p + 8192]]).sum(1, dtype=np.int64)
    return out


def spanning(pairs: Iterable[tuple]) -> list[int]:
    """Places of a forest among the pairs that has the same components."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(pairs):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def _between(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, needed: DataFrame, words: int, count: int, per_cent: int) -> DataFrame:
    """u, v: forests of the links between components, found in the tiles of ``needed``."""
    keys = ["key", "one", "two"]
    rows = _texts_of(docs, id_col, text_col, needed.join(classes.select("cid", "digest", "first_id"), "cid"))
    rows = rows.select(*keys, "own", "cid", "comp", "n", "sig", "bands", "digest", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in whole_groups(slices(batches, max_bytes=4 << 20), keys):
            u, v = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = t.slice(lo, hi - lo)
                sets = sets_by_bytes(part.column("text").to_pylist(), words)
                # An id may repeat with another text, whose set is not the class's, or with the same one.
                cid = part.column("cid").to_numpy()
                right = np.array([_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)])
                right &= np.concatenate(([True], cid[1:] != cid[:-1])) | ~np.concatenate(([False], right[:-1]))
                at = np.flatnonzero(right)
                if len(at) < 2:
                    continue
                tile = _Tile(part.take(at), 0, len(at))
                pairs = list(tile.pairs(count, per_cent))
                n = tile.n
                for (i, j), both in zip(pairs, shared_counts([sets[k] for k in at], pairs), strict=True):
                    ok = 100 * both >= per_cent * (n[i] + n[j] - both)
                    i, j = i[ok], j[ok]
                    kept = spanning(zip(tile.comp[i].tolist(), tile.comp[j].tolist(), strict=True))
                    u += tile.cid[i[kept]].tolist()
                    v += tile.cid[j[kept]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    with small_batches(docs.sparkSession):
        return written(grouped(rows, keys, ["own", "cid"]).mapInArrow(run, "u long, v long"))


def _texts_of(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the texts of their first_id."""
    rows = written(rows)
    texts = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text"))
    return matched(texts, rows, ["first_id"], "left_semi", stored=True).join(rows, "first_id")


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _confirmed(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, pairs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """u, v: the pairs (a, b, key, i, j) whose full sets are linked. A tile (key, i, j) gets each text that its pairs need once."""
    keys = ["key", "i", "j"]
    ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = _texts_of(docs, id_col, text_col, ends.join(classes.select("cid", "digest", "first_id"), "cid"))
    none = F.lit(None)
    rows = texts.select(*keys, F.lit(0).alias("kind"), F.col("cid").alias("a"), none.cast("long").alias("b"), "digest", "text")
    rows = rows.unionByName(pairs.select(*keys, F.lit(1).alias("kind"), "a", "b", none.cast("binary").alias("digest"), none.cast("string").alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in whole_groups(slices(batches, max_bytes=4 << 20), keys):
            kind, a, b = t.column("kind").to_numpy(), t.column("a").to_numpy(), t.column("b")
            u, v = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                cut = lo + int(np.searchsorted(kind[lo:hi], 1))  # texts, then pairs
                digests = t.column("digest").slice(lo, cut - lo).to_pylist()
                sets = shingle_sets(t.column("text").slice(lo, cut - lo).to_pylist(), words)
                # An id may repeat with another text, whose set is not the class's.
                of = {c: s for c, s, d in zip(a[lo:cut].tolist(), sets, digests, strict=True) if _digest(s) == d}
                for x, y in zip(a[cut:hi].tolist(), b.slice(cut, hi - cut).to_pylist(), strict=True):
                    if x in of and y in of and linked(of[x], of[y], per_cent):
                        u.append(x)
                        v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    with small_batches(docs.sparkSession):
        return written(grouped(rows, keys, ["kind", "a"]).mapInArrow(run, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per_cent: int = 80, block: int = 1024) -> DataFrame:
    """``id_col, text_key, n_shingles, component_id, component_key``: the least id reachable over links.

    Documents are linked when 100 * shared shingles >= ``per_cent`` * all shingles of the two. ``text_key`` is the xxhash64 of
    the text; ``component_key`` tells components apart where ids repeat, and is null for the empty set.
    """
    count = bands_for(per_cent / 100) * ROWS
    sigs = written(_signatures(docs, id_col, text_col, words, count))
    classes = _classes(sigs)
    members = _members(classes, block)
    tile = lambda c: F.pmod(F.hash(c), "tiles")
    tiled = lambda p: written(p.withColumns({"i": tile("a"), "j": tile("b")}))
    links = _confirmed(docs, id_col, text_col, classes, tiled(_best(members, count, per_cent)), words, per_cent)
    found = connected_components(links)
    needed = written(_needed(_blocks_met(members, classes, found), count, per_cent))
    if not needed.isEmpty():
        links = links.unionByName(_between(docs, id_col, text_col, classes, needed, words, count, per_cent))
        found = connected_components(links)
    named = classes.select("cid", "digest", "first_id", "size").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    named = written(named.withColumn("component_key", F.coalesce("root", "cid")).drop("root"))
    ids = named.groupBy("component_key").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes"))
    linked_ids = written(ids.where("classes > 1").drop("classes"))  # so that a component of many classes can be split
    named = named.join(linked_ids, "component_key", "left").withColumn("component_id", F.coalesce("component_id", "first_id"))
    per_class = written(named.select("digest", "size", "component_id", "component_key"))
    total = per_class.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large, small = (per_class.where(c).drop("size") for c in (F.col("size") * 4096 >= total, F.col("size") * 4096 < total))
    every = sigs.select("id", "text_key", "n", "digest")
    some = every.where("digest is not null").join(F.broadcast(large), "digest", "left")  # 4096 rows at most
    out = some.where("component_key is not null").unionByName(some.where("component_key is null").select(every.columns).join(small, "digest"))
    empty = every.where("digest is null").withColumns({"component_id": F.col("id"), "component_key": F.lit(None).cast("long")})
    out = out.unionByName(empty)
    return out.select(F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), "component_id", "component_key")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, per_cent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), g as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
  from w
), n as (
  select doc_id, count(*) as n from g group by doc_id
), e as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * i >= 85 * (na.n + nb.n - i)
), r as (
  select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b
), c as (
  select a as doc_id, min(b) as component_id from r group by a
)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents join c using (doc_id) left join n using (doc_id)
"""
