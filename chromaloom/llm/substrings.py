"""Operator 7: repeated passages by content-defined chunking with a gear rolling hash.

A 16-bit gear hash (each byte shifts the hash left and adds its table value, so it sees
the last sixteen bytes) is taken at every byte; a chunk ends where the hash is the least
of some window of ``window`` positions. Cuts depend on nearby bytes alone, so inserted
text moves no cut beyond its own neighbourhood, and a passage of ``18 + 2 * window``
bytes that stands in two documents has a whole chunk in common. 51 words take 101 bytes
at least, so a window of 40 leaves none out.

1. A chunk is known by a 64-bit digest; a chunk repeated in place, as in text of one word
   over and over, is one row, whatever the number of repeats. Digests are pre-aggregated to
   the least and greatest document id; those of two documents are joined back, a join that
   splits hot digests. The chunk rows are made again for the join rather than stored: they
   cost less to make than to write.
2. Common chunks only propose: around runs of them, widened by what a passage may have
   outside its whole chunks, every ``min_words`` consecutive words are hashed, byte for byte
   with what stands between them. Windows of one document with one hash that touch are one
   row. Hashes of two documents are found as in step 1, and the windows that have them are
   merged to spans. So a span is made of whole words, each in ``min_words`` that also stand in
   another document; blanks at an edge of a text belong to a span if they repeat as well.

Defined cases: null or empty texts have no chunks; repeats inside one document alone
do not count; equal documents of ``min_words`` repeat as a whole; rows with a null id are not compared and
come back without spans; rows that share an id are one document; extra columns are not
read; an empty table gives an empty result. Ids are whole numbers (others raise). Spans are code points, end exclusive.
A chunk or window is known by 64 bits: a span is false where two different ones of the corpus agree in
them, by chance once in 2 * 10**19 pairs, so a window of a corpus of 10**13 windows with probability 5 * 10**-7.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_shuffles, grouped, small_batches, table, unused, whole_groups, written
from .textkit import _powers, _space_table, mix64, segment_hashes, slices

GEAR_BITS = 16
_SPAN = "struct<start:long,end:long,first_id:long>"


#: Stands between the texts of a buffer; no byte of UTF-8, and nothing in a hash. Longer than a hash reaches.
_APART = b"\xff" * GEAR_BITS


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    values = np.random.default_rng(23).integers(0, 1 << 32, 256, dtype=np.uint32)
    values[_APART[0]] = 0
    return values.astype(np.uint16)


@lru_cache(maxsize=2)
def _order(bits: int) -> np.ndarray:
    """The place of every hash in the order in which least ones are taken, over ``bits`` bits for a position."""
    mixed = np.arange(1 << GEAR_BITS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    place = np.unique(mixed, return_inverse=True)[1].astype(np.uint64) << np.uint64(bits)
    return place if bits > 16 else place.astype(np.uint32)


def gear_hash(buf: np.ndarray) -> np.ndarray:
    """At every byte the gear hash of ``GEAR_BITS`` bits, by doubling the reach of partial sums."""
    h, reach = _gear()[buf], 1
    while reach < GEAR_BITS:
        h[reach:] += h[:-reach] << np.uint16(reach)
        reach *= 2
    return h


def _changes(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def cut_points(buf: np.ndarray, off: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Ascending positions at which a chunk begins inside one of the texts ``buf[off[i]:end[i]]``: least hashes of the windows in a text, moved on to the start of a character."""
    if len(buf) < window:
        return np.zeros(0, np.int64)
    inside = np.zeros(len(buf) - window + 1, bool)
    for lo, hi in zip(off.tolist(), end.tolist(), strict=True):
        inside[lo : max(lo, hi - window + 1)] = True
    # Among equal hashes the later position is taken.
    bits = 16 if window < 1 << 15 else 32
    key = _order(bits)[gear_hash(buf)]
    back = np.arange((1 << bits) - 1, (1 << bits) - 1 - min(len(buf), 1 << bits), -1).astype(key.dtype)
    cuts = []
    step = (1 << bits) - window
    for lo in range(0, len(inside), step):
        k = key[lo : lo + step + window - 1]
        k, reach = k | back[: len(k)], 1
        while reach * 2 <= window:
            k, reach = np.minimum(k[:-reach], k[reach:]), reach * 2
        if reach < window:
            k = np.minimum(k[: len(k) - (window - reach)], k[window - reach :])
        least = (k & k.dtype.type((1 << bits) - 1))[inside[lo : lo + step]]
        cuts.append(lo + (1 << bits) - least[_changes(least)].astype(np.int64))
    cut = np.concatenate(cuts)
    cut = cut[cut < len(buf)]
    while (later := (buf[cut] & 0xC0) == 0x80).any():
        cut = cut + later
        cut = cut[cut < len(buf)]
    cut = cut[_changes(cut)]
    return cut[cut < end[np.searchsorted(off, cut, "right") - 1]]


def chunks_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the chunks of the texts in order, the place of each one's text, and their starts and ends in code points of the text.

    Texts are cut together, as a text alone is too short for numpy to be quick; none has a say in another's chunks.
    """
    buf = np.frombuffer(_APART.join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate(([0], np.cumsum(size + len(_APART))[:-1]))
    full = np.flatnonzero(size)
    off, end = off[full], (off + size)[full]
    if not len(full):
        return np.zeros(0, np.uint64), full, full, full
    cut = cut_points(buf, off, end, window)
    start, stop = np.sort(np.concatenate((off, cut))), np.sort(np.concatenate((cut, end)))
    at = np.searchsorted(off, start, "right") - 1
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32))).astype(np.int64)
    before = points[off][at]
    return folded(segment_hashes(buf, start, stop, seed=29), full[at], points[start] - before, points[stop] - before)


def chunked(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the chunks of one text, and their starts and ends in code points."""
    digest, _, start, end = chunks_of([text], window)
    return digest, start, end


def folded(digests: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one chunk repeated in place as a single chunk with its own digest, so that runs of any number of repeats meet."""
    first = np.flatnonzero(_changes(digests) | _changes(at))
    return digests[first], at[first], start[first], end[np.append(first[1:], len(digests)) - 1]


def _batches(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Edges of runs of texts of about ``most`` bytes."""
    lo = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t)
        if size >= most or k == len(texts):
            yield lo, k
            lo, size = k, 0


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """digest, id, span: a row for each chunk; span holds the start in its high and the length in its low 32 bits."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text <> ''")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=1 << 20):
            ids, texts = part.column(0).to_numpy(), [t.encode("utf-8", "replace") for t in part.column(1).to_pylist()]
            for lo, hi in _batches(texts):
                digest, at, start, end = chunks_of(texts[lo:hi], window)
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(ids[lo:hi][at]), pa.array((start << 32) | (end - start))], ["digest", "id", "span"])

    return src.mapInArrow(run, "digest long, id long, span long")


def word_windows(text: bytes, hits: np.ndarray, window: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``min_words`` consecutive words near common chunks, and their starts and ends in code points.

    ``hits`` holds the chunks' starts in the high and their lengths in the low 32 bits.
    """
    buf = np.frombuffer(text, np.uint8)
    gap = _space_table(False)[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = len(starts) - min_words + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    lo, hi = points[starts[:n]], points[ends[min_words - 1 :]]
    # A passage has less than 16 + window bytes before its first whole chunk and than window after its last one; cuts move on to a character.
    hits = np.sort(hits)
    left, right = (hits >> 32) - (window + 20), np.maximum.accumulate((hits >> 32) + (hits & 0xFFFFFFFF)) + (window + 4)
    new = np.flatnonzero(np.concatenate(([True], (hits >> 32)[1:] > right[:-1] - (window + 4))))
    left, right = left[new], right[np.append(new[1:] - 1, len(hits) - 1)]
    # Widened runs ascend in both ends, so the last one that begins before a window is the one that reaches farthest.
    at = np.searchsorted(left, lo, "right") - 1
    near = np.flatnonzero((at >= 0) & (right[np.maximum(at, 0)] >= hi))
    # The first and the last window of a text once more with the blanks at its edge.
    first = near[:1] if len(near) and near[0] == 0 and starts[0] > 0 else near[:0]
    last = near[-1:] if len(near) and near[-1] == n - 1 and ends[-1] < len(buf) else near[:0]
    of_word = segment_hashes(buf, starts, ends, seed=31)
    # A word with the blanks up to the next one; the last word of a window counts without them.
    of_gap = segment_hashes(buf, ends[:-1], starts[1:], seed=37)
    key = mix64(of_word[:-1] * np.uint64(3) + of_gap)
    up, down = _powers(1 << len(key).bit_length())
    sums = np.zeros(len(key) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(key * up[: len(key)], out=sums[1:])
        h = (sums[near + min_words - 1] - sums[near]) * down[near]
        h = mix64(mix64(h) + of_word[near + min_words - 1])
        edges = []
        for pick, a, b, salt in ((first, 0, int(starts[0]), 41), (last, int(ends[-1]), len(buf), 43)):
            blank = segment_hashes(buf, np.array([a]), np.array([b]), seed=salt) if len(pick) else np.zeros(0, np.uint64)
            edges.append(mix64(h[np.searchsorted(near, pick)] * np.uint64(5) + blank))
    h = np.concatenate((h, *edges))
    lo = np.concatenate((lo[near], np.zeros(len(first), np.int64), lo[last]))
    hi = np.concatenate((hi[near], hi[first], np.full(len(last), points[-1])))
    # Overlapping windows of one hash, as in a line over and over, are one row.
    order = np.lexsort((lo, h))
    h, lo, hi = h[order], lo[order], hi[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (lo[1:] > hi[:-1]))))
    return h[new], lo[new], hi[np.append(new[1:], len(h))[: len(new)] - 1]


def _in_two(rows: DataFrame) -> DataFrame:
    """digest, first_id: the digests of two documents at least. Written, so that both sides of a join with them come by an exchange of their own and a hot digest's side can be split."""
    shared = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    found = written(shared.select("digest", "first_id"))
    drop_shuffles(rows.sparkSession)  # a row for each chunk or window, beside which the join would lay as many
    return found


def _windows(docs: DataFrame, chunks: DataFrame, id_col: str, text_col: str, window: int, min_words: int) -> DataFrame:
    """digest, id, span: the windows of words around common chunks."""
    near = chunks.join(_in_two(chunks), "digest").groupBy("id").agg(F.collect_list("span").alias("hits"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text <> ''")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=1 << 19):
            found = [word_windows(t.as_py().encode("utf-8", "replace"), x.values.to_numpy(), window, min_words) for t, x in zip(part.column(1), part.column(2), strict=True)]
            ids = np.repeat(part.column(0).to_numpy(), [len(x[0]) for x in found])
            digest, lo, hi = (np.concatenate([x[i] for x in found]) for i in range(3))
            for at in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (digest.view(np.int64), ids, (lo << 32) | (hi - lo))], ["digest", "id", "span"])

    # Written, as they are read twice and cost a shuffle of texts.
    return written(texts.join(near, "id").select("id", "text", "hits").mapInArrow(run, "digest long, id long, span long"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 40, min_words: int = 51) -> DataFrame:
    """``id_col, n_chars, spans``: of each document the passages of ``min_words`` words that also stand in another one, with the least id that holds a part of them."""
    if 18 + 2 * window > 2 * min_words - 1:
        raise ValueError(f"passages of {min_words} words may lie between chunks of window {window}")
    chunks = chunk_rows(docs, id_col, text_col, window)
    with small_batches(docs.sparkSession, 512):
        windows = _windows(docs, chunks, id_col, text_col, window, min_words)
        shared = _in_two(windows)
    spans = span_rows(windows.join(shared, "digest").select("id", "span", "first_id")).withColumnRenamed("id", "_id")
    all_docs = docs.select(F.col(id_col), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    out = all_docs.join(spans, F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")))


def merge_runs(ids: np.ndarray, span: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document that touch or overlap: ids, starts, ends, least first ids. Windows are sorted by id and span."""
    start, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
    # Documents are set apart by an offset over any end, so one running maximum serves them all.
    apart = np.cumsum(np.concatenate((np.zeros(min(1, len(ids)), np.int64), ids[1:] != ids[:-1]))) << 33
    far = np.maximum.accumulate(end + apart)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), bool), (start + apart)[1:] > far[:-1])))
    last = np.append(new[1:], len(ids))[: len(new)] - 1
    return ids[new], start[new], (far - apart)[last], np.minimum.reduceat(first, new) if len(new) else first


def span_rows(hits: DataFrame) -> DataFrame:
    """id, spans of windows (id, span, first_id): sorted rows are merged as they come, so no list of a document's windows is made, however many documents are copies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ["id"]):
            ids, start, end, first = merge_runs(*(t.column(c).to_numpy() for c in ("id", "span", "first_id")))
            edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            rows = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(first)], ["start", "end", "first_id"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[edge]), pa.ListArray.from_arrays(pa.array(np.append(edge, len(ids)).astype(np.int32)), rows)], ["id", "spans"])

    return grouped(hits, ["id"], ["span"]).mapInArrow(run, f"id long, spans array<{_SPAN}>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the passages taken out that also stand in a document of a smaller id; the smallest id keeps its text."""
    found = repeated_passages(docs, id_col, text_col, **how).where(F.size("spans") > 0)
    key, own = unused(docs, "_key"), unused(docs, "_spans")
    found = found.select(F.col(id_col).alias(key), F.filter("spans", lambda s: s["first_id"] < F.col(id_col)).alias(own)).dropDuplicates([key])
    text = F.col(text_col)

    def cut(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(own, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    out = docs.join(found, F.col(id_col) == F.col(key), "left").withColumn(text_col, F.when(F.size(own) > 0, rest).otherwise(text))
    return out.select(docs.columns)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["first_id"])), ",")
    return found.select("doc_id", (F.size("spans") > 0).alias("repeats"), F.size("spans").cast("long").alias("n_spans"), chars.alias("repeated_chars"), F.array_min(F.transform("spans", lambda s: s["first_id"])).alias("first_doc_id"), text.alias("spans"))
