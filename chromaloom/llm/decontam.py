"""Operator 8: benchmark decontamination by pigeonhole edit matching on words.

Words are runs of word characters of the lower-cased text. An item of m words may differ
from a passage by ``m // budget_divisor`` word edits; cut into one piece more than that, at
least one piece stands unchanged in any passage within the budget. Pieces are found
exactly by rolling hashes over the words of a document; around each hit, Myers'
bit-parallel recurrence gives the least edit distance of the item to any passage there.

The benchmark is the stated query set: it is cut by hash into blocks of about
``block_chars`` characters, and each block is one pass over the documents, without a shuffle of texts. The driver
holds one block at a time; of several blocks, each one's hits are written before the next is fetched, and
meet their documents by a key of id and text.

Defined cases: a null or empty document is clean; null or empty items, items of fewer than ``least_words``
words, and items without an id match nothing; an item of under five words allows no edit, so a one-word item marks
every document with that word unless ``least_words`` (1 by default) says otherwise;
repeated items count each by their id, repeated documents are searched each; ids of documents and items are of any type, null ids
of documents are carried through; extra columns are not read; empty tables give clean or no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import keep_rows, matched, table, unused, written
from .textkit import slices

_WORD = re.compile(r"\w+")
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def edit_end(pattern: dict, m: int, words: list) -> tuple[int, int]:
    """Least edit distance of a pattern of m words to any run of ``words``, and where the first such run ends (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(words):
        eq = pattern.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def pattern_bits(words: list) -> dict:
    bits: dict = defaultdict(int)
    for i, w in enumerate(words):
        bits[w] |= 1 << i
    return dict(bits)


class Matcher:
    """Pieces of a block of items, and the search for them in documents."""

    def __init__(self, items: list[tuple], budget_divisor: int, least_words: int = 1):
        rng = np.random.default_rng(11)
        self.vocab: dict[str, int] = {}
        self.items = []
        pieces = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            if len(words) < max(1, least_words):
                continue
            ids = [self.vocab.setdefault(w, int(rng.integers(1, 2**62))) for w in words]
            m = len(ids)
            k = m // budget_divisor
            n = len(self.items)
            self.items.append((item_id, m, k, pattern_bits(ids), pattern_bits(ids[::-1])))
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces[hi - lo][int(self._rolling(np.asarray(ids[lo:hi], np.uint64), np.zeros(1, np.int64), hi - lo)[0])].append((n, lo))
        self.lengths = {length: (np.sort(np.fromiter(found, np.uint64, len(found))), dict(found)) for length, found in pieces.items()}

    @staticmethod
    def _rolling(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(length):
            h = h * np.uint64(_MULTIPLIER) + ids[at + j]
        return h

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """The items found in each text, with the least distance and the words it spans."""
        get = self.vocab.get
        ids, starts = [], [0]
        for t in texts:
            ids += [get(w, 0) for w in words_of(t)]
            ids.append(0)  # no piece crosses from one text to the next
            starts.append(len(ids))
        flat = np.asarray(ids, np.uint64)
        at_zero = np.where(flat == 0, np.arange(len(flat)), len(flat))
        run = np.minimum.accumulate(at_zero[::-1])[::-1] - np.arange(len(flat))
        bounds = np.asarray(starts)
        hits = set()
        for length, (known, where) in self.lengths.items():
            at = np.flatnonzero(run >= length)
            if not len(at):
                continue
            h = self._rolling(flat, at, length)
            ok = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            of = np.searchsorted(bounds, at[ok], "right") - 1
            for d, a, x in zip(of.tolist(), at[ok].tolist(), h[ok].tolist(), strict=True):
                hits.update((d, n, a - lo) for n, lo in where[x])
        out: list[dict] = [{} for _ in texts]
        for d, n, begin in sorted(hits):
            self._verify(out[d], bounds[d], bounds[d + 1] - 1, ids, n, begin)
        return [list(x.values()) for x in out]

    def _verify(self, found: dict, start: int, stop: int, ids: list[int], n: int, begin: int) -> None:
        """Compares item n with the words around a piece hit that puts its first word at ``begin``."""
        item_id, m, k, bits, back = self.items[n]
        seen = found.get(n)
        if seen and seen["distance"] == 0:
            return
        lo, hi = max(int(start), begin - k), min(int(stop), begin + m + k)
        distance, end = edit_end(bits, m, ids[lo:hi])
        if distance <= k and (seen is None or distance < seen["distance"]):
            _, length = edit_end(back, m, ids[lo : lo + end][::-1])
            found[n] = {"item_id": item_id, "distance": distance, "first_word": lo + end - length - int(start), "last_word": lo + end - 1 - int(start)}


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about ``block_chars`` characters the distinct items make (one, if empty, at least), and the blocks one by one."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, ([tuple(r) for r in items.where(part == b).distinct().orderBy("item_id", "text").collect()] for b in range(blocks))


def _with_keys(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str]) -> DataFrame:
    return docs.withColumns({names[0]: F.xxhash64(id_col, text_col), names[1]: F.coalesce(F.crc32(text_col), F.lit(-1))})


def _searched(src: DataFrame, block: list[tuple], hits: str, how: tuple[int, int], only_hits: bool) -> DataFrame:
    """The columns of ``src`` but its last, text, and the leaks of that text; ``only_hits`` leaves out rows without one."""
    names = src.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, *how)
        kind = pa.list_(pa.struct([("item_id", item_type), ("distance", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        for part in slices(batches, max_bytes=2 << 20):
            found = matcher.search(part.column(len(names)).to_pylist())
            out = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], [*names, "leaks"])
            yield out.filter(pa.array([bool(x) for x in found])) if only_hits else out

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names)
    item_type = to_arrow_type(StructType.fromDDL(f"leaks {hits}")["leaks"].dataType.elementType["item_id"].dataType)
    return src.mapInArrow(run, f"{kinds}, leaks {hits}")


def _hits_of_blocks(docs: DataFrame, blocks: Iterator[list[tuple]], id_col: str, text_col: str, hits: str, how: tuple[int, int]) -> DataFrame:
    """k1, k2, leaks: the documents with a leak, by key, one row for each block that hits them."""
    keyed = _with_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", ("k1", "k2")).select("k1", "k2", "text")
    out = None
    for block in blocks:
        part = written(_searched(keyed, block, hits, how, True).dropDuplicates(["k1", "k2"]))
        out = part if out is None else out.unionByName(part)
    return out


def _hits(benchmark: DataFrame, item_col: str) -> str:
    return f"array<struct<item_id:{benchmark.schema[item_col].dataType.simpleString()},distance:int,first_word:int,last_word:int>>"


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", budget_divisor: int = 5, block_chars: int = 4 << 20, least_words: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark."""
    n, blocks = item_blocks(benchmark, item_col, item_text_col, block_chars)
    how = (budget_divisor, least_words)
    if n > 1:
        found = _hits_of_blocks(docs, blocks, id_col, text_col, _hits(benchmark, item_col), how)
        k1 = unused(docs, "k1")
        k2 = unused(docs.withColumn(k1, F.lit(0)), "k2")
        keyed = _with_keys(docs, id_col, text_col, (k1, k2))
        return matched(keyed, found.select(F.col("k1").alias(k1), F.col("k2").alias(k2)), [k1, k2], "left_anti").select(docs.columns)
    block = next(blocks)

    def clean(texts: list, built: list = []) -> list[bool]:  # noqa: B006  built: once a task
        if not built:
            built.append(Matcher(block, *how))
        return [not found for found in built[0].search(texts)]

    return keep_rows(docs, text_col, clean)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", budget_divisor: int = 5, block_chars: int = 4 << 20, least_words: int = 1) -> DataFrame:
    """``id_col`` and ``leaks``: the items of which the document holds a passage within the edit budget."""
    n, blocks = item_blocks(benchmark, item_col, item_text_col, block_chars)
    hits, how = _hits(benchmark, item_col), (budget_divisor, least_words)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if n == 1:
        return _searched(src, next(blocks), hits, how, False).select(F.col("id").alias(id_col), "leaks")
    found = _hits_of_blocks(docs, blocks, id_col, text_col, hits, how)
    found = written(found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("leaks")).alias("leaks")))
    out = _with_keys(src, "id", "text", ("k1", "k2")).select("id", "k1", "k2").join(found, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("leaks", F.array().cast(hits)).alias("leaks"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("distance"))
