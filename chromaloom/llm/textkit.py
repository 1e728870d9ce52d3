"""Vectorised word handling shared by the text operators.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z only,
so ``bytes.lower`` is right: it leaves every byte of a multi-byte character alone.
A word is identified by a 64-bit polynomial hash over a fixed random byte table,
finished with a bijective mixer; the same word has the same hash on every executor.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20


@lru_cache(maxsize=4)
def _byte_table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse."""
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=2)
def _space_table(bare: bool) -> np.ndarray:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    if bare:
        space[[b for b in range(128) if not chr(b).isalnum()]] = True
    return space


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hashes of ``buf[starts[i]:ends[i]]``; the slices ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    table, i = _byte_table(seed), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(max(_SEGMENT, 1 << (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix64(out)


def word_hashes(texts: list[bytes], seed: int = 7, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and offsets: the words of text i are ``[off[i]:off[i + 1]]``.

    With ``bare``, ASCII punctuation parts words as well.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _space_table(bare)[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return segment_hashes(buf, starts, ends, seed), np.searchsorted(starts, first)


def trim() -> None:
    """Gives memory that an earlier task of this Python worker freed back to the system; workers are reused."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice has about ``max_bytes`` of text; a longer text is alone."""
    trim()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        at = 0
        while at < len(sizes):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + max_rows]), max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end
