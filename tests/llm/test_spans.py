"""Merging of windows to spans: against a slow loop, and without lists of windows in Python's memory."""

import io
from contextlib import redirect_stdout

import numpy as np

from chromaloom.llm.substrings import merge_runs, repeated_passages, span_rows


def slow(rows):
    out = []
    for i, span, first in sorted(rows):
        start, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
        if out and out[-1][0] == i and start <= out[-1][2]:
            out[-1][2:] = [max(end, out[-1][2]), min(first, out[-1][3])]
        else:
            out.append([i, start, end, first])
    return [tuple(x) for x in out]


def test_runs_like_a_slow_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (int(s) << 32) | int(n), int(f)) for i, s, n, f in zip(rng.integers(-3, 60, 30_000), rng.integers(0, 300_000, 30_000), rng.integers(0, 90, 30_000), rng.integers(0, 99, 30_000), strict=True)]
    want = slow(rows)
    got = merge_runs(*(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)))
    assert list(zip(*(a.tolist() for a in got), strict=True)) == want
    found = span_rows(spark.createDataFrame(rows, "id long, span long, first_id long")).collect()
    assert sorted((r.id, s.start, s.end, s.first_id) for r in found for s in r.spans) == want and len(found) == 63


def test_no_list_of_windows_goes_to_python(spark):
    """Ten thousand documents' windows as Python objects took more memory than an executor has."""
    words = " ".join(f"word{i}" for i in range(200))
    found = repeated_passages(spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string"))
    said = io.StringIO()
    with redirect_stdout(said):
        found.explain()
    assert "ArrowEvalPython" not in said.getvalue() and "collect_list" not in said.getvalue()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()} == {i: [(0, len(words), 1)] for i in (1, 2)}
