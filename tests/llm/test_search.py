"""Repeated passages, benchmark leaks and top-k search."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from chromaloom.llm import decontam, substrings, topk

from ..conftest import SF
from .cases import ODD, as_docs, odd_docs


def text(rng, n):
    return " ".join("".join(rng.choice("abcdeéghi") for _ in range(rng.randint(1, 11))) for _ in range(n))


def test_gear_hash_rolls():
    b = text(random.Random(1), 60).encode()
    h, want = 0, []
    for x in b:
        h = (h << 1) + int(substrings._gear()[x]) & 0xFFFF
        want.append(h)
    assert substrings.gear_hash(np.frombuffer(b, np.uint8)).tolist()[16:] == want[16:]


@pytest.mark.parametrize("t", ["a", "é" * 500, "ab" * 3000, text(random.Random(2), 300), "x" * 100_000])
def test_chunks_tile_the_text(t):
    d, start, end = substrings.chunked(t.encode(), 64)
    assert start[0] == 0 and end[-1] == len(t) and (start[1:] == end[:-1]).all() and len(d) == len(start)


@pytest.mark.parametrize("window", [40, 40_000])
def test_texts_chunked_together_are_as_alone(window):
    rng = random.Random(7)
    texts = [text(rng, rng.randint(0, 120)) for _ in range(60)] + ["", "é" * 19, "é" * 20, "ab" * 90, "日本語" * 200, text(rng, 20_000), "x" * 70_000, ""]
    texts = [t.encode() for t in texts]
    digest, at, start, end = substrings.chunks_of(texts, window)
    alone = [substrings.chunked(t, window) for t in texts]
    assert at.tolist() == [i for i, x in enumerate(alone) for _ in x[0]]
    for k, got in enumerate((digest, start, end)):
        assert got.tolist() == [v for x in alone for v in x[k].tolist()]
    for t in texts[:60]:  # cuts by their definition
        h = substrings.gear_hash(np.frombuffer(t, np.uint8)).tolist()
        mixed = [x * 0x9E3779B97F4A7C15 % 2**64 >> 24 for x in h]
        cuts = {max(range(i, i + window), key=lambda p: (-mixed[p], p)) + 1 for i in range(len(t) - window + 1)}
        while moved := {c for c in cuts if c < len(t) and t[c] & 0xC0 == 0x80}:
            cuts = cuts - moved | {c + 1 for c in moved}
        got = substrings.cut_points(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), window)
        assert got.tolist() == sorted(c for c in cuts if c < len(t))


def test_insertion_moves_few_cuts():
    rng = random.Random(3)
    t = text(rng, 2000)
    a, b = ({t2[s:e] for s, e in zip(*substrings.chunked(t2.encode(), 64)[1:], strict=True)} for t2 in (t, t[:5000] + "INSERTED" + t[5000:]))
    assert len(a - b) <= 6


def test_lines_repeated_unlike_often_share_chunks():
    for line in ("a line of thirty-two characters.\n", "w ", "a line of about sixty characters, period and all, no longer.\n"):
        (a, start, end), (b, *_) = (substrings.chunked((line * n).encode(), 64) for n in (90, 91))
        assert a[np.argmax(end - start)] in b  # the run of the repeated chunk


def test_passages_over_fifty_words(spark):
    rng = random.Random(5)
    passages = [text(rng, 51 + i) for i in range(20)]
    docs, has = [], {}
    for i in range(160):
        t = text(rng, rng.randint(5, 150))
        if rng.random() < 0.4:
            has[i] = rng.randrange(20)
            j = rng.randint(0, len(t))
            t = f"{t[:j]} {passages[has[i]]} {t[j:]}"
        docs.append((i, t + " A common line of thirteen words that many documents share here, no?"))
    n = Counter(has.values())
    for r in substrings.repeated_passages(as_docs(spark, docs)).collect():
        assert bool(r.spans) == (r.doc_id in has and n[has[r.doc_id]] > 1)
        for s in r.spans:
            assert any(docs[r.doc_id][1][s.start : s.end] in t for i, t in docs if i != r.doc_id)


def test_substrings_odd_rows(spark):
    found = substrings.repeated_passages(odd_docs(spark)).collect()
    assert len(found) == len(ODD) and not any(r.spans for r in found)
    twice = substrings.repeated_passages(as_docs(spark, [(1, "w " * 3000), (2, "w " * 3000), (3, None)])).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in twice} == {1: [(0, 6000)], 2: [(0, 6000)], 3: []}
    assert substrings.repeated_passages(as_docs(spark, []).limit(0)).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        substrings.repeated_passages(spark.createDataFrame([("a", "x y")], "doc_id string, text string")).count()
    assert substrings.op7_substrings(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_repeats_taken_out(spark):
    rng = random.Random(6)
    p, a, b = text(rng, 70), text(rng, 40), text(rng, 40)
    docs = as_docs(spark, [(1, f"{a} {p}"), (2, f"{b} {p} {a[:20]}"), (3, None)]).selectExpr("*", "'x' as _key", "'y' as _spans", "'z' as spans")
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns and {(r._key, r._spans, r.spans) for r in left.collect()} == {("x", "y", "z")}
    got = {r.doc_id: r.text for r in left.collect()}
    assert got[1] == f"{a} {p}" and got[3] is None and got[2].startswith(b[:-20]) and len(got[2]) < len(b) + 180 and got[2].endswith(a[:20])


def spans_by_brute_force(docs, n=51):
    """Spans of the words that stand in ``n`` consecutive ones, blanks between them included, that another document has too."""
    found = {}
    for i, t in docs:
        w = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        found[i] = [(w[j][0], w[j + n - 1][1]) for j in range(len(w) - n + 1)]
    held = {}
    for i, t in docs:
        for s, e in found[i]:
            held.setdefault(t[s:e], set()).add(i)
    out = {}
    for i, t in docs:
        out[i] = []
        for s, e in found[i]:
            if len(held[t[s:e]]) > 1:
                if out[i] and s <= out[i][-1][1]:
                    out[i][-1] = (out[i][-1][0], e)
                else:
                    out[i].append((s, e))
    return out


def spans_found(spark, docs):
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substrings.repeated_passages(as_docs(spark, docs)).collect()}


def test_passages_like_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 1, 1, 2, 3])))
    docs = []
    for i in range(0, 300, 2):
        p = " ".join(word() for _ in range(rng.choice([50, 51, 51, 51, 52, 70])))
        docs += [(i + j, f"{text(rng, rng.randint(1, 60))} {p} {text(rng, rng.randint(1, 60))}") for j in range(2)]
    want = spans_by_brute_force(docs)
    assert sum(bool(x) for x in want.values()) > 200 and not all(want.values())
    assert spans_found(spark, docs) == want


def test_lines_repeated_unlike_often(spark):
    rng = random.Random(9)
    docs = []
    for k, size in enumerate([2, 33, 60, 64, 90]):
        line = (" ".join(rng.choice("abcde") * rng.randint(1, 4) for _ in range(40)))[: size - 1].strip() + "\n"
        docs += [(10 * k + j, f"{text(rng, 30)}\n{line * n}{text(rng, 30)}") for j, n in enumerate((60, 61))]
    want = spans_by_brute_force(docs)
    assert all(want.values())
    assert spans_found(spark, docs) == want


def test_passages_of_documents_like_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").collect()]
    want, got = spans_by_brute_force(docs), spans_found(spark, docs)
    edge = lambda t, s, e: (0 if not t[:s].strip(" \t\n\v\f\r") else s, len(t) if not t[e:].strip(" \t\n\v\f\r") else e)
    texts = dict(docs)
    assert got.keys() == want.keys() and any(want.values())
    for i in got:
        assert [edge(texts[i], *x) for x in got[i]] == [edge(texts[i], *x) for x in want[i]]


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_like_the_table():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ([rng.choice("abcdef") for _ in range(n)] for n in (rng.randint(1, 20), rng.randint(0, 40)))
        assert decontam.edit_end(decontam.pattern_bits(p), len(p), t)[0] == distance(p, t)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_leaks_like_brute_force(spark, block):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "solo"), (None, "w1 w2 w3")]
    docs = [(0, None), (1, ""), (2, "Solo!"), (3, "x " * 3000)]
    for i in range(4, 80):
        w, q = [rng.choice(vocab) for _ in range(rng.randint(0, 60))], decontam.words_of(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 6)):
            if q:
                j, kind = rng.randrange(len(q)), rng.random()
                q = q[:j] + (["zz"] if kind < 0.3 else [] if kind < 0.6 else ["yy", q[j]]) + q[j + 1 :]
        j = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:j] + q + w[j:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = {r.doc_id for r in decontam.without_leaks(as_docs(spark, docs), bench, block_chars=block).collect()}
    for r in decontam.find_leaks(as_docs(spark, docs), bench, block_chars=block).collect():
        t = decontam.words_of(docs[r.doc_id][1])
        want = {}
        for i, x in items:
            p = decontam.words_of(x)
            if i is not None and p and t and distance(p, t) <= len(p) // 5:
                want[i] = distance(p, t)
        assert {x.item_id: x.distance for x in r.leaks} == want
        assert (r.doc_id in clean) == (not want)


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(1, "One, two three four FIVE")], "item_id long, text string")
    found = decontam.find_leaks(odd_docs(spark), bench)
    assert found.count() == len(ODD) and {r.doc_id for r in found.where("size(leaks) > 0").collect()} == {4, 5, 6}
    assert decontam.find_leaks(odd_docs(spark), bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontam.find_leaks(as_docs(spark, []).limit(0), bench).count() == 0
    one = spark.createDataFrame([("a", "the"), ("b", "other words")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "in the house"), ("y", "no"), (None, "The"), ("x", "in the house")], "doc_id string, text string")
    for block in (8, 1 << 20):
        assert sorted((str(r.doc_id), [x.item_id for x in r.leaks]) for r in decontam.find_leaks(docs, one, block_chars=block).collect()) == [("None", ["a"]), ("x", ["a"]), ("x", ["a"]), ("y", [])]
        assert decontam.find_leaks(docs, one, block_chars=block, least_words=2).where("size(leaks) > 0").isEmpty()
        clash = docs.selectExpr("doc_id", "text", "1 as k1", "2 as K2", "3 as leaks", "4 as id")
        left = decontam.without_leaks(clash, one, block_chars=block)
        assert left.columns == clash.columns and [tuple(r) for r in left.collect()] == [("y", "no", 1, 2, 3, 4)]


def test_decontam_query_like_brute_force(spark):
    bench = {r.item_id: decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = decontam.op8_decontam(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        t = decontam.words_of(texts[r.doc_id])
        want = {i: d for i, p in bench.items() if t and set(p) & set(t) and (d := distance(p, t) if len(set(p) & set(t)) > len(set(p)) // 2 else 99) <= len(p) // 5}
        assert r.contaminated == bool(want) and r.item_ids == sorted(want) and r.distance == min(want.values(), default=None)


def test_top_k_like_sql(spark):
    rows = [(i, None if i % 7 == 0 else [float(j * i % 5) / 3 for j in range(3 if i % 5 else 4)]) for i in range(130)]
    rows += [(140, [float("nan")]), (160, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0]), (1000, []), (1020, []), (1040, [float("inf")] * 3), (21, rows[21][1]), (40, rows[40][1]), (20, [5.0, 5.0, 5.0])]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.exact_top_k(df, row_block=16, query_block=2).collect())
    assert got == sorted(con.execute(topk.OP9_SQL).fetchall())
    joined = topk.exact_top_k(df, row_block=16, query_block=2, broadcast_bytes=0, group_rows=20)
    assert sorted(tuple(r) for r in joined.collect()) == got
    assert topk.exact_top_k(df.limit(0)).count() == 0
    clash = df.selectExpr("vec_id", "embedding", "'x' as id", "'x' as v", "'x' as row", "'x' as score", "'x' as qb")
    assert sorted(tuple(r) for r in topk.exact_top_k(clash).collect()) == got
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        topk.exact_top_k(df.selectExpr("'a' as vec_id", "embedding")).count()


def test_equal_rows_are_candidates_of_each_other(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.exact_top_k(df).collect())
    assert got == sorted([(20, 1, 20, 8192), (20, 2, 1, 4096), (20, 3, 1, 4096)] * 2)


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (6, 8))
    x = centres[rng.integers(0, 6, 4000)] + rng.integers(-3, 4, (4000, 8))
    ids = rng.permutation(4000)
    got = topk.top_of_block(x[:5], ids[:5], x, ids, ids, x[:24].astype(float), 20)
    for i in range(5):
        s = x @ x[i]
        want = sorted((-int(s[j]), int(ids[j])) for j in range(4000) if ids[j] != ids[i])[:20]
        assert [(-c, b) for a, b, c in got if a == i] == want


def test_substring_query_like_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = spans_by_brute_force(docs)
    rows = substrings.op7_substrings(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        spans = [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]
        assert r.repeats == bool(want[r.doc_id]) and r.n_spans == len(want[r.doc_id]) == len(spans)
        assert r.repeated_chars == sum(e - s for s, e, _ in spans) and r.first_doc_id == min((f for *_, f in spans), default=None)
