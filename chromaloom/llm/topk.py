"""Operator 9: exact top-k by inner product with a pivot table.

Vectors are rows of integers floor(64 x). Pivots are spread rows of a bounded sample
(``sample`` rows by hash, farthest first); every row gets its distances to all pivots.
For a query q and a row x the largest |d(q, p) - d(x, p)| is a lower bound on d(q, x), so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound on their inner product. Rows are
evaluated in bound order until the k-th score exceeds every bound that is left.

The query set (ids divisible by ``every``) is cut into blocks of bounded size by hash, and
so are the rows of each task; a task meets one pair of blocks at a time, keeps k rows a
query, and a ranked window merges them. Query blocks are broadcast only while they are
under ``broadcast_bytes`` in all; beyond that the blocks meet in a shuffled join keyed by
query block and row group from both sides, so no task reads a whole side.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; every other row counts, so a row that stands twice is a candidate of its
twin and, as a query, answers twice; vectors meet only those of their length; ties go to the
smaller id; an empty table gives an empty result; extra columns are not read. Ids are whole
numbers (others raise); components must stay under 2**31 after scaling (others raise).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

_BLOCK = "dim int, n int, ids binary, rows binary, vectors binary"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``id``, ``row`` (a number of its own) and ``v``, an array of int, of the rows that take part; written, so that the numbers stay."""
    sound = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    sound_rows = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    return written(sound_rows.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v")))


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """For each vector length, rows of the sample chosen farthest first. The sample is the ``sample`` rows of least hash."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    by_dim: dict[int, list[list[int]]] = {}
    for r in got:
        by_dim.setdefault(len(r.v), []).append(r.v)
    out = {}
    for dim, rows in by_dim.items():
        x = np.unique(np.asarray(rows, np.float64).reshape(len(rows), dim), axis=0)
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(pivots, len(x)):
            far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
            chosen.append(int(far.argmax()))
        out[dim] = x[chosen]
    return out


def _packed(dim: int, ids: np.ndarray, rows: np.ndarray, v: np.ndarray) -> dict:
    return {"dim": dim, "n": len(ids), "ids": ids.astype(np.int64).tobytes(), "rows": rows.astype(np.int64).tobytes(), "vectors": v.astype(np.int32).tobytes()}


def _unpacked(dim: int, n: int, ids: bytes, rows: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(vectors, np.int32).reshape(n, dim)


def top_of_block(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_ids: np.ndarray, x_rows: np.ndarray, pivots: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (place of the query, row id, score) of a block of rows for each query; fewer only if the block has fewer."""
    dim = x.shape[1]
    exact = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0))) ** 2 * max(dim, 1) < 2**52
    xs, qs = (x.astype(np.float64), q.astype(np.float64)) if exact else (x.astype(np.int64), q.astype(np.int64))
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    x2, q2 = (xf**2).sum(1), (qf**2).sum(1)
    to_pivots = lambda a, a2: np.sqrt(np.maximum(0, a2[:, None] + (pivots**2).sum(1)[None] - 2 * a @ pivots.T)).astype(np.float32)
    xp, qp = np.ascontiguousarray(to_pivots(xf, x2).T), to_pivots(qf, q2)
    out: list[tuple[int, int, int]] = []
    order_all = np.lexsort((x_ids,))
    for i in range(len(q)):
        low = np.zeros(len(x), np.float32)
        for p in range(len(pivots)):
            np.maximum(low, np.abs(xp[p] - qp[i, p]), out=low)
        whole = q2[i] + x2
        # The slack covers the rounding of the distances; a bound never falls under the true score.
        bound = (whole - np.maximum(0, low * (1 - 1e-5) - 1e-2).astype(np.float64) ** 2) / 2 + 1
        bound[x_rows == q_rows[i]] = -np.inf
        scores = np.full(len(x), np.iinfo(np.int64).min)
        done, want, floor = np.zeros(len(x), bool), 4 * k, -np.inf
        while True:
            left = ~done & (bound >= floor) & (bound > -np.inf)
            at = np.flatnonzero(left)
            if not len(at):
                break
            if want < len(at) <= 8 * want or want < len(at) // 8:
                at = at[np.argpartition(-bound[at], want)[:want]]
            scores[at] = xs @ qs[i] if len(at) == len(x) else xs[at] @ qs[i]
            done[at] = True
            want *= 8
            seen = np.flatnonzero(done)
            if len(seen) >= k:
                floor = float(np.partition(scores[seen], len(seen) - k)[len(seen) - k])
        seen = order_all[done[order_all] & (bound[order_all] > -np.inf)]
        best = seen[np.argsort(-scores[seen], kind="stable")[:k]]
        out += [(i, int(x_ids[j]), int(scores[j])) for j in best]
    return out


def exact_top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, pivots: int = 24, sample: int = 2048, query_block: int = 1024, row_block: int = 8192, broadcast_bytes: int = 32 << 20, group_rows: int = 1 << 17) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of highest score, ties to the smaller id."""
    vectors = integer_vectors(rows, id_col, vector_col)
    tables = choose_pivots(vectors, pivots, sample)
    queries = vectors.where(F.col("id") % every == 0)
    total = vectors.count()
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // query_block))

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in pdf.groupby(pdf["v"].map(len)):
            out.append(_packed(int(dim), part["id"].to_numpy(), part["row"].to_numpy(), np.stack(part["v"].to_list()).reshape(len(part), int(dim))) | {"qb": int(pdf["qb"].iloc[0])})
        return pd.DataFrame(out, columns=["qb", "dim", "n", "ids", "rows", "vectors"])

    def pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            return pa.RecordBatch.from_pylist([_packed(dim, *(np.concatenate([p[i] for p in parts]) for i in range(3)))], schema=pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "vectors"))]))

        for batch in batches:
            ids, numbers, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            values, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for dim in np.unique(sizes):
                rows_at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(rows_at), row_block):
                    sel = rows_at[lo : lo + row_block]
                    held.setdefault(int(dim), []).append((ids[sel], numbers[sel], values[starts[sel][:, None] + np.arange(dim)[None]]))
                    if sum(len(p[0]) for p in held[int(dim)]) >= row_block:
                        yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q_rows, q = _unpacked(r["dim"], r["qn"], r["q_ids"], r["q_rows"], r["q_vectors"])
                x_ids, x_rows, x = _unpacked(r["dim"], r["n"], r["ids"], r["rows"], r["vectors"])
                got = top_of_block(q, q_rows, x, x_ids, x_rows, tables.get(r["dim"], np.zeros((0, r["dim"]))), k)
                at, ids, scores = (np.array(c, np.int64) for c in (zip(*got, strict=True) if got else ([], [], [])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_rows[at], q_ids[at], ids, scores)], ["query_row", "query_id", "vec_id", "score"])

    q_blocks = queries.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("qb")).groupBy("qb").applyInPandas(pack_queries, f"qb int, {_BLOCK}")
    q_blocks = q_blocks.select("qb", "dim", F.col("n").alias("qn"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "vectors")])
    packed = vectors.mapInArrow(pack_rows, _BLOCK).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if n * (width + 4) * 4 <= broadcast_bytes:
        met = packed.join(F.broadcast(q_blocks), ["qb", "dim"])
    else:
        groups = max(1, -(-total // group_rows))
        packed = packed.withColumn("rb", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int"))
        q_blocks = q_blocks.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        met = packed.join(q_blocks, ["qb", "rb", "dim"]).drop("rb")
    best = met.drop("qb").select("dim", "n", "ids", "rows", "vectors", "qn", "q_ids", "q_rows", "q_vectors").mapInArrow(meet, "query_row long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, x.vec_id as vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v q join v x on x.r <> q.r and len(q.v) = len(x.v)
  where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
