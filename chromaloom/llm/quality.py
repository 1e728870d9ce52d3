"""Operator 6: quality by positive-unlabelled learning with the non-negative risk estimator.

Positives are rows labelled 1, of which at most ``sample`` are taken, those of least hash; unlabelled text is
every document without a label, all of them. Labels of 0 are never learnt from. With the logistic loss l and scores g the model minimises

    prior * mean_P l(g, +1) + max(0, mean_U l(g, -1) - prior * mean_P l(g, -1)),

and where the second term would turn negative its gradient is taken back instead. The
model is additive: each shape feature of the text (shares of character classes, word
lengths, repetition) is cut into bins at quantiles, half by positives and half by all unlabelled
documents, and each bin has a weight.

The unlabelled side is dealt by hash to shards of about ``sample`` rows of bin numbers. Each shard minimises the
risk of all positives and its own rows, and the weights are the shards' mean; nothing but sums of fixed size
leaves the shards. The class prior is estimated from positives and unlabelled rows alone: in each shard
a classifier tells the two apart on four fifths, and on the last fifth the share of unlabelled rows above a
score is set against the share of positives; the least ratio over all scores is the prior, as no more
than all of the unlabelled rows above a score can be positives.

Every document's features are made once, in one pass without a shuffle, and written. Every document is scored whole; labels, language,
source and id are no inputs of a score.

Learning rows are those with crc32(id as text) mod ``folds`` other than 0; a null id counts as
held out. Defined cases: a null or empty text has features of an empty text and a score;
labels that are null make a row neither positive nor unlabelled; repeated rows are scored each; extra columns are not
read; without positives or unlabelled rows the score is 0.5; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .textkit import lowered, slices, word_hashes

BINS = 16
#: Shares of the positives above the scores at which the prior is looked for.
SHARES = np.arange(20, 100) / 100


def _classes() -> np.ndarray:
    """Byte classes: a byte may be in one; counts of them make the features."""
    of = np.full(256, 9, np.uint8)
    of[[b for b in range(128) if chr(b).islower()]] = 0
    of[[b for b in range(128) if chr(b).isupper()]] = 1
    of[[b for b in range(128) if chr(b).isdigit()]] = 2
    of[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
    of[0x0A] = 4
    of[[ord("."), ord(",")]] = 5
    of[[ord("!"), ord("?")]] = 6
    of[[ord(c) for c in "|/\\<>{}[]=_~^"]] = 7
    of[[ord(c) for c in "#$%&*@+"]] = 8
    of[128:] = 10
    return of


def shape_features(texts: list[str | None]) -> np.ndarray:
    """Rows of shape features of whole texts."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    n = np.array([len(t) for t in raw])
    of = np.repeat(np.arange(len(raw)), n)
    counts = np.bincount(of * 11 + _classes()[buf], minlength=11 * len(raw)).reshape(-1, 11).astype(np.float64)
    h, off = word_hashes([t.lower() for t in raw])
    words = np.diff(off).astype(np.float64)
    doc = np.repeat(np.arange(len(raw)), np.diff(off))
    again = np.zeros(len(raw))
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:][same], minlength=len(raw)).astype(np.float64)
    distinct, pairs, most = np.zeros(len(raw)), np.zeros(len(raw)), np.zeros(len(raw))
    lines = np.zeros((len(raw), 2))
    for i, t in enumerate(raw):
        w = h[off[i] : off[i + 1]]
        if len(w):
            u, c = np.unique(w, return_counts=True)
            distinct[i], most[i] = len(u), c.max()
            pairs[i] = len(np.unique(w[1:] * np.uint64(31) + w[:-1])) if len(w) > 1 else 1
        split = t.split(b"\n")
        lines[i] = len(split), len(set(split))
    size, w1 = np.maximum(n, 1)[:, None], np.maximum(words, 1)
    return np.column_stack([
        counts / size, counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1), (counts[:, 7] + counts[:, 8] + counts[:, 6]) / w1,
        np.log1p(n), words / np.maximum(size[:, 0], 1), again / w1, distinct / np.sqrt(w1), distinct / w1, pairs / w1, most / w1, lines[:, 1] / np.maximum(lines[:, 0], 1), lines[:, 0] / w1, counts[:, 5] / w1,
    ])


@dataclass(frozen=True)
class QualityModel:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS)
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.bias)
        for j in range(len(self.edges)):
            g += self.weights[j][np.searchsorted(self.edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _summed(cells: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
    """``by`` of each row, summed over the bins that the row is in, and over all rows (the bias)."""
    return np.append(np.bincount(cells.ravel(), np.repeat(by, cells.shape[1]), size), by.sum())


def _value(theta: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return theta[cells].sum(1) + theta[-1]


def nnpu_risk(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The part of the risk that must not be negative, and the gradient to follow; p and u are bin numbers of rows."""
    size = len(theta) - 1
    gp, gu = _value(theta, p), _value(theta, u)
    rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    of_rest = _summed(u, _sigmoid(gu) / len(u), size) - prior * _summed(p, _sigmoid(gp) / len(p), size)
    return rest, prior * _summed(p, (_sigmoid(gp) - 1) / len(p), size) + of_rest if rest >= 0 else -of_rest


def _descended(gradient: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, rounds: int, rate: float, ridge: float) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        g = gradient(theta)
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta


def fit_nnpu(p: np.ndarray, u: np.ndarray, size: int, prior: float, rounds: int = 400, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights of ``size`` bins and the bias, by Adam."""
    start = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    return _descended(lambda theta: nnpu_risk(theta, p, u, prior)[1], start, rounds, rate, ridge)


def shares_above(p: np.ndarray, u: np.ndarray, size: int, parts: int = 5, rounds: int = 30, rate: float = 0.1, ridge: float = 1e-2) -> np.ndarray:
    """How many rows of u lie above the scores that ``SHARES`` of p lie above; each fifth is scored by a classifier of p against u fitted on the others."""
    out = np.zeros(len(SHARES))
    for k in range(parts):
        own_p, own_u = np.arange(len(p)) % parts == k, np.arange(len(u)) % parts == k
        fit_p, fit_u = p[~own_p], u[~own_u]

        def gradient(theta: np.ndarray, a: np.ndarray = fit_p, b: np.ndarray = fit_u) -> np.ndarray:
            return _summed(a, (_sigmoid(_value(theta, a)) - 1) / max(len(a), 1), size) + _summed(b, _sigmoid(_value(theta, b)) / max(len(b), 1), size)

        theta = _descended(gradient, np.zeros(size + 1), rounds, rate, ridge)
        if own_p.any() and own_u.any():
            cuts = np.quantile(_value(theta, p[own_p]), 1 - SHARES)
            out += own_u.sum() - np.searchsorted(np.sort(_value(theta, u[own_u])), cuts, "left")
    return out


def fold(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(0))


def shape_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a number of its own), x (the features as 32-bit floats) of every document; written."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=2 << 20):
            x = shape_features(part.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(src.mapInArrow(run, f"id {id_type}, x binary").withColumn("row", F.monotonically_increasing_id()))


def _matrix(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(len(x), -1)


def _codes(x: np.ndarray) -> np.ndarray:
    """Floats that are not negative as integers of the same order, exact to nine bits."""
    return np.ascontiguousarray(x, np.float32).view(np.uint32) >> np.uint32(14)


def bin_edges(unlabelled: DataFrame, positive: np.ndarray) -> np.ndarray:
    """(features, BINS - 1) quantiles over all unlabelled rows and the positives, each side with half of the weight."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(_matrix(batch.column(0))).astype(np.int64)
            at, n = np.unique(code + (np.arange(code.shape[1]) << 18), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    # A row for each value of nine bits that a feature takes: a fixed number, whatever the input.
    got = unlabelled.select("x").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")
    at, n = got["at"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    marks = np.concatenate(([0.02], np.linspace(0, 1, BINS + 1)[2:-2], [0.98]))
    edges = []
    for j in range(positive.shape[1]):
        mine = at >> 18 == j
        code = np.concatenate((at[mine] & (1 << 18) - 1, _codes(positive[:, j])))
        weight = np.concatenate((n[mine] / n[mine].sum() / 2, np.full(len(positive), 0.5 / len(positive))))
        order = np.argsort(code, kind="stable")
        mark = np.minimum(np.searchsorted(np.cumsum(weight[order]), marks), len(order) - 1)
        edges.append((code[order][mark].astype(np.uint32) << np.uint32(14)).view(np.float32))
    return np.array(edges, np.float64)


def cells_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], "right") + j * BINS for j in range(len(edges))], 1)


def fit_on(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, sample: int = 8_000) -> QualityModel | float:
    """The model from ``shape_rows``, or 0.5 where there is nothing to learn from."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("one"))
    learn = rows.where(F.col("id").isNotNull() & (fold(F.col("id"), folds) != 0))
    ones = learn.join(known.where("one = 1").where(fold(F.col("id"), folds) != 0), "id", "left_semi")
    # At most ``sample`` rows of 100 bytes.
    positive = ones.orderBy(F.xxhash64("id", "x"), "id", "x").limit(sample).select("x").toArrow().column(0).combine_chunks()
    unlabelled = written(learn.join(known, "id", "left_anti").select("row", "x"))
    n = unlabelled.count()
    if not len(positive) or not n:
        return 0.5
    positive = _matrix(positive)
    edges = bin_edges(unlabelled, positive)
    size = len(edges) * BINS
    p = cells_of(edges, positive)

    def pack(t: pa.Table) -> pa.Table:
        u = cells_of(edges, _matrix(t.column("x").combine_chunks()))
        u = u[np.lexsort(u.T)]  # rows come in any order; sums should not
        u = u[np.random.default_rng(3).permutation(len(u))].astype(np.int16)
        return pa.table({"n": pa.array([len(u)], pa.int64()), "u": pa.array([u.tobytes()], pa.binary())})

    shards = unlabelled.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(-(-n // sample))))
    shards = written(shards.groupBy("shard").applyInArrow(pack, "n long, u binary"))

    def summed(work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``work`` of all shards, summed."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for u in batch.column(0):
                    out = work(np.frombuffer(u.as_py(), np.int16).reshape(-1, len(edges)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "v"])

        return np.array([r.v for r in shards.select("u").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()])

    prior = float(np.clip((summed(lambda u: shares_above(p, u, size)) / n / SHARES).min(), 0.01, 0.99))
    theta = summed(lambda u: len(u) * fit_nnpu(p, u, size, prior)) / n
    return QualityModel(edges, theta[:-1].reshape(-1, BINS), float(theta[-1]), prior)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = 8_000) -> QualityModel | float:
    return fit_on(shape_rows(docs, id_col, text_col), labels, id_col, label_col, folds, sample)


def score_on(rows: DataFrame, model: QualityModel | float, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` from ``shape_rows``: the probability that a label would be 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def score_quality(docs: DataFrame, model: QualityModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_on(shape_rows(docs, id_col, text_col), model, id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape_rows(table(spark, sf_dir, "documents"))
    found = score_on(rows, fit_on(rows, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
