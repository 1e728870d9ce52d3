"""Operator 5: severity of toxicity by cumulative-link ordinal regression.

Features are 1 + log(count) of present words (lower-cased, without ASCII punctuation) whose share of
toxic labelled documents differs from the rest by ``least_z`` standard deviations; at most
``features`` of them, the most significant. One weight vector is shared by the ordered
thresholds: P(grade >= j) = sigmoid(w.x - t_j). The labels say only toxic or not, so the
grade of a toxic document is 1, or 2 where it holds more hits of the words that speak for toxicity
than the median toxic document. Expected severity is the sum of the P(grade >= j).

The model is fitted on at most ``sample`` labelled rows, those of least hash of the id; word
statistics are aggregated in Spark, and only the chosen features of the sample reach the
driver. Every document is scored whole, in one pass without a shuffle.

Defined cases: a null or empty text has no features; labels that are null, or of ids without
a document, are ignored; an id labelled twice counts twice; without usable labels or
significant words the severity is the base rate and nothing is toxic; null ids are carried through; repeated
rows are scored each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, table, written
from .textkit import lowered, slices, trim, word_hashes


@dataclass(frozen=True)
class OrdinalModel:
    words: np.ndarray  # ascending hashes
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # of P(grade >= 1), from which a document counts as toxic: best F1 on the sample

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for rows of features."""
        return sigmoid((x @ self.weights)[:, None] - self.thresholds[None])

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """``at_least`` of whole texts."""
        h, off = word_hashes([lowered(t) for t in texts], bare=True)
        x = np.zeros((len(texts), len(self.words)))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == h)
            np.add.at(x, (np.searchsorted(off, hit, "right") - 1, at[hit]), 1)
        return self.at_least(damped(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def damped(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability with the best F1, half way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0  # no cut between equals
    at = int(f1.argmax())
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0)) / 2)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the log loss of the cumulative links, summed over thresholds."""
    above = np.stack([grade >= j for j in range(1, grades)], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    first, gaps = -np.log(share[0] / (1 - share[0])), np.full(grades - 2, 0.0)
    theta = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, cuts = theta[: x.shape[1]], np.cumsum(np.concatenate((theta[x.shape[1] : x.shape[1] + 1], np.log1p(np.exp(theta[x.shape[1] + 1 :])))))
        err = (sigmoid((x @ w)[:, None] - cuts[None]) - above) / len(x)
        by_cut = -err.sum(0)
        g_gap = by_cut[::-1].cumsum()[::-1][1:] * sigmoid(theta[x.shape[1] + 1 :])
        g = np.concatenate((x.T @ err.sum(1) + ridge * w, [by_cut.sum()], g_gap))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[: x.shape[1]], np.cumsum(np.concatenate((theta[x.shape[1] : x.shape[1] + 1], np.log1p(np.exp(theta[x.shape[1] + 1 :])))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, features: int = 512, least_z: float = 5.0, least_docs: int = 3) -> OrdinalModel:
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=2 << 20):
            h, off = word_hashes([lowered(t) for t in part.column(0).to_pylist()], bare=True)
            own = [np.unique(h[off[i] : off[i + 1]], return_counts=True) for i in range(part.num_rows)]
            lists = [pa.array([x[k].astype(np.int64) for x in own], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(1), *lists], ["toxic", "words", "n"])

    # At most ``sample`` ids and flags, so they go to the documents rather than all texts to them.
    got = written(texts.join(F.broadcast(rows), "id").select("text", "toxic").mapInArrow(counted, "toxic int, words array<long>, n array<long>"))
    total, toxic = got.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = np.zeros(0)
    if not 0 < toxic < total:
        share = np.clip(toxic / max(total, 1), 1e-3, 1 - 1e-3)
        return OrdinalModel(none.astype(np.uint64), none, np.full(2, -np.log(share / (1 - share))), np.inf)
    base = toxic / total
    stats = got.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("toxic").alias("with")).where(F.col("df") >= least_docs)
    z = (F.col("with") - F.col("df") * base) / F.sqrt(F.col("df") * base * (1 - base) * (1 - F.col("df") / (total + 1)))
    chosen = stats.withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(features).collect()
    order = sorted(chosen, key=lambda r: np.int64(r.word).astype(np.uint64))
    words = np.array([r.word for r in order], np.int64).astype(np.uint64)
    speaks = np.array([r.z > 0 for r in order], bool)
    known = [int(r.word) for r in order]
    of = F.filter(F.arrays_zip("words", "n"), lambda p: p["words"].isin(known)) if known else F.array().cast("array<struct<words:long,n:long>>")
    # As Arrow, so that the driver holds no object for each of the sample's hits.
    data = got.select("toxic", of.alias("own")).toArrow().combine_chunks()
    y = data.column("toxic").to_numpy()
    own = data.column("own").combine_chunks()
    row, hits = np.repeat(np.arange(len(y)), np.diff(own.offsets.to_numpy())), own.flatten()
    n = hits.field("n").to_numpy(zero_copy_only=False)
    col = np.searchsorted(words, hits.field("words").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    x = np.zeros((len(y), len(words)))
    x[row, col] = 1 + np.log(n)  # as ``damped`` has it
    loud = np.bincount(row, n * speaks[col], len(y)) if len(words) else np.zeros(len(y))
    grade = y * (1 + (loud > np.median(loud[y > 0])))
    w, cuts = fit_ordinal(x, grade, 3)
    model = OrdinalModel(words, w, cuts)
    model = OrdinalModel(words, w, cuts, best_cut(model.at_least(x)[:, 0], y) if len(words) else np.inf)
    del data, own, hits, x
    trim()
    return model


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document ``id_col, severity`` (0 to 2, expected), ``toxicity`` (probability of grade 1 or more), ``toxic`` (that it reaches the model's cut)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=2 << 20):
            p = model.of_texts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= model.cut)], ["id", "severity", "toxicity", "toxic"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, severity double, toxicity double, toxic boolean")
    return out.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text stays under the model's cut."""
    return keep_rows(docs, text_col, lambda texts: model.of_texts(texts)[:, 0] < model.cut)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "severity", "toxicity", F.round("severity").cast("int").alias("grade"), "toxic")
