"""Operator 10: a hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(code | class, history) * P(word | code). The first two factors are
softmaxes over ``CLASSES`` classes and the ``CODES`` codes of a class, both with hashed features of the history: previous word, the two
previous words, and the one before the previous (a skip) for classes; previous word and skip, each together with the class, for
codes. The most frequent words, by frequency half of the classes, have a code each; other words share the codes of
the other classes by hash, and the last factor is the word's training count within its code, smoothed by 0.1 (0.001 where a word has a
code of its own) for each known word and for one unknown word. So all probabilities of a history sum to one.

1. Documents are encoded in blocks of about ``block_bytes``: the distinct words of a block by
   64-bit hash, and tokens as numbers within the block.
2. Counts of words are aggregated over blocks. The ``HOT`` words of most blocks go to all tasks, so no task
   gathers the rows of a common word; other words of a block ask for their counts by a join, and a word of one block alone
   needs no answer.
3. The weights are trained by updates that are sums over all training documents, made in tasks, added up in a salted tree by
   slices of the weights, and taken by the driver, which holds only the weights. A weight moves by a share of
   log(observed / expected) of its feature and outcome, both with ``PRIOR`` further counts, as in iterative scaling: this has the sign of
   the gradient, observed - expected. At zero weights, the first update, the expected counts follow from the features' counts.
4. Each block meets the counts of its own words and is scored in sparse numpy batches.

The tables of weights have about four times the square root of the training tokens as rows, 2**20 at most: what training gathers grows
with the corpus, as do the counts of all words. No vocabulary reaches the driver; weights, hot words and the words with own codes are sent out.

Training documents are those with crc32(id as text) mod ``folds`` other than 0; a null id
counts as held out. Defined cases: a null or empty text is the end token alone; repeated
rows are learnt and scored each; extra columns are not read; an empty table gives an empty
result; without training documents all words are unknown. Words are known by 64 bits; a word's count is another's too where
these agree, which happens to a given word of a corpus of 10**10 distinct ones with probability 5 * 10**-10.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .quality import fold
from .textkit import lowered, mix64, slices, trim, word_hashes

CLASSES, CODES = 32, 32
OWN = CLASSES * CODES // 2  # words with a code of their own
HOT = 1 << 16
LEAST_ROWS, MOST_ROWS = 1 << 10, 1 << 20
SLICE = 256  # rows of weights in a row of summed counts
PRIOR = 20.0
#: A text has under 2**31 bytes, so fewer distinct words than 2**AT_BITS: that many take five bytes each and more.
AT_BITS, PART_BITS = 29, 20
END = np.uint64(0x5DEECE66D1234567)
SMOOTH, SMOOTH_OWN = 0.1, 0.001
_BLOCK = "block long, held array<boolean>, off binary, low binary, high binary, n binary, tok binary"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that no more than one block is held as Python objects."""
    trim()
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _packed(tokens: np.ndarray) -> bytes:
    """Token numbers as one plane per byte, so that the high bytes compress away."""
    return zlib.compress(np.ascontiguousarray(tokens.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _tokens(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def encode_blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, block_bytes: int) -> DataFrame:
    """Blocks of documents; ``ids`` are the documents' ids, ``off`` their token offsets, ``n`` the words' training counts."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(F.col(id_col), folds) == 0).alias("held"), F.spark_partition_id().alias("part"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for part in slices(batches, max_bytes=block_bytes, max_rows=20_000):
            h, off = word_hashes([lowered(t) for t in part.column(1).to_pylist()])
            off = off + np.arange(len(off))  # an end after each text
            all_h = np.full(off[-1], END, np.uint64)
            at_end = np.zeros(off[-1], bool)
            at_end[off[1:] - 1] = True
            all_h[~at_end] = h
            words, tok, own = np.unique(all_h, return_inverse=True, return_counts=True)
            order = np.argsort(-own, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words, tok = words[order], rank[tok]
            train = np.repeat(~np.asarray(part.column(2).to_pylist(), bool), np.diff(off))
            n = np.bincount(tok[train], minlength=len(words))
            block = (number << PART_BITS) + int(part.column(3)[0].as_py())
            number += 1
            row = [pa.array([block]), pa.array([part.column(2).to_pylist()]), pa.array([off.astype(np.int64).tobytes()]), pa.array([words.astype(np.uint32).tobytes()]), pa.array([(words >> np.uint64(32)).astype(np.uint32).tobytes()]), pa.array([n.astype(np.int32).tobytes()]), pa.array([_packed(tok)]), pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type))]
            yield pa.RecordBatch.from_arrays(row, ["block", "held", "off", "low", "high", "n", "tok", "ids"])

    return src.mapInArrow(run, f"{_BLOCK}, ids array<{id_type}>")


def _words(row: dict) -> np.ndarray:
    low, high = (np.frombuffer(row[c], np.uint32).astype(np.uint64) for c in ("low", "high"))
    return (low | high << np.uint64(32)).view(np.int64)


def _found(sorted_words: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words are among the sorted ones, and which of them are there."""
    if not len(sorted_words):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return at, sorted_words[at] == words


def _entries(blocks: DataFrame) -> DataFrame:
    """word, n: a row for each distinct word of a block with its training count there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w, c = _words(row), np.frombuffer(row["n"], np.int32)
            for lo in range(0, len(w), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in (w, c)], ["word", "n"])

    return blocks.select("low", "high", "n").mapInArrow(run, "word long, n int")


def _asked(blocks: DataFrame, hot: np.ndarray) -> DataFrame:
    """word, key: the words of each block that are not hot; the key holds the block and, in its low bits, the word's place there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = _words(row)
            at = np.flatnonzero(~_found(hot, w)[1])
            for lo in range(0, len(at), 50_000):
                part = at[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(w[part]), pa.array((row["block"] << AT_BITS) + part)], ["word", "key"])

    return blocks.select("block", "low", "high").mapInArrow(run, "word long, key long")


class Codes:
    """The code of every word, known by the low 32 bits of its hash: its rank among the words with own codes, else by hash."""

    def __init__(self, words: list[int]):
        own: dict[int, int] = {}
        for rank, w in enumerate(words):
            own.setdefault(w & 0xFFFFFFFF, rank)
        self.low = np.array(sorted(own), np.uint32)
        self.rank = np.array([own[int(w)] for w in self.low], np.int64)

    def of(self, low: np.ndarray) -> np.ndarray:
        at, there = _found(self.low, low)
        shared = OWN + (low & np.uint32(CLASSES * CODES - OWN - 1)).astype(np.int64)
        return np.where(there, self.rank[at], shared) if len(self.low) else shared

    def column(self, words: DataFrame) -> DataFrame:
        """``words`` (word, ...) with a column ``code``."""
        low = F.col("word").bitwiseAND(F.lit(0xFFFFFFFF))
        own = words.sparkSession.createDataFrame([(int(w), int(r)) for w, r in zip(self.low, self.rank, strict=True)], "_low long, _rank int")
        shared = (F.lit(OWN) + F.col("_l").bitwiseAND(F.lit(CLASSES * CODES - OWN - 1))).cast("int")
        joined = words.withColumn("_l", low).join(F.broadcast(own), F.col("_l") == F.col("_low"), "left")  # OWN rows
        return joined.withColumn("code", F.coalesce("_rank", shared)).drop("_l", "_low", "_rank")


def features(low: np.ndarray, tok: np.ndarray, off: np.ndarray, cls: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, tokens) and (2, tokens): rows of weights for each token's class and code, by its history, which starts afresh in each document.

    A row of the second table belongs to one class.
    """
    h = low[tok].astype(np.uint64)
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = off[:-1]
    one[first] = 1
    two[first] = 2
    second = first + 1
    second = second[second < off[1:]]
    two[second] = 1
    mask, part = np.uint64(rows - 1), rows // CLASSES
    of_class = [mix64(one * np.uint64(3)) & mask, mix64(one * np.uint64(0x9E3779B97F4A7C15) + two) & mask, mix64(two * np.uint64(5) + np.uint64(9)) & mask]
    of_code = [mix64(one * np.uint64(7) + np.uint64(1)) & np.uint64(part - 1), mix64(two * np.uint64(11) + np.uint64(2)) & np.uint64(part - 1)]
    return np.stack(of_class).astype(np.int64), np.stack(of_code).astype(np.int64) + cls * part


def exp_scores(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the outcomes' scores, and their sums. Weights are bounded, so nothing overflows."""
    z = np.take(weights, f[0], 0, mode="clip")
    for row in f[1:]:
        z += np.take(weights, row, 0, mode="clip")
    z += bias
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32)


@dataclass(frozen=True)
class Model:
    codes: Codes
    of_class: np.ndarray  # (rows, CLASSES)
    of_code: np.ndarray  # (rows, CODES)
    class_bias: np.ndarray
    code_bias: np.ndarray  # (CLASSES, CODES)

    def log_probs(self, low: np.ndarray, tok: np.ndarray, off: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """ln of P(class | history) * P(code | class, history) of each token."""
        code = self.codes.of(low)[tok]
        cls = code // CODES
        f, g = features(low, tok, off, cls, len(self.of_class))
        out = np.empty(len(tok))
        for lo in range(0, len(tok), chunk):
            s = slice(lo, lo + chunk)
            at = np.arange(len(cls[s]))
            a, sa = exp_scores(self.of_class, self.class_bias, f[:, s])
            b, sb = exp_scores(self.of_code, self.code_bias[cls[s]], g[:, s])
            out[s] = np.log(a[at, cls[s]]) - np.log(sa) + np.log(b[at, code[s] % CODES]) - np.log(sb)
        return out


def _spread(to: np.ndarray, f: np.ndarray, p: np.ndarray) -> None:
    """Adds each row of p to the rows of ``to`` that f names."""
    for row in f:
        order = np.argsort(row.astype(np.uint16) if len(to) <= 1 << 16 else row, kind="stable")
        at = row[order]
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        to[at[start]] += np.add.reduceat(np.take(p, order, 0, mode="clip"), start, axis=0)


def expected_counts(model: Model, low: np.ndarray, tok: np.ndarray, off: np.ndarray, of: np.ndarray, out: tuple[np.ndarray, np.ndarray], chunk: int = 4096) -> None:
    """Adds to ``out`` how often the model expects each outcome with each feature of the tokens ``of``."""
    cls = model.codes.of(low)[tok] // CODES
    f, g = features(low, tok, off, cls, len(model.of_class))
    for lo in range(0, len(of), chunk):
        s = of[lo : lo + chunk]
        for weights, bias, ff, to in ((model.of_class, model.class_bias, f[:, s], out[0]), (model.of_code, model.code_bias[cls[s]], g[:, s], out[1])):
            p, total = exp_scores(weights, bias, ff)
            p /= total[:, None]
            _spread(to, ff, p)


def observed_counts(codes: Codes, rows: int, low: np.ndarray, tok: np.ndarray, off: np.ndarray, of: np.ndarray, out: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds to ``out`` how often each outcome stands with each feature of the tokens ``of``."""
    code = codes.of(low)[tok]
    f, g = features(low, tok, off, code // CODES, rows)
    for ff, outcome, to in ((f, code[of] // CODES, out[0]), (g, code[of] % CODES, out[1])):
        for row in ff:
            np.add.at(to.ravel(), row[of] * to.shape[1] + outcome, 1)


def _summed(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Sums the binary float rows of equal slice, by streams of constant memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, np.float32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()])], ["slice", "v"])

    return rows.repartition(parts, *keys).select("slice", "v").mapInArrow(run, "slice int, v binary")


def _gathered(blocks: DataFrame, rows: int, work: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The tables that ``work(low, tok, off, of, out)`` adds up over the training tokens ``of`` of all blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((rows, CLASSES), np.float32), np.zeros((rows, CODES), np.float32)
        salt = 0
        for row in _rows(batches):
            off, low, tok = np.frombuffer(row["off"], np.int64), np.frombuffer(row["low"], np.uint32), _tokens(row["tok"])
            of = np.flatnonzero(np.repeat(~np.asarray(row["held"], bool), np.diff(off)))
            work(low, tok, off, of, out)
            salt = (salt * 31 + len(tok)) % 16
        for t, table_ in enumerate(out):
            for s in range(0, rows, SLICE):
                if table_[s : s + SLICE].any():
                    number = (t * rows + s) // SLICE
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([table_[s : s + SLICE].tobytes()])], ["slice", "salt", "v"])

    sums = _summed(_summed(blocks.mapInArrow(run, "slice int, salt int, v binary"), ["slice", "salt"], 64), ["slice"], 16)
    got = np.zeros((2 * rows, CLASSES), np.float32)
    for row in sums.collect():  # 2 * rows * 32 floats
        got[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.v, np.float32).reshape(SLICE, -1)
    return got[:rows], got[rows:]


def table_rows(tokens: int) -> int:
    return int(np.clip(2 ** round(np.log2(max(tokens, 1)) / 2 + 2), LEAST_ROWS, MOST_ROWS))


def train(blocks: DataFrame, codes: Codes, code_counts: np.ndarray, tasks: int, rounds: int = 1, first: float = 0.5, step: float = 0.3, most: float = 8.0) -> Model:
    """The model after the first update and ``rounds`` more, each over all training documents."""
    rows = table_rows(int(code_counts.sum()))
    by_class = code_counts.reshape(CLASSES, CODES).sum(1)
    share = (by_class + 1) / (by_class + 1).sum()
    in_class = (code_counts.reshape(CLASSES, CODES) + 0.5) / (by_class[:, None] + 0.5 * CODES)
    class_bias, code_bias = np.log(share).astype(np.float32), np.log(in_class).astype(np.float32)
    shares = share[None], np.repeat(in_class, rows // CLASSES, 0)
    src = blocks.select("held", "off", "low", "tok").coalesce(tasks)
    seen = _gathered(src, rows, lambda *a: observed_counts(codes, rows, *a))
    moved = lambda w, e, o, p, by: np.clip(w + by * np.log((o + PRIOR * p) / (e + PRIOR * p)), -most, most).astype(np.float32)
    weights = [moved(0, o.sum(1, keepdims=True) * p, o, p, first) for o, p in zip(seen, shares, strict=True)]
    for _ in range(rounds):
        model = Model(codes, weights[0], weights[1], class_bias, code_bias)
        expected = _gathered(src, rows, lambda *a, model=model: expected_counts(model, *a))
        weights = [moved(w, e, o, p, step) for w, e, o, p in zip(weights, expected, seen, shares, strict=True)]
    return Model(codes, weights[0], weights[1], class_bias, code_bias)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, block_bytes: int = 3 << 19, rounds: int = 1) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    blocks = written(encode_blocks(docs, id_col, text_col, folds, block_bytes))
    counts = written(_entries(blocks).groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")))
    top = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(OWN).collect()
    codes = Codes([r.word for r in top])
    hot = counts.where("blocks > 1").orderBy(F.desc("blocks"), "word").limit(HOT).select("word", "c").toArrow()
    hot_words, hot_counts = (hot.column(i).to_numpy() for i in range(2))
    order = np.argsort(hot_words)
    hot_words, hot_counts = hot_words[order], hot_counts[order]
    code_counts, code_types = np.zeros(CLASSES * CODES), np.zeros(CLASSES * CODES)
    for r in codes.column(counts.where("c > 0").select("word", "c")).groupBy("code").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        code_counts[r.code], code_types[r.code] = r.n, r.v
    total, types = int(code_counts.sum()), int(code_types.sum())
    size = blocks.agg(F.coalesce(F.sum(F.length("tok")), F.lit(0))).first()[0]
    # A task sends a whole table, so its share of the tokens grows with the table.
    share = (12 << 20) * max(1, table_rows(total) >> 14)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // share))
    model = train(blocks, codes, code_counts, tasks, rounds)
    smooth = np.where(np.arange(CLASSES * CODES) < OWN, SMOOTH_OWN, SMOOTH)
    id_type = docs.schema[id_col].dataType.simpleString()
    arrow_id = blocks.limit(0).select("ids").toArrow().schema.field(0).type.value_type

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("id", arrow_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        row = left.slice(0, 1).to_pylist()[0]
        off, low, tok = np.frombuffer(row["off"], np.int64), np.frombuffer(row["low"], np.uint32), _tokens(row["tok"])
        c = np.frombuffer(row["n"], np.int32).astype(np.float64)  # all that there are of words of this block alone
        at, there = _found(hot_words, _words(row))
        c[there] = hot_counts[at[there]]
        c[right.column("at").to_numpy()] = right.column("c").to_numpy()
        code = codes.of(low)
        base = np.log10((c + SMOOTH) / (total + SMOOTH * (types + 1)))
        within = np.log10((c + smooth[code]) / (code_counts[code] + smooth[code] * (code_types[code] + 1)))
        add = lambda x: np.add.reduceat(x, off[:-1])
        own = model.log_probs(low, tok, off) / np.log(10) + within[tok]
        return pa.Table.from_arrays([pa.array(row["ids"], arrow_id), pa.array(row["held"], pa.bool_()), pa.array(np.diff(off)), pa.array(add((c > 0)[tok].astype(np.int64))), pa.array(add(base[tok])), pa.array(add(own))], schema=schema)

    # A word of one block alone has its whole count there already.
    answers = _asked(blocks, hot_words).join(counts.where("blocks > 1 and c > 0").select("word", "c"), "word")
    answers = answers.select(F.shiftright("key", AT_BITS).alias("block"), F.col("key").bitwiseAND((1 << AT_BITS) - 1).cast("int").alias("at"), "c")
    own_side = blocks.select("block", "held", "off", "low", "high", "n", "tok", "ids").groupBy("block")
    out = own_side.cogroup(answers.groupBy("block")).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
