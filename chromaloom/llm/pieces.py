"""Operator 1: SentencePiece encoding and decoding over a distinct-chunk table.

The normalised text (white space turned into the marker U+2581, one marker put in
front) is cut wherever a marker follows another character. No piece of the
vocabulary crosses such a cut, so BPE merges inside a chunk do not depend on what
stands around it: each distinct chunk is segmented once per task, and the ids of a
text are gathered back by position with numpy. The table of a task is emptied when it
reaches ``table_entries`` chunks, so memory is bounded while the corpus grows, and
there is no shuffle: a lost executor costs its own input splits only.

Defined cases: a null or empty text gives the end id alone and decodes to ""; a null
id is carried through; repeated rows are encoded each; extra columns are not read;
an empty table gives an empty result. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import slices

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def marker_bound(model_file: str) -> bool:
    """Whether no piece crosses a marker boundary and the normaliser only inserts markers, which the chunk table needs."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    user = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)
    return plain and not user and not m.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text that is not empty, each without its first marker."""
    if text[0] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]


class ChunkTable:
    """Distinct chunks seen so far: their ids end to end, and what they decode to."""

    def __init__(self, model_file: str, most: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.decoded: list[str] = []
        self.ids = np.empty(1 << 16, np.int32)
        self.start = np.zeros(1, np.int64)

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.code.keys())
        if not new:
            return
        ids = self.sp.encode([c.replace(MARK, " ") for c in new], num_threads=1)
        if "" in new:  # a marker alone: the library adds none to an empty text
            ids[new.index("")] = [self.sp.piece_to_id(MARK)]
        first = len(self.code)
        self.code.update(zip(new, range(first, first + len(new)), strict=True))
        self.decoded += self.sp.decode(ids)
        ends = self.start[-1] + np.cumsum([len(x) for x in ids])
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.start[-1] : ends[-1]] = np.concatenate([np.asarray(x, np.int32) for x in ids])
        self.start = np.concatenate((self.start, ends))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts end to end, each with the end id; their offsets; the decoded texts."""
        cut = [chunks_of(t) if t else [] for t in texts]
        if len(self.code) > self.most:
            self.clear()
        self.learn(set().union(*cut))
        code = self.code
        codes = [np.fromiter(map(code.__getitem__, c), np.int64, len(c)) for c in cut]
        decoded = [" ".join(map(self.decoded.__getitem__, c.tolist())) for c in codes]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        n = self.start[flat + 1] - self.start[flat]
        ends = np.cumsum(n)
        took = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[flat] - ends + n, n)]
        text_ends = np.concatenate(([0], ends))[np.cumsum([len(c) for c in codes])]
        out = np.full(len(took) + len(texts), self.sp.eos_id(), np.int32)
        out[np.arange(len(took)) + np.repeat(np.arange(len(texts)), np.diff(text_ends, prepend=0))] = took
        return out, np.concatenate(([0], text_ends + np.arange(1, len(texts) + 1))), decoded


def encode_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", table_entries: int = 200_000) -> DataFrame:
    """Returns ``id_col, n_tokens, ids, decoded``: the ids with the end id, and the text decoded from them."""
    model_file = model_file or model_path()
    if not marker_bound(model_file):
        raise ValueError("pieces of this model may cross white-space markers: the distinct-chunk table does not hold for it")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_file, table_entries)
        for part in slices(batches, max_bytes=1 << 20):
            ids, offsets, decoded = chunks.encode(part.column(1).to_pylist())
            arrays = [part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids", "decoded"])

    out = src.mapInArrow(run, f"id {id_type}, n_tokens long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
