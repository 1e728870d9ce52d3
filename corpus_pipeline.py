"""A corpus pipeline of five stages: reject toxic documents, keep one document of each near-duplicate group, reject
documents that hold benchmark passages, replace personal data by its kind, encode with SentencePiece.

A stage takes (spark, docs, sf_dir) and works on every row of ``docs``; its result is written as Parquet and read again as
the next one's ``docs``. All but the last keep the columns of ``documents``. Rows with a null doc_id pass the
near-duplicate stage, since no id can name them. That stage removes by id and text: of rows that share an id, only those go whose own
text is in another document's group, or is a copy or near copy of one that stays. Extra columns of any name are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import decontam, neardup, pieces, pii, toxicity
from chromaloom.llm.common import matched, shared_dir, table, unused, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents whose probability of a toxic grade reaches the model's cut go."""
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 with five-word shingles and a similarity of 0.8: the document of least id stays in each group."""
    found = written(neardup.near_duplicates(docs))
    key, same = unused(docs, "text_key"), ["component_key", F.when(F.col("component_key").isNull(), F.col("text_key"))]
    own = found.where("doc_id is not null").withColumnRenamed("text_key", key)
    gone = own.where("component_id <> doc_id").select("doc_id", key)
    # Rows that share the least id of their group: the one of least text hash stays, once.
    least = found.where("component_id = doc_id").groupBy("doc_id", *same).agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"), F.count("*").alias("n")).where("n > 1")
    least = written(least.select("doc_id", "component_key", "least", "most"))
    if least.isEmpty():
        return matched(docs.withColumn(key, F.xxhash64("text")), gone, ["doc_id", key], "left_anti").select(docs.columns)
    later = own.join(least.where("component_key is not null").select("doc_id", "component_key", "least"), ["doc_id", "component_key"]).where(F.col(key) != F.col("least"))
    kept = matched(docs.withColumn(key, F.xxhash64("text")), gone.unionByName(later.select("doc_id", key)), ["doc_id", key], "left_anti")
    several = written(least.select("doc_id").distinct())
    again = kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", key])
    return kept.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a passage within the edit budget of a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: spans of personal data are replaced by their kind; n_chars follows the new text."""
    spans = unused(docs, "_spans")
    found = pii.find_pii(docs, spans_col=spans)
    found = found.withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted(F.coalesce("text", F.lit("")), F.col(spans))))
    if "n_chars" in docs.columns:
        changed = F.size(spans) > 0
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, n_tokens, the ids with an end id, and the text decoded from them."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near duplicates", keep_one_of_near_copies),
    ("decontamination", reject_leaks),
    ("personal data", redact),
    ("sentencepiece", encode),
]
#: Near duplicates over shingles of hashed words, a fitted model and a tokenizer are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
