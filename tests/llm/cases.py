"""Documents that hold every odd case: nulls, empty and very long texts, repeats, clashing columns."""

import re

from pyspark.sql import functions as F


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))


ODD = [
    (None, "a row without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven"), (5, "One two three four five six seven"),
    (6, "one  TWO three four five six seven"), (6, "one  TWO three four five six seven"), (7, "long " * 60_000), (8, "x" * 200_000), (9, "é😀 Ünï ﷺ   z"), (10, "tie tie tie"), (11, "\x00 nul"),
]


def odd_docs(spark):
    """The odd rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("id", "digest", "words", "n", "score", "spans", "held", "block", "label", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
