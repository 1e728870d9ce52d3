import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from chromaloom.llm import decontam, toxicity

from ..conftest import SF
from .cases import as_docs
from .test_neardup import shingles
from .test_pieces import whole
from .test_pii import base


def test_stages_on_whole_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    left = [i for i, r in sorted(rows.items()) if model.of_texts([r.text])[0, 0] < model.cut]
    sets = {i: shingles(rows[i].text, 5) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(left):
        for j in left[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = [i for i in left if find(i) == i]
    bench = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = lambda t: any(decontam.edit_end(decontam.pattern_bits(p), len(p), t)[0] <= len(p) // 5 for p in bench)
    left = [i for i in left if not leaked(decontam.words_of(rows[i].text))]
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert sorted(got) == left
    for i in left:
        assert got[i].ids == whole(got[i].decoded)[0] and not base(got[i].decoded)
        if not re.search(r"[0-9@]", rows[i].text):
            assert got[i].decoded == rows[i].text


def test_stages_keep_columns_and_odd_rows(spark):
    docs = as_docs(spark, [(None, "no id"), (1, None), (2, ""), (3, "same words here again and again"), (3, "same words here again and again"), (4, "same words here again and again"), (5, "a@b.cd")])
    docs = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = docs.collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "5", "None"]
    assert next((r.text, r.n_chars) for r in left if r.doc_id == 5) == ("<EMAIL>", 7)
    assert P.STAGES[-1][1](spark, docs, SF).count() == 5


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_a_shared_id_loses_only_the_copy(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "all other words stand in this unlike text of the same document number"
    rows = [(5, a), (6, a + " more"), (6, b), (7, b), (8, "w " + b), (9, "x y z"), (9, "x y z"), (9, None), (9, ""), (9, "p q r s t u v w"), (9, "p q r s t u v w x y z"), (None, a)]
    docs = as_docs(spark, rows).selectExpr("*", "'kept' as _spans", "'kept' as text_key", "'kept' as component_id", "'kept' as digest")
    out = P.keep_one_of_near_copies(spark, docs, SF)
    left = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    want = [(5, a), (6, b), (9, "x y z"), (9, None), (9, ""), (9, "p q r s t u v w"), (9, "p q r s t u v w x y z"), (None, a)]
    assert out.columns == docs.columns and left == sorted((str(i), str(t)) for i, t in want)
    shown = P.redact(spark, docs.limit(1).withColumn("text", F.lit("mail a@b.cd")), SF).first()
    assert (shown.text, shown._spans, shown.digest) == ("mail <EMAIL>", "kept", "kept")


def test_near_copies_of_one_id(spark):
    a = " ".join(f"w{i}" for i in range(60))
    left = P.keep_one_of_near_copies(spark, as_docs(spark, [(3, a), (3, a + " end"), (3, a), (4, a)]), SF).collect()
    assert len(left) == 1 and left[0].doc_id == 3
