import re

import pytest
from pyspark.sql import functions as F

from chromaloom.llm import pii

from ..conftest import SF
from .cases import ODD, as_docs, odd_docs

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in hit.split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15


def base(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m.group())]


TEXTS = [
    "a@b.c_d@e.f x@y", "a@b.cd@e.fg.hi", "@@a@@b.c@d.e", "a@b-.c-d..e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4785 3805 9239 1139-1", "4785380592391139$$$", "+1 (602) 555-5136 +49-30.12345678)",
    "é😀 a.b@c.de 😀 4111 1111 1111 1111", "+" * 50 + "1" * 40, "1" * 20_000, "a" * 50_000 + "@", "1.1." * 3000, "x@" + "a.b" * 4000, "１２３ +1 2 3 4 5 6 7 8", "mail me: me@x.org",
]


def test_base_like_the_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    texts = dict(rows)
    for r in pii.find_pii(as_docs(spark, rows)).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in PATTERNS] == base(texts[r.doc_id])
        assert all(texts[r.doc_id][s.start : s.end] == s.text and 0 <= s.score <= 1 for s in r.pii_spans)


def test_added_kinds_and_context(spark):
    t = 'IBAN GB82 WEST 1234 5698 7654 32, not GB82 WEST 1234 5698 7654 33. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" call (602) 555-5136 or +1 (602) 555-5136'
    spans = pii.find_pii(as_docs(spark, [(1, t)])).first().pii_spans
    assert [s.kind for s in spans] == ["phone", "iban", "local_phone", "secret"]
    kinds = lambda x: [s.kind for s in pii.find_pii(as_docs(spark, [(1, x)])).first().pii_spans]
    assert kinds("see 234 567 8901 units") == [] and kinds("call 234 567 8901") == ["local_phone"] and kinds("phone " + "x" * 40 + " 234 567 8901") == []
    assert kinds('secret = "abcdefghijklmnop"') == [] and kinds('login secret = "abcdefghijklmnop"') == ["secret"] and kinds('secret = "abcdefgh1jklmnop"') == ["secret"]
    plain, near = (pii.find_pii(as_docs(spark, [(1, x)])).first().pii_spans[0].score for x in ("see a@b.cd", "e-mail: a@b.cd"))
    assert near > plain


def test_redaction(spark):
    t = "+1 (602) 555-5136 and a@b.cd, 1.2.3.4"
    df = pii.find_pii(as_docs(spark, [(1, t), (2, "clean"), (3, "")]))
    assert [r[0] for r in df.orderBy("doc_id").select(pii.redacted(F.col("text"), F.col("pii_spans"))).collect()] == ["<PHONE> and <EMAIL>, <IP>", "clean", ""]


def test_odd_rows_and_query(spark):
    assert pii.find_pii(odd_docs(spark)).count() == len(ODD)
    with pytest.raises(ValueError):
        pii.find_pii(odd_docs(spark), spans_col="Spans")
    assert pii.find_pii(as_docs(spark, []).limit(0)).count() == 0
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op3_pii(spark, SF).collect():
        b = base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()


def test_plan_has_no_python(spark):
    plan = pii.op3_pii(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
