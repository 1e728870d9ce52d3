import math
import random
import re

import pytest

from chromaloom.llm import licenses

from ..conftest import SF
from .cases import ODD, as_docs, ascii_lower, odd_docs


def brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        q = phrase.split()
        places += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), sorted(places)


TEXTS = [
    "MIT license", "the MIT-License. mit\nlicense mitlicense émit license", "GNU General  Public License, version 3.", "general public licence", "mit license " * 2000, "ÀMIT License MIT Licenseé",
    "apache license apache mit license", "license " * 5000, "Licensed under CC BY-NC 4.0.", "All rights reserved.", "Licensed under the Apache License, Version 2.0.", "...", "license mit",
]


def test_places_like_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    texts = dict(rows)
    found = licenses.scan_licenses(as_docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        n, places = brute(texts[r.doc_id])
        assert (r.n_words, sorted((p["at"], p["label"]) for p in r.places), r.base_labels) == (n, places, sorted({x for _, x in places}))
        assert 0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels)
    of = {r.doc_id: r.labels for r in found}
    assert of[8] == ["cc-by-nc-4.0"] and of[9] == ["all-rights-reserved"] and of[10] == ["apache", "apache-2.0"] and of[2] == ["gpl", "gpl-3.0"]


def test_odd_rows_and_query(spark):
    assert licenses.scan_licenses(odd_docs(spark)).count() == len(ODD)
    assert licenses.scan_licenses(as_docs(spark, []).limit(0)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = licenses.op4_licenses(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, places = brute(docs[r.doc_id])
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_plan_has_no_python(spark):
    assert not re.search("Python|Pandas|Arrow", licenses.op4_licenses(spark, SF)._jdf.queryExecution().toString())


def test_every_notice_of_a_file_is_found(spark):
    mit = "Copyright (c) someone. Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy without charge."
    prose = "Without a person there is no purpose, except that the author forms, without general version or public source, a domain where rights are granted. " * 40
    notices = {t.label: t.notice for t in licenses.TEMPLATES}
    rows = [(1, f"{mit} Licensed under the GNU General Public License version 3."), (2, f"{mit} Licensed under CC BY-NC 4.0."), (3, f"{mit} Licensed under CC BY-NC-SA 4.0."), (4, " ; ".join(notices.values()))]
    rows += [(100 + i, f"{prose} {n}. {prose}") for i, n in enumerate(notices.values())]
    of = {r.doc_id: set(r.labels) for r in licenses.scan_licenses(as_docs(spark, rows)).collect()}
    assert {"mit", "gpl-3.0"} <= of[1] and {"mit", "cc-by-nc-4.0"} <= of[2] and {"mit", "cc-by-nc-sa-4.0"} <= of[3] and set(notices) <= of[4]
    assert all(x in of[100 + i] for i, x in enumerate(notices))


def method_by_brute_force(t):
    """Label and score of every template whose key phrase stands in the words of ``t``, straight from the notices."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    used = {x.label: {y for k in (x.notice, *x.keys) for y in k.split()} for x in licenses.TEMPLATES}
    weight = lambda y: 0 if y in licenses.FUNCTION_WORDS or y.isdigit() else 1 + math.log(len(used) / sum(y in u for u in used.values()))
    best = {}
    for x in licenses.TEMPLATES:
        for key in x.keys:
            phrase, notice = key.split(), x.notice.split()
            at = [i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase][:1]
            ring = [(i - at[0], y) for i, y in enumerate(notice)] if at else list(enumerate(phrase))
            whole = sum(weight(y) for _, y in ring)
            for s in range(len(w) - len(phrase) + 1):
                if w[s : s + len(phrase)] == phrase and any(weight(y) for y in phrase):
                    got = sum(weight(y) for i, y in ring if 0 <= s + i < len(w) and w[s + i] == y)
                    best[x.label] = max(best.get(x.label, 0), min(1, got / whole))
    return best


def test_labels_and_scores_like_brute_force(spark):
    rng = random.Random(3)
    notices = [t.notice for t in licenses.TEMPLATES] + [k for t in licenses.TEMPLATES for k in t.keys]
    texts = [*notices, *TEXTS, " . ".join(notices)]
    for _ in range(120):
        parts = []
        for n in rng.sample(notices, rng.randint(1, 4)):
            w = n.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["license", "public", "other", "version"])
            parts.append(rng.choice([" ", ", ", "\n"]).join(w[rng.choice([0, 0, 1, 3]) :]))
        texts.append(rng.choice([" ", " and some words ", "; "]).join(parts))
    texts = dict(enumerate(texts))
    for r in licenses.scan_licenses(as_docs(spark, list(texts.items()))).collect():
        want = method_by_brute_force(texts[r.doc_id])
        n, places = brute(texts[r.doc_id])
        assert set(r.labels) == set(want) | {x for _, x in places}
        assert r.score == pytest.approx(max([*want.values(), 0.5 * bool(places), 0]))


def test_a_repeated_row_scores_as_one(spark):
    t = "see the mit license here"
    one, *many = (licenses.scan_licenses(as_docs(spark, [(1, t)] * n)).collect() for n in (1, 2, 5))
    assert all(r.score == one[0].score and r.labels == one[0].labels for rows in many for r in rows) and [len(x) for x in many] == [2, 5]
