"""Operator 4: license scans by a positional rare-token index, in DataFrame functions only.

Base: places where the words of a fixed phrase stand consecutively. They are found with
one linear pattern; a place's word number is the count of words in the gaps before it.

Method: each template is a short notice. Words that few templates use are indexed with
their positions. All indexed words of a file are looked up; each posting proposes that a
key phrase of the template starts at a certain word of the file, a start is kept where the
mandatory phrase stands at its place, and the weights of the postings that agree on it are summed:
the score is their share of the weights of all indexed words of the notice. The index has
a fixed number of rows, so it is broadcast; only agreeing starts are shuffled, keyed by row.

Defined cases: a null or empty text has no words, no labels and score 0; null ids are
carried through; repeated rows are scanned each and score as one alone does; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy", ("mit license", "permission is hereby granted free of charge")),
    Template("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "isc license permission to use copy modify and or distribute this software for any purpose", ("isc license", "permission to use copy modify and or distribute")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0-1.0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0", "creative commons attribution 4 0")),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0", "creative commons attribution sharealike 4 0")),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0", "creative commons attribution noncommercial 4 0")),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("all-rights-reserved", "copyright the author all rights reserved", ("all rights reserved",)),
)
#: Words that any prose uses; they are not indexed.
FUNCTION_WORDS = frozenset("a all and any are by code copy file for form free in into is may not of or subject terms the this to use with work you".split())


def index_rows(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, float, str, int, list[str], float]]:
    """Postings: word, weight, label, the word's place counted from a key phrase's start, the phrase, the weight of all postings of the two."""
    of = {t.label: {w for k in (*t.keys, t.notice) for w in k.split()} for t in templates}
    df: dict[str, int] = {}
    for words in of.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    idf = {w: 1 + math.log(len(templates) / n) for w, n in df.items() if w not in FUNCTION_WORDS and not w.isdigit()}
    rows = []
    for t in templates:
        for key in t.keys:
            phrase = key.split()
            notice = t.notice.split()
            at = next((i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase), None)
            around = list(enumerate(notice, -at)) if at is not None else list(enumerate(phrase))
            whole = sum(idf.get(w, 0.0) for _, w in around)
            rows += [(w, idf[w], t.label, i, phrase, whole) for i, w in around if w in idf]
    return rows


def _phrase_pattern(phrases: list[str]) -> str:
    alternatives = "|".join(f"{_SEP}+".join(p.split()) for p in phrases)
    return f"(?i)(?<!{_WORD})(?:{alternatives})(?!{_WORD})"


def _n_words(text: Column) -> Column:
    """Number of words; an empty part at either end of the split is none."""
    parts = F.split(text, f"{_SEP}+", -1)
    edges = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - edges, F.lit(0))


def _any_case(word: str) -> str:
    """Matches an ASCII word in either case, by classes, which the matcher tests faster than a case flag."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _needed(phrases: list[str]) -> str:
    """A cheap pattern that every text with one of the phrases matches: the longest word of each."""
    longest = {max(p.split(), key=len) for p in phrases}
    return "|".join(_any_case(w) if len(w) > 3 else f"(?<![A-Za-z0-9]){_any_case(w)}(?![A-Za-z0-9])" for w in sorted(longest))


def _places(text: Column, phrases: dict[str, str]) -> Column:
    """Array of (at: word number, label) of all places of the phrases."""
    pattern = _phrase_pattern(list(phrases))
    none = F.array().cast("array<struct<at:int,label:string>>")
    label = lambda hit: F.coalesce(*[F.when(hit.rlike("^" + _phrase_pattern([p])), F.lit(name)) for p, name in phrases.items()])

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + _n_words(x["gap"])
        seen = F.when(x["hit"].isNotNull(), F.concat(acc["out"], F.array(F.struct(at.alias("at"), label(x["hit"]).alias("label"))))).otherwise(acc["out"])
        return F.struct((at + F.coalesce(_n_words(x["hit"]), F.lit(0))).alias("at"), seen.alias("out"))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(_needed(list(phrases))), found).otherwise(none)


def template_matches(rows: DataFrame, keys: list[str], text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``keys``, label, score: the templates accepted in each row; rows that share ``keys`` must share the text."""
    index = index_rows(templates)
    known = sorted({w for w, *_ in index})
    # How far before and after an indexed word a phrase that it proposes may reach.
    before = max(0, *(place for *_, place, _, _ in index))
    after = max(len(phrase) - place for *_, place, phrase, _ in index)
    cand = rows.where(F.col(text_col).rlike(_needed([" ".join(phrase) for *_, phrase, _ in index])))
    words = F.transform(F.filter(F.split(text_col, f"{_SEP}+", -1), lambda w: w != ""), lambda w: F.lower(w))
    cand = cand.select(*keys, words.alias("words"))
    indexed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(known))
    # An occurrence carries the words that a phrase may stand on in place of the whole file.
    first = lambda x: F.greatest(x["i"] - before, F.lit(0))
    seen = F.transform(indexed, lambda x: F.struct(x["w"].alias("w"), x["i"].alias("i"), F.slice("words", first(x) + 1, before + after).alias("near")))
    hits = cand.select(*keys, F.explode(seen).alias("x"))
    entries = [F.struct(F.lit(w).alias("word"), F.lit(idf).alias("idf"), F.lit(label).alias("label"), F.lit(place).alias("place"), F.array(*map(F.lit, phrase)).alias("phrase"), F.lit(whole).alias("whole")) for w, idf, label, place, phrase, whole in index]
    postings = rows.sparkSession.range(1).select(F.inline(F.array(*entries)))
    hits = hits.join(F.broadcast(postings), F.col("x.w") == F.col("word")).withColumn("at", F.col("x.i") - F.col("place")).where("at >= 0")
    # The window of an occurrence holds the phrase's whole place, so each posting tells by itself whether the phrase stands there.
    stands = F.slice("x.near", F.col("at") - first(F.col("x")) + 1, F.size("phrase")) == F.col("phrase")
    # A set, since rows with the same keys bring the same postings again.
    starts = hits.where(stands).groupBy(*keys, "label", "at", "phrase", "whole").agg(F.collect_set(F.struct("place", "idf")).alias("agree"))
    weight = F.aggregate("agree", F.lit(0.0), lambda total, p: total + p["idf"])
    return starts.groupBy(*keys, "label").agg(F.max(F.least(F.lit(1.0), weight / F.col("whole"))).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, places (array of at and label), base_labels and labels (arrays), score."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = src.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.crc32("text")})
    found = template_matches(keyed, ["k1", "k2"]).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    base = keyed.select("id", "k1", "k2", _n_words(F.col("text")).cast("long").alias("n_words"), _places(F.col("text"), BASE_PHRASES).alias("places"))
    out = base.join(found, ["k1", "k2"], "left")
    own = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return out.select(F.col("id").alias(id_col), "n_words", "places", own.alias("base_labels"), both.alias("labels"), score.alias("score"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
