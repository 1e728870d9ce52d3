"""Operator 3: personal data by patterns, checksum validators and context words, in DataFrame functions only.

Each kind has a pattern whose matches are leftmost and do not overlap, a validator
(Luhn, mod-97, number ranges, digit counts) that drops a match for good, and context
words: one of them in the forty characters before a match, since the last match of its kind, raises
its score. A match whose score stays under its kind's least one is dropped. The
kinds email, ip, card and phone are the base, whose valid matches all stay; the method adds iban,
which needs mod-97; secret, whose value needs a letter and a digit, or else a context word;
and local_phone, which no checksum can tell from other numbers, so that only a context word keeps it.

Positions come from splitting the text by the same pattern: the lengths of the gaps
and matches, summed, are code points. Quantifiers that need no backtracking are
possessive, and look-behinds keep a pattern from starting inside a run that already
failed, so very long texts cost linear time and constant stack. There is no shuffle.

Defined cases: a null or empty text has no spans; null ids are carried through;
repeated rows are scanned each; extra columns are not read; an empty table gives an
empty result. Spans of different kinds may overlap; ``redacted`` merges those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"
CONTEXT_CHARS = 40


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(hit)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.when(F.length(d).between(16, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(hit: Column) -> Column:
    """15 to 34 letters and digits that leave 1 modulo 97 once the first four are moved to the end."""
    s = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.when(F.length(s).between(15, 34), F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1).otherwise(False)


def octets(hit: Column) -> Column:
    return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


@dataclass(frozen=True)
class Kind:
    """gate: a cheap condition that a text with a match meets; score: of a match without context, which adds 0.2;
    proof: the score is 0.2 less without it; least: matches under it are dropped."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    context: str
    score: float
    least: float = 0.0
    proof: Callable[[Column], Column] | None = None


_ANY = lambda hit: F.lit(True)
_MIXED = lambda hit: hit.rlike("[0-9][^\x22]*\x22$") & hit.rlike("[A-Za-z][^\x22]*\x22$")
_HAS_DIGIT = lambda text: text.rlike("[0-9]")

BASE = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), _ANY, r"e-?mail|contact|mailto|write", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), octets, r"\bip\b|address|host|server", 0.7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _HAS_DIGIT, luhn, r"card|visa|master|amex|credit|payment", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda h: F.length(_digits(h)).between(8, 15), r"phone|tel|call|mobile|fax", 0.7),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, r"iban|account|bank", 0.9),
    Kind("local_phone", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-]{0,2})\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda t: t.rlike("[0-9]{3}[ .-][0-9]{4}"), _ANY, r"phone|tel|call|mobile|fax", 0.5, 0.6),
    Kind("secret", r"(?i)(?<![a-z0-9])(?:api[_-]?key|token|secret|password|passwd)\s{0,4}[=:]\s{0,4}\x22[^\x22\s]{12,128}\x22", lambda t: t.rlike(r"(?i)(?:key|token|secret|password|passwd)\s{0,4}[=:]"), _ANY, r"key|auth|bearer|login|credential", 0.8, 0.75, _MIXED),
)


def spans_of(text: Column, kind: Kind) -> Column:
    """The kind's confirmed spans in a text that is not null: an array of kind, start, end, text, score."""
    none = F.array().cast(f"array<{_SPAN}>")
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        near = F.lower(F.substring(x["gap"], -CONTEXT_CHARS, CONTEXT_CHARS)).rlike(kind.context)
        proven = F.lit(kind.score) if kind.proof is None else F.when(kind.proof(x["hit"]), kind.score).otherwise(kind.score - 0.2)
        score = F.least(F.lit(1.0), proven + F.when(near, 0.2).otherwise(0.0))
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), score.alias("score"))
        kept = x["hit"].isNotNull() & F.coalesce(kind.valid(x["hit"]), F.lit(False)) & (score >= kind.least)
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"), F.when(kept, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(kind.gate(text), F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` and a column of spans, by kind in the order of ``kinds``, then by start. A column of that name already there raises."""
    if spans_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {spans_col} already")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(spans_col, F.concat(*[spans_of(text, k) for k in kinds]))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first span's kind, as ``<KIND>``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        new = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(fresh, new).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    joined = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [k.name for k in BASE]
    base = F.filter("pii_spans", lambda s: s["kind"].isin(names))
    kinds = F.transform("pii_spans", lambda s: s["kind"])
    counts = [(F.size("pii_spans") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{n}") for n in names]
    best = F.coalesce(F.array_max(F.transform("pii_spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii_spans")).alias("spans"), best.alias("best_score"))
