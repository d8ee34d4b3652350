"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes,
plus signs, digits and identifier cues in one pass over the text; a deterministic parser
expands each anchor to the boundaries of an address or account and validates it.

Base kinds (patterns of the contract, leftmost and non-overlapping per kind, a failing match
is dropped and not retried): email, ip, card, phone. Added kinds: ``login`` (a url with user
information), ``iban`` (checked by its remainder) and ``ssn`` (after its cue)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, table

KINDS = ["email", "ip", "card", "phone", "login", "iban", "ssn"]
BASE = KINDS[:4]
# Identifier cues.
CUES = {"iban": ["IBAN", "iban", "Iban"],
        "ssn": ["SSN", "ssn", "Social Security Number", "social security number", "Social security number"]}
SPANS = "array<struct<kind:string,start:int,end:int>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
LOGIN = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[\s:=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[\s:=#]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, what in [("@", "@"), ("://", ":"), ("+", "+"), *((d, "0") for d in "0123456789"),
                       *((w, k) for k, words in CUES.items() for w in words)]:
        a.add_word(word, (what, len(word)))
    a.make_automaton()
    return a


def find_spans(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by kind as listed in KINDS, then start. Every parser
    starts behind its kind's last match, so the work is linear in the text."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (what, n) in anchors.iter(text):
        at, after = last - n + 1, last + 1
        if what == "0":
            if at >= done["ip"]:
                if m := IP.match(text, at):
                    done["ip"] = m.end()
                    if all(map(small, m.group().split("."))):
                        found["ip"].append(m.span())
                else:  # no later start inside this dotted run can match
                    done["ip"] = DOTTED.match(text, at).end()
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, after)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif what == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif what == ":":
            scheme = SCHEME.search(text[max(0, at - 16):at])
            if at >= done["login"] and scheme and (m := LOGIN.match(text, after)):
                done["login"] = m.end()
                found["login"].append((at - len(scheme.group()), m.end()))
        elif at >= done[what] and not text[max(0, at - 1):at].isalnum():
            m = (IBAN if what == "iban" else SSN).match(text, after)
            if m and (what == "ssn" or iban_ok(m.group(1))):
                done[what] = m.end()
                found[what].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Each group of overlapping spans becomes the upper-case kind of its first span in <>."""
    out, at, end = [], 0, -1
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = end = max(end, e)
    return text if not spans else "".join([*out, text[at:]])


def pii_spans(text: Column) -> Column:
    """Array of (kind, start, end) in code points, end exclusive; null and empty texts have none."""
    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = automaton()
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, anchors)] for t in texts], dtype=object)
    return spans(text)


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind; null stays null."""
    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = automaton()
        for texts in batches:
            yield pd.Series([redact_text(t, find_spans(t, anchors)) for t in texts], dtype=object)
    return redact(text)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the span array ``into`` (replacing a column of that name). One row per
    row, repeated rows stay; null and empty texts have no spans; texts are read whole."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, pii_spans(F.col(text)))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` redacted; other columns, rows and null texts stay as they are."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, redacted(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The added kinds have names of their own, so the counts are those of the base spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
