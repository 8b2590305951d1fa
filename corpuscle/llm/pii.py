"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_bytes

#: Kinds in the order of results: the base kinds, whose spans always stay, then those that need a score.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: Scored spans below this are dropped. A checksum or a fixed format gives a start, words nearby add or take away.
LEAST_SCORE, NEAR_CHARS, WORD_BONUS, WORD_MALUS = 0.6, 48, 0.35, 0.35
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
FOR = {
    "email": "mail e-mail email contact write",
    "ip": "ip address host server login",
    "card": "card credit visa mastercard payment account",
    "phone": "phone tel telephone call mobile fax contact",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security taxpayer",
    "local_phone": "phone tel telephone call mobile fax cell",
}
AGAINST = {"email": "", "ip": "version release build section chapter", "card": "order serial isbn invoice tracking", "phone": "order serial", "iban": "", "ssn": "order serial part isbn invoice", "local_phone": "order serial part isbn invoice"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
NOT_DIGITS = re.compile(r"[^0-9]+")
WORDS = re.compile(r"[a-z]+(?:-[a-z]+)?")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """The check of payment cards: doubled every second digit from the right, the digit sum is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: country and check digits moved to the end, letters as 10 to 35, modulo 97 is 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # as the pattern local+@domain would match from left to right, but in linear time: only an @ can end a local part
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # as number.number.number.number would match from left to right, but in linear time: numbers joined by dots, by fours
    for m in NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for s, e in _ips(text):
        yield "ip", s, e
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        yield "ssn", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {*WORDS.findall(text[max(0, start - NEAR_CHARS) : start].lower()), *WORDS.findall(text[end : end + NEAR_CHARS // 2].lower())}
    bonus, malus = WORD_BONUS * bool(near & {*FOR[kind].split()}), WORD_MALUS * bool(near & {*AGAINST[kind].split()})
    return round(min(1.0, max(0.0, START[kind] + bonus - malus)), 4)


def find(text: str) -> list[Span]:
    """The spans of a text by kind, then start, in code points; scored kinds leave room to the base kinds."""
    spans = [Span(kind, s, e, _score(kind, text, s, e), kind in BASE) for kind, s, e in _proposed(text)]
    starts, ends = [], []  # of the base spans, those that overlap joined
    for s, e in sorted((x.start, x.end) for x in spans if x.base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    free = lambda x: (k := bisect_left(starts, x.end)) == 0 or ends[k - 1] <= x.start
    return [x for x in spans if x.base or x.score >= LEAST_SCORE and free(x)]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            out += [text[at : x.start], f"<{x.kind.upper()}>"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, spans)``, a row for each row of ``docs``: kind, start, end (code points, exclusive), score and base.

    A null or empty text has no spans; repeated rows and null ids pass as they are; other columns play no part.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x._asdict() for x in find(str(v.as_py(), "utf-8", "replace"))] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=schema.names)

    return docs.select(F.col(id_col), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; null texts stay null, other columns as they are."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted(t, find(t)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=schema.names)

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema)  # plain names on the way
