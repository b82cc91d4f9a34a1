"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from geoexposure.llm.shared import id_and_text, slices

# The kinds in the order in which spans at the same place are listed; base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
# Lengths of account numbers by country (ISO 13616).
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18,
    "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
# Score of a confirmed span by kind, and the words that raise it when they stand shortly before.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Added to the score for a context word; a span of an added kind needs LEAST.
BONUS, LEAST, WINDOW = 0.3, 0.5, 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is left at its start only, so a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest local part before an @, no further back than the last match's end."""
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2])
        account, end = "", m.start()
        while length and end < m.end() and len(account) < length:
            account += text[end].strip()
            end += 1
        whole = end == len(text) or not text[end].isalnum()
        if length and len(account) == length and whole and mod97(account):
            yield m.start(), end


def _proposed(text: str) -> Iterator[tuple[int, int, int]]:
    if "@" in text:
        yield from ((0, a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield 1, m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            yield 2, m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield 3, m.start(), m.end()
    yield from ((4, a, b) for a, b in _ibans(text))
    yield from ((5, m.start(), m.end()) for m in _SSN.finditer(text))


def find(text: str) -> list[Span]:
    """The spans of a whole text by start, then kind; code points, end exclusive.

    Kinds do not exclude each other. Spans of the base kinds stay whatever their score; those of the added kinds
    (account numbers that pass mod-97, social security numbers) need a score of LEAST.
    """
    found = []
    for kind, start, end in _proposed(text):
        name = KINDS[kind]
        near = text[max(0, start - WINDOW) : start].lower()
        score = min(1.0, SCORE[name] + BONUS * any(w in near for w in CONTEXT[name]))
        if name in BASE or score >= LEAST:
            found.append(Span(start, kind, end, score))
    return sorted(found)


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s in find(text):
        if s.start >= at:
            out += [text[at : s.start], f"<{KINDS[s.kind]}>"]
            at = s.end
    return "".join([*out, text[at:]])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [find(t or "") for t in part.column("text").to_pylist()]
        columns = {"doc_id": part.column("doc_id")}
        for k, name in enumerate(BASE):
            columns[f"n_{name}"] = pa.array([sum(s.kind == k for s in f) for f in found], pa.int64())
        base = [",".join(str(s) for s in f if s.kind < len(BASE)) for f in found]
        columns["base_sha256"] = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base])
        columns["spans"] = pa.array([",".join(map(str, f)) for f in found], pa.string())
        columns["scores"] = pa.array([",".join(f"{s.score:.2f}" for s in f) for f in found], pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, hash of the base spans, all spans and their scores.

    A null text counts as empty: no spans, zero counts, the hash of the empty string. Rows are handled on
    their own, without a shuffle, so repeats, null ids and other columns change nothing; an empty table
    gives an empty table. A text of any length is read once for each kind.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return id_and_text(docs).mapInArrow(_report, schema)
