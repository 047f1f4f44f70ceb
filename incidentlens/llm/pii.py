"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds and how they are accepted
* ``email`` ``ip`` ``card`` ``phone``: the pattern and its check alone (part values, Luhn, digit
  count). They score 1 and are accepted whatever stands near.
* ``iban``: mod-97 must hold; ``key``: access keys with a fixed prefix.
* ``ssn``, ``birth``, ``secret``: weak patterns, accepted only when a context word within CONTEXT_CHARS lifts
  their score to MIN_SCORE. A ``secret`` is a run of SECRET_CHARS or more letters, digits and ``_+/-`` with both
  letters and digits and an entropy of SECRET_BITS a character or more.

Spans are in code points, end exclusive, leftmost and non-overlapping within each kind. A null text
has no spans. Patterns are written so that long runs of digits or letters take linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame

from incidentlens.llm.tables import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "birth", "key", "secret")
MIN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_SCORE = 0.4
SECRET_CHARS, SECRET_BITS = 20, 3.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36})(?![A-Za-z0-9])")
_SECRET = re.compile(rf"[A-Za-z0-9_+/-]{{{SECRET_CHARS},}}+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W\d_]+")

# Words that make a weak proposal likely.
CONTEXT = {
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "birth": {"birth", "born", "dob", "birthday", "geboren", "nacido", "nacida", "né", "née"},
    "secret": {"token", "secret", "secrets", "key", "apikey", "password", "passwd", "passwort", "contraseña", "credential", "credentials"},
}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character, from the shares of the different characters."""
    shares = [n / len(text) for n in Counter(text).values()]
    return -sum(p * log2(p) for p in shares)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for match in _SECRET.finditer(text):
        run = match.group().strip("_+/-")
        if len(run) < SECRET_CHARS or run.isalpha() or not any(map(str.isalpha, run)):
            continue
        if any(map(str.isdigit, run)) and entropy(run) >= SECRET_BITS:
            start = match.start() + match.group().index(run)
            yield start, start + len(run)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # end of the match before
    for match in _DOMAIN.finditer(text):
        at = match.start()
        # The local part reaches back over all characters of its class, as a leftmost search finds it.
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, match.end()
            free = match.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> Iterator[Span]:
    """All pattern matches that pass their check, with the score the match has by itself."""
    if "@" in text:
        for start, end in _emails(text):
            yield Span("email", start, end, 1.0)
    for m in _IP.finditer(text):
        parts = (part.lstrip("0") for part in m.group().split("."))
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield Span("ip", m.start(), m.end(), 1.0)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield Span("card", m.start(), m.end(), 1.0)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                yield Span("phone", m.start(), m.end(), 1.0)
    for m in _IBAN.finditer(text):
        compact = m.group().replace(" ", "")
        if 15 <= len(compact) <= 34 and mod97(compact):
            yield Span("iban", m.start(), m.end(), 0.9)
    for kind, pattern in (("ssn", _SSN), ("birth", _BIRTH)):
        for m in pattern.finditer(text):
            yield Span(kind, m.start(), m.end(), 0.3)
    for m in _KEY.finditer(text):
        yield Span("key", m.start(), m.end(), 0.9)
    for start, end in _secrets(text):
        yield Span("secret", start, end, 0.3)


def spans(text: str | None) -> list[Span]:
    """Accepted spans by start, then by the order of KINDS."""
    out = []
    for span in proposals(text or ""):
        if span.score < MIN_SCORE:
            near = text[max(0, span.start - CONTEXT_CHARS) : span.end + CONTEXT_CHARS].lower()
            if not CONTEXT[span.kind].isdisjoint(_WORD.findall(near)):
                span = Span(span.kind, span.start, span.end, span.score + CONTEXT_SCORE)
        if span.score >= MIN_SCORE:
            out.append(span)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str | None, found: list[Span]) -> str | None:
    """Each run of overlapping spans replaced by the kind of its first one, as ``<EMAIL>``."""
    if not found:
        return text
    out, done, covered = [], 0, -1
    for span in found:
        if span.start >= covered:
            out += [text[done : span.start], f"<{span.kind.upper()}>"]
        done = covered = max(covered, span.end)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the accepted ``found`` spans, and the ``redacted`` text (null stays null)."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    span = "array<struct<kind: string, start: int, end: int, score: double>>"

    def make():
        def run(columns):
            found = [spans(value) for value in columns[text]]
            return {
                **{c: columns[c] for c in keep},
                "found": [[s.__dict__ for s in row] for row in found],
                "redacted": [redacted(t, row) for t, row in zip(columns[text], found)],
            }

        return run

    chosen = docs.select(*dict.fromkeys([*keep, text]))
    return map_batches(chosen, make, ", ".join([*fields, f"found {span}", "redacted string"]), text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the accepted spans of the text column replaced; all else is passed through."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def make():
        return lambda columns: {**columns, text: [redacted(t, spans(t)) for t in columns[text]]}

    return map_batches(docs, make, ", ".join(fields), text)
