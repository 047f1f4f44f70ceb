"""Line-first cleaning: rules per line, failing lines go, then documents that lose too much go.

A line's rules (lines without a word never fail):
* punctuation: a symbol of SYMBOLS for every four words or more, or most words ending in ``!!``;
* navigation: four or more separators ``| > » •`` making up a quarter of the words, or at most four
  words all of which are menu words;
* boilerplate: a phrase of BOILERPLATE.

A document is rejected when its base rules fail, or when the failing lines hold more than
MAX_LOST_PERCENT of its word characters. Null text is text without words; an empty document fails the
base rules. Words are cut at ASCII white space only; whole texts are read, however long.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from incidentlens.llm.tables import map_batches

SYMBOLS = b"#*$%&|<>"
WHITE = b"\t\n\x0b\x0c\r "
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
WINDOW = 5
SEPARATORS = frozenset((b"|", b">", "»".encode(), "•".encode()))
MENU = frozenset(
    b"home menu login logout register search next previous prev back top contact about share"
    b" tweet print sitemap skip navigation archive archives categories".split()
)
BOILERPLATE = re.compile(
    rb"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept cookies"
    rb"|enable javascript|lorem ipsum|click here|subscribe to our newsletter|powered by",
    re.IGNORECASE,
)


def line_failure(line: bytes) -> str | None:
    """The rule that a line fails, or None."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if BOILERPLATE.search(line):
        return "boilerplate"
    separators = sum(word in SEPARATORS for word in words)
    if separators >= 4 and 4 * separators >= n or n <= 4 and all(w.lower() in MENU for w in words):
        return "navigation"
    shouts = line.count(b"!!")
    if 4 * count_symbols(line) >= n and n >= 4 or n >= 4 and 2 * shouts > n:
        return "punctuation"
    return None


def count_symbols(data: bytes) -> int:
    return len(data) - len(data.translate(None, SYMBOLS))


# Odd multipliers that turn the numbers of five neighbouring words into one 64-bit number.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the text has twice or more.

    Windows are compared as 64-bit combinations of word numbers, and those that look equal then word
    by word, so that the count is exact.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = ids * MULTIPLIERS[0]
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for j in range(window):
        keys += mixed[j : j + n] * MULTIPLIERS[j % 5] + np.uint64(j * j)
        keys ^= keys >> np.uint64(31)
        keys *= MULTIPLIERS[(j + 1) % 5]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    starts = np.zeros(n, bool)
    in_group = np.zeros(n, bool)
    in_group[1:] |= same
    in_group[:-1] |= same
    suspects = order[in_group]
    seen: dict[tuple, int] = {}
    for at in suspects.tolist():
        key = tuple(ids[at : at + window].tolist())
        first = seen.setdefault(key, at)
        if first != at:
            starts[first] = starts[at] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(starts), 1)
    np.add.at(covered, np.flatnonzero(starts) + window, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def clean(text: str | None) -> dict[str, object]:
    """Base statistics, cleaned text and verdict of one document."""
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(data.count(white) for white in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" "))
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    kept, duplicates, lost, removed = [], 0, 0, 0
    for line in lines:
        if line.translate(None, WHITE):
            duplicates += line in seen
            seen.add(line)
            if line_failure(line):
                removed += 1
                lost += len(line.translate(None, WHITE).decode())
                continue
        kept.append(line)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return {
        "cleaned": b"\n".join(kept).decode(),
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": count_symbols(data),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= MAX_LOST_PERCENT * chars,
        "n_lines_removed": removed,
        "lost_chars": lost,
    }


OUT = (
    "cleaned string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
    " n_repeat_words bigint, base_failed boolean, kept boolean, n_lines_removed bigint, lost_chars bigint"
)


def clean_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the cleaned text (failing lines removed), statistics and the verdict."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def make():
        def run(columns):
            found = [clean(value) for value in columns[text]]
            names = list(found[0]) if found else []
            return {c: columns[c] for c in keep} | {k: [f[k] for f in found] for k in names}

        return run

    chosen = docs.select(*dict.fromkeys([*keep, text]))
    return map_batches(chosen, make, ", ".join([*fields, OUT]), text)
