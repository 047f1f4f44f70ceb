"""Plain counterparts of the training-data operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(AZ))
        if item is not None and words:
            n = min(13, len(words))
            for i in range(len(words) - n + 1):
                windows[tuple(words[i : i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        words = word.findall((text or "").translate(AZ))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if w := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= w
        yield doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def components(docs, length=5, percent=80):
    """Rows (doc_id, n_shingles, component); docs: (doc_id, text), null ids linked with nothing."""
    sets = []
    for doc, text in docs:
        words = WORD.findall((text or "").translate(AZ))
        sets.append((doc, frozenset([tuple(words)] if 0 < len(words) < length else [tuple(words[i : i + length]) for i in range(len(words) - length + 1)])))
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return [(doc, len(s), None if doc is None else find(doc)) for doc, s in sets]


def without_repeats(docs):
    """Rows (doc_id, n_words, n_removed, digest); rows that share an id count as one place each."""
    rows = [(-1 if doc is None else doc, doc, WORD.findall(text or "")) for doc, text in docs]
    first = {}
    for key, _, words in rows:
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            first[w] = min(first.get(w, (key, i)), (key, i))
    for key, doc, words in rows:
        gone = set()
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] < (key, i):
                gone.update(range(i, i + 20))
        kept = [w for i, w in enumerate(words) if i not in gone]
        yield doc, len(words), len(gone), sha(" ".join(kept))


def personal(text):
    text, out = text or "", []
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    for k, (kind, pattern) in enumerate(zip(("email", "ip", "card", "phone"), patterns)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(v // 10 + v % 10 for v in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def line_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered), failed
