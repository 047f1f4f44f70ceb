"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token with which the piece's encoding can end there
(its *last token*). ``PrefixEncoder`` stores these last tokens; the encoding is read off backwards.
A token may follow the last token before it only if byte-pair merging of the two tokens' bytes
gives back exactly these two. So appending bytes never changes stored entries, and an edit only
needs the entries behind it.

Definitions
* null text: encoded like empty text, no ids; null ids decode to no bytes;
* repeated rows: each gets its own row;
* invalid UTF-8 cannot occur in input; decoding gives bytes, whatever the ids say.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.tables import keep, map_batches

OWNER = "bpe"  # of the caches that workers keep from task to task

# Encodings of pieces, and which tokens go together, are kept per worker up to these numbers. Of pieces,
# those not asked for since half the number came in are dropped, the others altogether.
CACHED_PIECES = 250_000
CACHED_PIECE_CHARS = 64
# Beginnings of matches whose length is a multiple of this are remembered for other matches.
STRIDE = 3
CACHED_PAIRS = 200_000
CACHED_STARTS = 150_000
# What a pattern may be made of to be run by Python's own engine, which takes half the time.
_PLAIN = re.compile(r"(?:[A-Za-z' |+?]|\(\?!|\)|\[\^?|\]|\\[sS]|\\p\{[LN]\})*")
_WIDE = re.compile("[\U00010000-\U0010ffff]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank per line, as base64 and decimal."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Ranks in both directions, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.shift = max(ranks.values(), default=0).bit_length()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        # Tokens that merging yields from their own bytes; others only stand for a whole match.
        self.reachable = {t: r for t, r in ranks.items() if len(self.merged(t)) == 1}

    def merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain byte-pair merging, lowest rank first, leftmost on ties. For short data only.

        Only merges of a rank under ``below`` are made.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)
            )
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        if rank not in self._halves:
            parts = self.merged(self.bytes[rank], rank)
            self._halves[rank] = tuple(map(self.ranks.__getitem__, parts)) if len(parts) == 2 else None
        return self._halves[rank]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens, given by rank, stay as they are when their bytes are merged.

        Both are taken apart towards their common border, the one merged last first. If the parts at
        the border could merge earlier than they were merged away from it, the pair does not hold.
        """
        key = left << self.shift | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        data, ranks = self.bytes, self.ranks
        before = 1 << 60
        while True:
            joined = ranks.get(data[left] + data[right])
            if joined is not None and joined < before:
                return False
            whole_left, whole_right = self.halves(left), self.halves(right)
            if whole_left and (left > right or not whole_right):
                before, left = left, whole_left[1]
            elif whole_right:
                # a border merge of the same rank further left comes first
                before, right = right + 1, whole_right[0]
            else:
                return True


class PrefixEncoder:
    """The last token (as its rank) of every prefix of one growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", last: list[int] | None = None):
        """``last``: what is known already of a prefix of the data."""
        self.vocabulary = vocabulary
        self.last = list(last or ())
        self.data = bytearray(data[: len(self.last)])
        self.append(data[len(self.last) :])

    def append(self, more: bytes) -> None:
        voc, last = self.vocabulary, self.last
        get, longest, shift, known = voc.reachable.get, voc.longest, voc.shift, voc.pairs.get
        start = len(self.data)
        self.data += more
        data = bytes(self.data)
        for end in range(start + 1, len(data) + 1):
            # Only one token fits, so the order of trials is free; short ones are the likelier.
            for begin in range(end - 1, max(0, end - longest) - 1, -1):
                rank = get(data[begin:end])
                if rank is None:
                    continue
                if begin:
                    fits = known(last[begin - 1] << shift | rank)
                    if fits is None:
                        fits = voc.may_follow(last[begin - 1], rank)
                    if not fits:
                        continue
                last.append(rank)
                break
            else:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks single bytes")

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; entries in front of the edit stay as they are."""
        tail = bytes(self.data[stop:])
        del self.data[start:], self.last[start:]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, end, length = [], len(self.data), self.vocabulary.bytes
        while end:
            out.append(self.last[end - 1])
            end -= len(length[out[-1]])
        return out[::-1]


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern in a text, as the regex library finds them.

    Texts of characters up to U+FFFF are searched by Python's own engine, with letters, digits and spaces
    listed as the regex library tells them, where the pattern has no syntax besides.
    """
    full = regex.compile(pattern).findall
    if not _PLAIN.fullmatch(pattern):
        return full
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    kinds = {
        kind: "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for half in (every[:0xD800], every[0xD800:]) for run in regex.findall(kind + "+", half))
        for kind in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\[sS]|.", pattern):
        inside = part == "[" or inside and part != "]"
        if part == r"\S":
            if inside:
                return full
            part = f"[^{kinds[part.lower()]}]"
        elif part in kinds:
            part = kinds[part] if inside else f"[{kinds[part]}]"
        out.append(part)
    plain = re.compile("".join(out)).findall
    return lambda text: full(text) if _WIDE.search(text) else plain(text)


class Encoder(dict):
    """Whole texts: cut by the pattern, each match encoded for itself.

    The dictionary holds what is known of short matches: their ids as packed 32-bit numbers.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary = Vocabulary(ranks)
        self.find = finder(pattern)
        self.older: dict[str, bytes] = {}  # pieces that were known when the dictionary was last full
        self.starts: dict[bytes, list[int]] = {}  # last tokens of beginnings of matches
        tokens = [self.vocabulary.bytes.get(i, b"") for i in range(1 + max(self.vocabulary.bytes))]
        self.tokens = pa.array(tokens, pa.large_binary())

    def __missing__(self, part: str) -> bytes:
        packed = self.older.get(part)
        if packed is None:
            data = part.encode()
            rank = self.vocabulary.ranks.get(data)  # a whole match that is a token is taken as it is
            packed = array("i", [rank] if rank is not None else self.piece(data)).tobytes()
        if len(part) <= CACHED_PIECE_CHARS:
            if len(self) >= CACHED_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[part] = packed
        return packed

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match, from the longest beginning that an earlier match has left behind."""
        if len(data) > CACHED_PIECE_CHARS:
            return PrefixEncoder(self.vocabulary, data).ids()
        known = None
        for cut in range((len(data) - 1) // STRIDE * STRIDE, 0, -STRIDE):
            known = self.starts.get(data[:cut])
            if known:
                break
        encoder = PrefixEncoder(self.vocabulary, data, known)
        if len(self.starts) >= CACHED_STARTS:
            self.starts.clear()
        for cut in range((len(known or ()) // STRIDE + 1) * STRIDE, len(data) + 1, STRIDE):
            self.starts[data[:cut]] = encoder.last[:cut]
        return encoder.ids()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text or ""))), np.int32)

    def decode(self, ids: list) -> pa.Array:
        """The bytes of several lists of ids, null ones among them."""
        lists = [() if one is None else one for one in ids]
        ends = np.cumsum([0, *map(len, lists)])
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(one, np.int32) for one in lists)])
        taken = self.tokens.take(pa.array(flat))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(flat) + 1, taken.offset * 8)[ends]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), taken.buffers()[2]]).cast(pa.binary())


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``token_ids ARRAY<INT>``; the vocabulary is read on the executors."""

    def columns(encoder: Encoder, values: list) -> dict[str, list]:
        return {"token_ids": [encoder.encode(value) for value in values]}

    return _mapped(docs, text, "token_ids array<int>", ranks_path, pattern, columns)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` and ``decoded BINARY``."""

    def columns(encoder: Encoder, values: list) -> dict[str, list]:
        return {"decoded": encoder.decode(values)}

    return _mapped(docs, ids, "decoded binary", ranks_path, pattern, columns)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` in one pass of Python workers."""

    def columns(encoder: Encoder, values: list) -> dict[str, list]:
        ids = [encoder.encode(value) for value in values]
        return {"token_ids": ids, "decoded": encoder.decode(ids)}

    return _mapped(docs, text, "token_ids array<int>, decoded binary", ranks_path, pattern, columns)


def _mapped(docs: DataFrame, source: str, added: str, ranks_path: str, pattern: str, work) -> DataFrame:
    new = {part.split()[0] for part in added.split(", ")}
    docs = docs.drop(*(new - {source}))  # a column of the input with the same name gives way
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def make():
        keep(OWNER, _encoder.cache_clear)
        encoder = _encoder(ranks_path, pattern)
        return lambda columns: {**columns, **work(encoder, columns[source])}

    by_text = docs.schema[source].dataType.simpleString() == "string"
    return map_batches(docs, make, ", ".join([*fields, added]), source if by_text else None, OWNER)


def ids_text(ids: str = "token_ids") -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
