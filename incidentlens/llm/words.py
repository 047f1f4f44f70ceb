"""Words of texts as 64-bit numbers, and numbers of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# Numbers of words are kept per task up to this many, and dropped together beyond it.
CACHED_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIXER = np.uint64(0xD6E8FEB86659FD93)


class WordNumbers(dict):
    """64-bit numbers of words, given as bytes; kept as eight bytes each, which join fast."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        number = self[word] = xxhash.xxh64_digest(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def split_words(text: str | None, fold: bool = False) -> list[bytes]:
    """Words between ASCII white space (space and the characters 9 to 13), A-Z in lower case if asked."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if fold else data).split()


class _Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            more = len(self.up)
            self.up = np.concatenate([self.up, self.up * self.up[-1] * _BASE])
            self.down = np.concatenate([self.down, self.down * self.down[-1] * _INVERSE])
            assert len(self.up) == 2 * more


_powers = _Powers()


class Runs:
    """Numbers of any run of a word sequence: equal runs have equal numbers, wherever they stand.

    A run's number is a polynomial of its words' numbers modulo 2**64, taken from running sums.
    """

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        _powers.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * _powers.up[:n], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the runs from start to end (exclusive)."""
        return mixed((self.sums[end] - self.sums[start]) * _powers.down[start])

    def of_length(self, length: int) -> np.ndarray:
        """Numbers of all runs of a length, by start; none if the sequence is shorter."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:n]) * _powers.down[:n])


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIXER
    return values ^ (values >> np.uint64(29))


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as BIGINT."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def shingle_set(text: str | None, known: WordNumbers, length: int) -> np.ndarray:
    """Sorted distinct numbers of a text's runs of ``length`` words, A-Z folded; all its words if they are fewer."""
    numbers = known.of(split_words(text, fold=True))
    if not len(numbers):
        return np.zeros(0, np.uint64)
    return np.unique(Runs(numbers).of_length(min(length, len(numbers))))
