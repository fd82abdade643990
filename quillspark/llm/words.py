"""Words as numbers: dense ids, equal exactly where words are, and Rabin-Karp hashes of runs of words.

Words are runs of bytes other than space and 0x09-0x0D, as bytes.split() gives them. A word's value is
taken from its 128-bit hash; a run's hash is the polynomial of its words' values modulo the prime
2^61 - 1 at a fixed random base, so no arrangement of words meets another but by chance. Where equality
has to be certain, ids of the words themselves (or digests of them) are compared, never these hashes.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, islice

import numpy as np
import xxhash

PRIME = (1 << 61) - 1
BASES = (0x0C6EF372FE94F82B & PRIME, 0x1B873593CC9E2D51 & PRIME)
SLICE = 1 << 20  # bytes of text split into words at once
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME, both below it."""
    high, low = a >> np.uint64(31), a & _LOW31
    b_high, b_low = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    mid = low * b_high + high * b_low
    x = high * (b_high << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + low * b_low
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)  # below PRIME the difference wraps to a great number


def run_hashes(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of every run of width values, by doubling: runs of 1, 2, 4, ... put together.

    which chooses the base, another one for each number."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = pow(BASES[which & 1], which + 1, PRIME)

    def joined(left, right, size):
        """Runs of left with the runs of size that begin where they end."""
        x = times(left[: len(right)], pow(base, size, PRIME)) + right
        return np.minimum(x, x - _P)

    done, length, part, size = None, 0, values, 1
    while True:
        if width & size:
            done = part if done is None else joined(done, part[length:], size)
            length += size
        if size * 2 > width:
            return done[:n]
        part, size = joined(part, part[size:], size), size * 2


class Words:
    """Numbers words in the order they come."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)  # no cycle: it goes as soon as it is dropped
        self.known = np.zeros((1 << 12, 2), np.uint64)
        self.seen = 0

    def __len__(self) -> int:
        return len(self.ids)

    def numbers(self, raw: bytes) -> np.ndarray:
        """The ids of a text's words, read slice by slice."""
        parts = [np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)) for words in slices(raw)]
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def values(self, ids: np.ndarray, which: int = 0) -> np.ndarray:
        """The words' values below PRIME; even and odd kinds come from either half of a 128-bit hash."""
        more = len(self.ids) - self.seen
        if more:
            new = list(islice(reversed(self.ids), more))[::-1]
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), "<u8").reshape(-1, 2)
            if len(self.ids) > len(self.known):
                self.known = np.concatenate([self.known[: self.seen], np.zeros((max(more, len(self.known)) + len(self.known) - self.seen, 2), np.uint64)])
            self.known[self.seen : len(self.ids)] = both % _P
            self.seen = len(self.ids)
        return self.known[:, which & 1][ids]


def slices(raw: bytes):
    """The words of a text in lists; a long text is cut at white space about every SLICE bytes."""
    if len(raw) <= SLICE:
        yield raw.split()
        return
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].split()
        at = end
