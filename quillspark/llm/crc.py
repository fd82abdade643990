"""crc32 of a concatenation from the parts' crc32 and lengths, as the zlib polynomial defines it."""

from __future__ import annotations

POLY = 0xEDB88320  # fixed value: the reflected crc32 polynomial


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo POLY, bits reflected (bit 31 is x^0)."""
    out = 0
    for i in range(32):
        if a >> (31 - i) & 1:
            out ^= b
        b = (b >> 1) ^ (POLY if b & 1 else 0)
    return out


def _power(n_bytes: int) -> int:
    """x^(8 n) modulo POLY."""
    out, square, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


class Joiner:
    """Joins crcs; the table for each length of a second part is kept."""

    def __init__(self, most: int = 5000):
        self.most, self.tables = most, {}

    def table(self, n: int) -> list[list[int]]:
        if n not in self.tables:
            if len(self.tables) >= self.most:
                self.tables.clear()
            p = _power(n)
            bit = [_times(1 << i, p) for i in range(32)]
            rows = []
            for k in range(4):
                row = [0] * 256
                for v in range(1, 256):
                    low = v & -v
                    row[v] = row[v ^ low] ^ bit[8 * k + low.bit_length() - 1]
                rows.append(row)
            self.tables[n] = rows
        return self.tables[n]

    def join(self, first: int, second: int, second_bytes: int) -> int:
        t = self.table(second_bytes)
        return t[0][first & 255] ^ t[1][first >> 8 & 255] ^ t[2][first >> 16 & 255] ^ t[3][first >> 24] ^ second
