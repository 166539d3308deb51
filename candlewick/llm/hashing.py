"""Vectorised content hashes of bytes and words, in numpy.

``Field`` is what decides equality: a polynomial over the prime field of 2**61 - 1, so that two different strings of n
characters agree at a random base with a chance of n / 2**61 at most, whatever their structure. ``Prefix`` works modulo
2**64, where strings exist that agree at every base (Thue-Morse words and their mirrors); it only orders and buckets.
"""

from __future__ import annotations

import numpy as np

#: Odd, 3 or 5 modulo 8, so that its powers differ early.
BASE = 0x9E3779B97F4A7C15 | 5
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
BASE_2 = 0xC2B2AE3D27D4EB4F
#: Random 64-bit values for each byte, two sets that are independent: with both, a hash has 128 bits.
BYTE_CODE, BYTE_CODE_2 = (np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240131, 20240132))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept, and grown when more are asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's finaliser: spreads every bit over all bits."""
    h = h ^ (h >> _S)
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


class Prefix:
    """Hashes of any run of a sequence of 64-bit codes: two look-ups and a product each."""

    def __init__(self, codes: np.ndarray, base: int = BASE):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(base, len(codes)), out=self.sums[1:])
        self.back = powers(pow(base, -1, 2**64), len(codes) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` codes at each place that has room for it."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n])


#: The prime of the field, and a base of it for each of two independent hashes.
P61 = np.uint64(2**61 - 1)
FIELD_BASE, FIELD_BASE_2 = 0x1B0A7D5C3E91F24D % (2**61 - 1), 0x0E9C51F7A83D6B25 % (2**61 - 1)
_31, _30, _61, _32, _29 = (np.uint64(k) for k in (31, 30, 61, 32, 29))
_L31, _L30, _L32, _L29 = (np.uint64(2**k - 1) for k in (31, 30, 32, 29))
#: Characters whose products are summed without overflow, and bytes of words that are hashed at once: about ten arrays of
#: eight times that size are held.
FIELD_RUN, WORD_RUN = 1 << 21, 1 << 18

_field_powers: dict[int, np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """Modulo 2**61 - 1, of any 64-bit values."""
    x = (x & P61) + (x >> _61)
    return np.where(x >= P61, x - P61, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _L31, b >> _31, b & _L31
    middle = a1 * b0 + a0 * b1
    return fold(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _L30) << _31) + a0 * b0)


def field_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**61 - 1; kept, and grown by doubling."""
    have = _field_powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), int(P61))))])
        _field_powers[base] = have
    return have[:n]


class Field:
    """Hashes of any run of a sequence, over the prime field: sums of low and high halves, reduced when a run is asked for.

    ``codes`` are bytes (uint8, FIELD_RUN of them at most) or 64-bit codes.
    """

    def __init__(self, codes: np.ndarray, base: int = FIELD_BASE):
        n = len(codes)
        power = field_powers(base, n)
        if codes.dtype == np.uint8:
            if n > FIELD_RUN:
                raise ValueError("hash long texts in pieces")
            code = codes.astype(np.uint64) + np.uint64(1)
            low, high = code * (power & _L32), code * (power >> _32)
        else:
            term = times(fold(codes), power)
            low, high = term & _L32, term >> _32
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])
        self.back = field_powers(pow(base, -1, int(P61)), n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of each run, from the power of its start on."""
        high = fold(self.high[end] - self.high[start])
        return fold(fold(self.low[end] - self.low[start]) + (high >> _29) + ((high & _L29) << _32))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(times(self.raw(start, end), self.back[start]))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the run of ``width`` codes at each place that has room for it."""
        n = len(self.low) - width
        at = np.arange(max(n, 0))
        return self.of(at, at + width)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes other than ASCII white space), and the words before each document."""
    word = ~IS_SPACE[data]
    begins, ends = word.copy(), word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, base: int = FIELD_BASE) -> np.ndarray:
    """A hash of each word, about WORD_RUN bytes at once; words that are longer by themselves go piece by piece."""
    size, out, first = WORD_RUN, np.empty(len(starts), np.uint64), 0
    piece = (lambda a, b: LOWER[data[a:b]]) if lower else (lambda a, b: data[a:b])
    while first < len(starts):
        begin, last = int(starts[first]), int(np.searchsorted(ends, int(starts[first]) + size, side="right"))
        if last > first:
            out[first:last] = Field(piece(begin, int(ends[last - 1])), base).of(starts[first:last] - begin, ends[first:last] - begin)
            first = last
            continue
        end, total = int(ends[first]), 0
        for at in range(begin, end, size):
            run = piece(at, min(at + size, end))
            total += int(Field(run, base).raw(np.array([0]), np.array([len(run)]))[0]) * pow(base, at - begin, int(P61))
        out[first] = mix(np.array([total % int(P61)], np.uint64))[0]
        first += 1
    return out
