"""SHA-256 draws of consecutive numbers, many at once in a task; the same numbers as stats.hash_fraction."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_ALL = 0xFFFFFFFF
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _fraction_bits(p: int, root: int) -> int:
    """First 32 bits of the fraction of the square or cube root of p."""
    low, high = 0, p << 32
    while low < high:  # the largest x with x^root <= p * 2^(32 root)
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**root <= p << (32 * root) else (low, mid - 1)
    return low & _ALL


_START, _ROUND = [_fraction_bits(p, 2) for p in _PRIMES[:8]], [_fraction_bits(p, 3) for p in _PRIMES]
#: Numbers hashed at once, so many that numpy's calls don't count and so few that their words stay near the processor, and the last
#: digits in which they differ.
WIDE, DIGITS = 25_000, 5


def _turned(x, n: int):
    if not isinstance(x, np.ndarray):
        return ((x >> n) | (x << (32 - n))) & _ALL
    out = x >> n
    out |= x << (32 - n)
    return out


def _mixed(x, p: int, q: int, r: int, shift: bool = False):
    """Exclusive or of three turns of a word, the last one a shift if asked for."""
    out = _turned(x, p)
    out ^= _turned(x, q)
    out ^= x >> r if shift else _turned(x, r)
    return out


def _sum(*xs):
    """Sum of 32-bit words, numbers or arrays of them."""
    known = sum(x for x in xs if not isinstance(x, np.ndarray)) & _ALL
    arrays = [x for x in xs if isinstance(x, np.ndarray)]
    if not arrays:
        return known
    total = arrays[0] + (arrays[1] if len(arrays) > 1 else known)
    for x in arrays[2:]:
        total += x
    if known and len(arrays) > 1:
        total += known
    return total


def _digest(words: list) -> tuple:
    """First two words of the digest of a message of one block of 16 words, each a number or an array of numbers."""
    w = list(words)
    a, b, c, d, e, f, g, h = _START
    for i, k in enumerate(_ROUND):
        x = w[i % 16]
        t = _sum(h, k, x, _mixed(e, 6, 11, 25), g ^ (e & (f ^ g)))
        u = _sum(t, _mixed(a, 2, 13, 22), b ^ ((a ^ b) & (b ^ c)))
        a, b, c, d, e, f, g, h = u, a, b, c, _sum(d, t), e, f, g
        if i < 48:  # the word of 16 rounds later
            w[i % 16] = _sum(x, _mixed(w[(i + 1) % 16], 7, 18, 3, True), w[(i + 9) % 16], _mixed(w[(i + 14) % 16], 17, 19, 10, True))
    return _sum(a, _START[0]), _sum(b, _START[1])


def fractions(prefix: str, start: int, end: int) -> Iterator[np.ndarray]:
    """First 52 bits of the SHA-256 of the prefix and each number in [start, end) as fractions in [0, 1), in order, by parts."""
    while start < end:
        text = str(start)
        to = min(end, start + WIDE, start // 10**DIGITS * 10**DIGITS + 10**DIGITS, 10 ** len(text))  # of as many digits, the first ones the same
        n, last = np.arange(start, to, dtype=np.int64), min(len(text), DIGITS)
        message = f"{prefix}{text}".encode()
        long = len(message)
        if long > 55:
            raise ValueError("the text is longer than one block")
        block = bytearray(message.ljust(64, b"\0"))
        block[long], block[56:] = 0x80, struct.pack(">Q", 8 * long)
        block[long - last : long] = b"0" * last
        words: list = list(struct.unpack(">16I", block))
        for k in range(last):
            at = long - 1 - k
            words[at // 4] = words[at // 4] + ((n // 10**k % 10) << (8 * (3 - at % 4))).astype(np.uint32)
        high, low = (x.astype(np.int64) for x in _digest(words))
        yield ((high << 20) | (low >> 12)) / float(1 << 52)
        start = to
