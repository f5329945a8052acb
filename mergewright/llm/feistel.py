"""Keyed permutations of numbers and dates within their format.

A balanced Feistel network over digit strings (cycle walking where the domain is
no product of equal halves): the result has as many digits, and equal values
have equal results under one key.
"""

from __future__ import annotations

import hashlib
import hmac
from datetime import date, timedelta
from math import isqrt

ROUNDS = 8


def _round(key: bytes, i: int, half: int, modulus: int, tag: bytes) -> int:
    d = hmac.new(key, b"%d|%d|%b" % (i, half, tag), hashlib.blake2b).digest()
    return int.from_bytes(d[:16], "big") % modulus


def permute(value: int, size: int, key: bytes, tag: bytes = b"", inverse: bool = False) -> int:
    """A permutation of range(size), by cycle walking in a square that holds it."""
    if not 0 <= value < size:
        raise ValueError("value outside the domain")
    if size < 2:
        return value
    side = isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                a, b = (b - _round(key, i, a, side, tag)) % side, a
            else:
                a, b = b, (a + _round(key, i, b, side, tag)) % side
        value = a * side + b
        if value < size:
            return value


def permute_digits(text: str, key: bytes, tag: bytes = b"", keep: int = 0) -> str:
    """The text with its digits permuted; other characters and the first
    ``keep`` digits stay."""
    at = [i for i, c in enumerate(text) if c in "0123456789"][keep:]
    if not at:
        return text
    digits = "".join(text[i] for i in at)
    out = list(text)
    for i, c in zip(at, str(permute(int(digits), 10 ** len(at), key, tag + b"%d" % len(at))).zfill(len(at))):
        out[i] = c
    return "".join(out)


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def permute_date(value: date, key: bytes) -> date:
    """Another day from 1900 to 2099; days outside stay."""
    n = (value - _FIRST).days
    return _FIRST + timedelta(permute(n, _DAYS, key, b"date")) if 0 <= n < _DAYS else value
