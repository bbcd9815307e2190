"""Keyed permutations of number ranges and of strings over alphabets: the base of collision-free surrogates.

``step`` moves a value one place along a single keyed cycle through its whole range: the cycle is the image of counting
under a Feistel network, so it has no fixed point, and two values never get the same result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import lru_cache

ROUNDS = 8


class Cycle:
    """A keyed cycle through 0 .. size - 1."""

    def __init__(self, size: int, key: bytes, tweak: str):
        self.size = size
        self.a = max(1, math.isqrt(size - 1) + 1)
        self.b = -(-size // self.a)
        self.keys = [hashlib.blake2b(f"{tweak}|{size}|{i}".encode(), key=key[:64], digest_size=32).digest() for i in range(ROUNDS)]

    def _f(self, i: int, x: int, mod: int) -> int:
        raw = hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.keys[i], digest_size=64).digest()
        if mod.bit_length() > 384:
            raw += b"".join(hashlib.blake2b(raw + bytes([j]), key=self.keys[i], digest_size=64).digest() for j in range(mod.bit_length() // 512 + 1))
        return int.from_bytes(raw, "big") % mod

    def _there(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + self._f(i, right, self.a)) % self.a
            else:
                right = (right + self._f(i, left, self.b)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - self._f(i, right, self.a)) % self.a
            else:
                right = (right - self._f(i, left, self.b)) % self.b
        return left * self.b + right

    def step(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next valid value after x on the cycle."""
        wide = self.a * self.b
        at = self._back(x)
        while True:
            at = (at + 1) % wide
            y = self._there(at)
            if y < self.size and valid(y):
                return y


@lru_cache(maxsize=4096)
def cycle(size: int, key: bytes, tweak: str) -> Cycle:
    return Cycle(size, key, tweak)


def number(digits: list[int], bases: list[int]) -> int:
    out = 0
    for d, b in zip(digits, bases, strict=True):
        out = out * b + d
    return out


def digits(value: int, bases: list[int]) -> list[int]:
    out = []
    for b in reversed(bases):
        value, d = divmod(value, b)
        out.append(d)
    return out[::-1]
