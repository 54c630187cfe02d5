"""Polynomials over GF(2) as integers: bit i is the coefficient of x^i.

Plain functions serve the driver (choosing a field); ``col_*`` build the same as column
expressions.
"""

from __future__ import annotations

import hashlib
import itertools
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions import prf

X, ONE = 2, 1


def degree(p: int) -> int:
    """Leading degree; -1 for the zero polynomial."""
    return p.bit_length() - 1


def has_degree(p: int, d: int) -> bool:
    return bool(p >> d & 1)


def degrees(p: int) -> list[int]:
    """Degrees of the set coefficients, descending."""
    return [d for d in range(degree(p), -1, -1) if has_degree(p, d)]


def from_bytes(raw: bytes, d: int) -> int:
    """The monic polynomial of degree d with its low coefficients from ``raw``, the last byte lowest."""
    return (int.from_bytes(raw, "big") & ((1 << d) - 1)) | 1 << d


def add(a: int, b: int) -> int:
    return a ^ b


def multiply(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return out


def mod(a: int, m: int) -> int:
    if not m:
        raise ZeroDivisionError("polynomial modulo zero")
    d = degree(m)
    while degree(a) >= d:
        a ^= m << (degree(a) - d)
    return a


def gcd(a: int, b: int) -> int:
    while b:
        a, b = b, mod(a, b)
    return a


def mod_pow(a: int, e: int, m: int) -> int:
    out, a = mod(ONE, m), mod(a, m)
    while e:
        if e & 1:
            out = mod(multiply(out, a), m)
        a, e = mod(multiply(a, a), m), e >> 1
    return out


def reduce_exponent(p: int, m: int) -> int:
    """(x^(2^p) - x) mod m."""
    x = mod(X, m)
    for _ in range(p):
        x = mod(multiply(x, x), m)
    return x ^ mod(X, m)


def is_irreducible(p: int) -> bool:
    """Ben-Or: no factor of degree i up to half the degree divides x^(2^i) - x. Constants
    are not irreducible; x and x + 1 are."""
    d = degree(p)
    if d < 1:
        return False
    return all(degree(gcd(p, reduce_exponent(i, p))) == 0 for i in range(1, d // 2 + 1))


def _prime_factors(n: int) -> set[int]:
    out, q = set(), 2
    while q * q <= n:
        while n % q == 0:
            out.add(q)
            n //= q
        q += 1
    return out | ({n} if n > 1 else set())


def is_primitive(p: int) -> bool:
    """Irreducible, and x generates all non-zero elements modulo p."""
    d = degree(p)
    if d < 1 or not p & 1 or not is_irreducible(p):
        return False
    n = (1 << d) - 1
    return all(mod_pow(X, n // q, p) != 1 for q in _prime_factors(n)) if n > 1 else True


def irreducible(d: int) -> list[int]:
    return [p for p in range(1 << d, 2 << d) if is_irreducible(p)]


def primitive(d: int) -> list[int]:
    return [p for p in range(1 << d, 2 << d) if is_primitive(p)]


def random_irreducible(d: int, seed: int) -> int:
    """Rejection sampling among monic polynomials of degree d."""
    r = random.Random(seed)
    while True:
        p = r.getrandbits(d) | 1 << d
        if is_irreducible(p):
            return p


def random_primitive(d: int, seed: int) -> int:
    """Rejection sampling among the primitive polynomials of degree d: the first of a sequence
    of hashes of the seed that is one, so every driver draws the same."""
    for n in itertools.count():
        drawn = int.from_bytes(hashlib.md5(f"f:{seed}:{n}".encode()).digest()[:8], "big")
        p = drawn & (1 << d) - 1 | 1 << d
        if is_primitive(p):
            return p
    raise AssertionError


def col_degree(p: Column) -> Column:
    return F.when(p == 0, F.lit(-1)).otherwise(F.length(F.bin(p)) - 1)


def col_add(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def col_multiply(a: Column, b: Column, bits: int) -> Column:
    """Carry-less product; ``bits`` bounds the bits of b (products must fit 63 bits)."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseXOR(F.when(F.getbit(b, F.lit(i)) == 1, F.shiftleft(a.cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return out


def col_mod(a: Column, m: int, bits: int) -> Column:
    """Remainder by a constant polynomial; ``bits`` bounds the bits of a. The reduction is a
    sum over a's bits of x^i mod m, so it is one XOR for each bit."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseXOR(F.when(F.getbit(a, F.lit(i)) == 1, F.lit(mod(1 << i, m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def col_has_degree(p: Column, d: int) -> Column:
    return F.getbit(p, F.lit(d)) == 1


def col_degrees(p: Column, bits: int) -> Column:
    """Degrees of the set coefficients, descending; ``bits`` bounds the bits of p."""
    return F.filter(F.array(*[F.lit(d) for d in range(bits - 1, -1, -1)]), lambda d: F.getbit(p, d) == 1)


def col_shift_left(p: Column, n: int) -> Column:
    return F.shiftleft(p, n)


def col_bit_count(v: Column) -> Column:
    """Set bits of a number that is not negative, clear bits of one that is."""
    return F.when(v < 0, F.bit_count(F.bitwise_not(v))).otherwise(F.bit_count(v))


def col_compare(a: Column, b: Column) -> Column:
    return F.sign(a - b).cast("int")


def col_byte_bit(raw: Column, i: int) -> Column:
    """Bit i of a byte string; bit 0 is the lowest of its last byte."""
    byte = F.conv(F.hex(F.substring(raw, -(i // 8) - 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, F.lit(i % 8)) == 1


def col_from_bytes(raw: Column, d: int) -> Column:
    """As ``from_bytes``, for d up to 62."""
    low = F.conv(F.hex(F.substring(raw, -8, 8)), 16, -10).cast("long")
    return low.bitwiseAND((1 << d) - 1).bitwiseOR(1 << d)


def col_random(seed: int, key: Column, d: int) -> Column:
    """A monic polynomial of degree d (30 at most), drawn by hash for each key."""
    return prf.draw("p", seed, key).bitwiseAND((1 << d) - 1).bitwiseOR(1 << d)
