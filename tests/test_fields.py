import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trailweave.functions import polynomials as P
from trailweave.functions.field import Field, byte_field, field, field_degree


@pytest.mark.parametrize("d", range(2, 7))
def test_field_laws(d):
    f = field(d)
    for a, b, c in itertools.product(range(0, f.size, 3), range(f.size), range(0, f.size, 5)):
        assert f.multiply(a, b) == f.multiply(b, a)
        assert f.multiply(a, b ^ c) == f.multiply(a, b) ^ f.multiply(a, c)
    assert all(any(f.multiply(a, b) == 1 for b in range(f.size)) for a in range(1, f.size))


def test_only_primitive_polynomials_make_a_field():
    for bad in (31, 73, 87, 117):
        with pytest.raises(ValueError):
            Field(P.degree(bad), bad)
    assert byte_field().size == 256


def test_known_primitives():
    assert [field(d).poly for d in range(3, 8)] == [11, 19, 37, 67, 131]
    assert [field_degree(k) for k in (1, 2, 3, 4, 8)] == [3, 4, 4, 5, 6]


def test_irreducible_by_trial_division():
    for d in range(1, 8):
        made = {P.multiply(a, b) for a in range(2, 1 << d) for b in range(2, 1 << d)}
        assert P.irreducible(d) == [p for p in range(1 << d, 2 << d) if p not in made]


@given(st.integers(0, 4095), st.integers(0, 4095), st.integers(1, 255))
def test_polynomial_laws(a, b, m):
    assert P.degree(P.multiply(a, b)) == (P.degree(a) + P.degree(b) if a and b else -1)
    assert P.mod(P.multiply(a, b), m) == P.mod(P.multiply(P.mod(a, m), P.mod(b, m)), m)
    assert P.degree(P.mod(a, m)) < P.degree(m)
    assert P.gcd(P.multiply(a, m), m) == m
    assert P.mod_pow(a, 5, m) == P.mod(P.multiply(a, P.multiply(P.multiply(a, a), P.multiply(a, a))), m)


def test_small_helpers():
    assert P.degrees(0b1011) == [3, 1, 0]
    assert P.from_bytes(b"\xff\x05", 4) == 0b10101
    assert P.is_irreducible(P.random_irreducible(9, 1))
    assert P.reduce_exponent(1, 0b1011) == P.mod(0b100 ^ 0b10, 0b1011)


@pytest.mark.parametrize("d", range(3, 8))
def test_sampled_polynomials_are_primitive(d):
    drawn = [P.random_primitive(d, seed) for seed in range(200)]
    assert set(drawn) == set(P.primitive(d)) and drawn == [P.random_primitive(d, seed) for seed in range(200)]
