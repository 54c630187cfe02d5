"""Field arithmetic, polynomials over GF(2) and keyed hashing."""
