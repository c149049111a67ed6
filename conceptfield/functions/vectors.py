"""Vectors of terms, signed permutations for roles and relations, and small vector algebra as Columns.

A term's own vector comes from MD5, so it is the same in every process. Roles and relations act as signed
permutations of coordinates: they keep lengths, traces and spectra, and different ones are nearly orthogonal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column) -> Column:
    """v over its length; null if the length is next to nothing."""
    def scaled(s: Column) -> Column:
        return F.when(s["n"] > 1e-10, F.transform(s["v"], lambda x: x / s["n"]))

    def measured(w: Column) -> Column:
        return F.struct(w.alias("v"), F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)).alias("n"))

    return let(let(v, measured), scaled)


def hash_vector(term: Column, dim: int) -> Column:
    """Unit vector of a term: coordinate i is the first 32 bits of md5(term:i), centred."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(term, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) - F.lit(0.5))
    return unit(raw)


def role_table(role: str, dim: int) -> tuple[list[int], list[float]]:
    """Signed permutation of a role or relation: coordinates in the order of md5(role:i), signs by its last digit's parity."""
    digests = [hashlib.md5(f"{role}:{i}".encode()).hexdigest() for i in range(dim)]
    order = sorted(range(dim), key=digests.__getitem__)
    return order, [1.0 if int(digests[i][-1], 16) % 2 == 0 else -1.0 for i in order]


def in_role(v: Column, role: str, dim: int) -> Column:
    """Coordinate i of the result is sign[i] times coordinate order[i] of v, which is computed once."""
    order, sign = role_table(role, dim)
    places = F.arrays_zip(F.array(*[F.lit(p) for p in order]).alias("p"), F.array(*[F.lit(s) for s in sign]).alias("s"))
    return let(v, lambda w: F.transform(places, lambda x: x["s"] * F.element_at(w, x["p"] + 1)))


def encode(noun: Column, verb: Column, quality: Column, intensity: Column) -> Column:
    """Unit vector of a judgment seen from one side: the other noun in its role plus, signed by quality and scaled by
    intensity, the verb in its role. Both are given as turned into their roles."""
    factor = F.when(quality == "NEGATIVE", -intensity).otherwise(intensity)
    return unit(F.zip_with(noun, verb, lambda a, b: a + factor * b))


def fitted(v: Column, dim: int) -> Column:
    """v cut or padded with zeros to dim, at unit length."""
    return unit(F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim))


def term_vectors(terms: DataFrame, dim: int, seeds: DataFrame | None = None, personal: DataFrame | None = None) -> DataFrame:
    """(term, vector) of terms(term): a personal vector if there is one, else a seed, else the hash vector.

    seeds and personal: (term, vector), one row a term.
    """
    out = terms.select("term").distinct()
    for name, table in (("personal", personal), ("seed", seeds)):
        if table is not None:
            out = out.join(table.select("term", fitted(F.col("vector"), dim).alias(name)), "term", "left")
    known = [F.col(n) for n, t in (("personal", personal), ("seed", seeds)) if t is not None]
    return out.select("term", F.coalesce(*known, hash_vector(F.col("term"), dim)).alias("vector"))
