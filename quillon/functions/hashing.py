"""The 31-polynomial text hash in 32 bits and vectors drawn from it."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("long")


def signed_hex(h: Column) -> Column:
    digits = F.lower(F.hex(F.abs(h)))
    return F.lpad(F.when(h < 0, F.concat(F.lit("-"), digits)).otherwise(digits), 8, "0")


# Fixed values of the sequence: multiplier, increment, modulus.
LCG = (9301, 49297, 233280)


def lcg_jumps(size: int) -> tuple[list[int], list[int]]:
    """Factor and summand that lead from the start to each of the first states."""
    a, c, m = LCG
    factors, summands, f, s = [], [], 1, 0
    for _ in range(size):
        f, s = f * a % m, (s * a + c) % m
        factors.append(f)
        summands.append(s)
    return factors, summands


def lcg_vector(text: Column, size: int) -> Column:
    """Unit vector of a linear congruential sequence that starts at the text's hash: the local stand-in for a model."""
    factors, summands = lcg_jumps(size)
    m = LCG[2]
    start = F.pmod(F.abs(text_hash(text)), F.lit(m))
    states = lambda x: F.transform(F.lit(factors), lambda f, i: F.pmod(f.cast("long") * x + F.get(F.lit(summands), i), F.lit(m)))
    raw = F.transform(F.get(F.transform(F.array(start), states), 0), lambda v: v / float(m) * 2 - 1)
    return F.get(F.transform(F.array(raw), _unit), 0)


def _unit(v: Column) -> Column:
    return F.get(F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)), 0)
