"""Similarity of packed bit fingerprints as column expressions.

A fingerprint is an array of 64-bit words. With a fixed number of words every metric is a sum of ``bit_count`` terms
and stays inside code generation; no lambda runs per element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column, Column, int], Column]


def _ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where the divisor is."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


# a, b: bits of each; c: bits of both; n: width
METRICS: dict[str, Metric] = {
    "tanimoto": lambda a, b, c, n: _ratio(c, a + b - c),
    "dice": lambda a, b, c, n: _ratio(2 * c, a + b),
    "cosine": lambda a, b, c, n: _ratio(c, F.sqrt((a * b).cast("double"))),
    "sokal": lambda a, b, c, n: (c + (n - a - b + c)).cast("double") / n,
    "russel": lambda a, b, c, n: c.cast("double") / n,
    "kulczynski": lambda a, b, c, n: F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise((_ratio(c, a) + _ratio(c, b)) / 2),
    "mcconnaughey": lambda a, b, c, n: _ratio(c * c - (a - c) * (b - c), a * b),
    "asymmetric": lambda a, b, c, n: _ratio(c, a),
    "braun_blanquet": lambda a, b, c, n: _ratio(c, F.greatest(a, b)),
}


def metric(name: str) -> Metric:
    if name.lower() not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return METRICS[name.lower()]


def tversky(alpha: float, beta: float) -> Metric:
    """The asymmetric metric with other weights (1 and 0 by default)."""
    return lambda a, b, c, n: _ratio(c, c + alpha * (a - c) + beta * (b - c))


def words(fingerprint: Column, n_bits: int) -> list[Column]:
    return [fingerprint.getItem(i) for i in range(-(-n_bits // 64))]


def bits(packed: Sequence[Column]) -> Column:
    return reduce(add, [F.bit_count(w) for w in packed])


def similarity(name: str | Metric, left: Sequence[Column], right: Sequence[Column], n_bits: int, left_bits: Column | None = None, right_bits: Column | None = None) -> Column:
    """A metric of two fingerprints given as words; the numbers of set bits may be passed where they are columns."""
    f = metric(name) if isinstance(name, str) else name
    both = reduce(add, [F.bit_count(x.bitwiseAND(y)) for x, y in zip(left, right, strict=True)])
    return f(bits(left) if left_bits is None else left_bits, bits(right) if right_bits is None else right_bits, both, n_bits)


def on_bits(fingerprint: Column, n_bits: int) -> Column:
    """The positions of the set bits, ascending."""
    place = F.sequence(F.lit(0), F.lit(n_bits - 1))
    return F.filter(place, lambda i: F.getbit(F.element_at(fingerprint, F.floor(i / 64).cast("int") + 1), i % 64) == 1)


def density(fingerprint: Column, n_bits: int) -> Column:
    return bits(words(fingerprint, n_bits)).cast("double") / n_bits


def pack(flags: Sequence[Column]) -> Column:
    """Conditions packed into words, the first as the lowest bit; null counts as unset."""
    out = []
    for start in range(0, len(flags), 64):
        terms = [F.when(f, F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags[start : start + 64])]
        out.append(reduce(lambda x, y: x.bitwiseOR(y), terms))
    return F.array(*out)


def vector_similarity(left: Column, right: Column) -> Column:
    """1 / (1 + Euclidean distance) of two vectors."""
    squares = F.aggregate(F.zip_with(left, right, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(squares))


# ---- counts ---------------------------------------------------------------------------------------


def count_similarity(name: str, left: Column, right: Column) -> Column:
    """tanimoto, dice or cosine of two count maps (key to number); a missing key is 0, two empty maps have 0.

    tanimoto is the sum of least over the sum of largest counts, dice twice the former over both sums.
    """
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    count = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0)).cast("double")
    total = lambda f: F.aggregate(keys, F.lit(0.0), lambda s, k: s + f(count(left, k), count(right, k)))
    low, both = total(F.least), total(lambda a, b: a + b)
    forms = {
        "tanimoto": lambda: _ratio(low, total(F.greatest)),
        "dice": lambda: _ratio(2 * low, both),
        "cosine": lambda: _ratio(total(lambda a, b: a * b), F.sqrt(total(lambda a, b: a * a)) * F.sqrt(total(lambda a, b: b * b))),
    }
    if name.lower() not in forms:
        raise ValueError(f"no count form of {name!r}; one of {', '.join(forms)}")
    return forms[name.lower()]()
