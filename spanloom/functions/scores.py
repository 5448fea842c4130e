"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def probabilistic_union(values: Column) -> Column:
    """1 - product(1 - p) over an array of probabilities, each clamped to [0, 1]."""
    return 1 - F.aggregate(values, F.lit(1.0), lambda acc, p: acc * (1 - clamp01(p)))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """Rounded quotient, null for a zero denominator."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sign_bits(vector: Column) -> Column:
    """Perceptual hash of a 64-component vector: bit k is set where component k is positive."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > 0).cast("long")))


def retry_delay(attempt: Column, backoff: list[float], jitter: float, unit: Column, retry_after: Column) -> Column:
    """Backoff of the attempt with jitter, at least Retry-After; null when attempts are used up."""
    steps = F.array(*map(F.lit, backoff))
    wait = F.get(steps, attempt) * (1 - jitter + 2 * jitter * unit)
    return F.when(attempt < len(backoff), F.greatest(wait, F.coalesce(retry_after, F.lit(0.0))))


def candidate_budget(seconds: Column, requested: Column, boundary: Column) -> Column:
    """Windows to confirm: 18 for each five minutes beside the boundary ones, 40 at least, at most as requested."""
    return F.least(requested, F.greatest(F.lit(40), boundary + 18 * F.greatest(F.lit(1), F.ceil(seconds / 300.0))))


def on_grid(micros: Column, periods_micros: list[int]) -> Column:
    """Whether a time in whole microseconds is a multiple of every period."""
    out = F.lit(True)
    for p in periods_micros:
        out = out & (micros % p == 0)
    return out
