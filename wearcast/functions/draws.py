"""Per-row random draws as native expressions.

Every draw is a function of (row id, seed, draw number), so a generated table
is the same however it is partitioned or re-run after a lost executor
(``rand(seed)`` depends on the partition layout), and any engine can draw the
same.  Eight draws of 32 bits come from one SHA-256 digest of the row, which
Spark computes once for all of them; a single ``draw`` of 52 bits has an MD5
digest of its own."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: draws that one digest holds
PER_DIGEST = 8
_TWO_32 = float(2**32)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(row_id, seed: int, k: int) -> Column:
    """A whole number in [0, 2**52) from the digest of ``id:seed:k``."""
    text = F.concat_ws(":", _col(row_id).cast("string"), F.lit(str(seed)), F.lit(str(k)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(row_id, seed: int, k: int) -> Column:
    """U[0, 1): the k-th 32 bits of the digests of ``id:seed:0``, ``id:seed:1``, ..."""
    text = F.concat_ws(":", _col(row_id).cast("string"), F.lit(str(seed)), F.lit(str(k // PER_DIGEST)))
    bits = F.substring(F.sha2(text, 256), 1 + 8 * (k % PER_DIGEST), 8)
    return F.conv(bits, 16, 10).cast("double") / F.lit(_TWO_32)


def randrange(row_id, seed: int, k: int, lo: int, hi: int, step: int = 1) -> Column:
    """Like ``random.randrange(lo, hi, step)``: upper bound excluded."""
    n = (hi - lo + step - 1) // step
    return (F.floor(uniform(row_id, seed, k) * n) * step + lo).cast("int")


def normal(row_id, seed: int, k: int, mean: float, sd: float) -> Column:
    """N(mean, sd) by Box-Muller from the uniform draws k and k + 1."""
    u1 = F.lit(1.0) - uniform(row_id, seed, k)  # (0, 1]
    u2 = uniform(row_id, seed, k + 1)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return z * sd + mean


def triangular(row_id, seed: int, k: int, low: float, high: float, mode: float) -> Column:
    """Triangular(low, high, mode) by the inverse CDF."""
    u = uniform(row_id, seed, k)
    fc = (mode - low) / (high - low)
    left = F.lit(low) + F.sqrt(u * ((high - low) * (mode - low)))
    right = F.lit(high) - F.sqrt((F.lit(1.0) - u) * ((high - low) * (high - mode)))
    return F.when(u < fc, left).otherwise(right)


def choice(row_id, seed: int, k: int, options: Sequence[str]) -> Column:
    """Uniform pick from a fixed list."""
    arr = F.array(*[F.lit(o) for o in options])
    idx = F.floor(uniform(row_id, seed, k) * len(options)).cast("int") + 1
    return F.element_at(arr, idx)


def weighted_choice(row_id, seed: int, k: int, options: Sequence[str], weights: Sequence[float]) -> Column:
    """Pick with the given relative weights (cumulative thresholds on one draw)."""
    total = float(sum(weights))
    u = uniform(row_id, seed, k) * total
    expr = None
    acc = 0.0
    for opt, w in zip(options, weights):
        acc += w
        expr = F.when(u < acc, F.lit(opt)) if expr is None else expr.when(u < acc, F.lit(opt))
    return expr.otherwise(F.lit(options[-1]))


# -- M5 / M6 / G7: rounding and derived quantities of generated draws -------
def python_round(x, ndigits: int = 0) -> Column:
    """Round half to even, as Python's ``round``."""
    return F.bround(_col(x), ndigits)


def clamp(x, lo: float, hi: float) -> Column:
    """``min(hi, max(lo, x))``."""
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), _col(x)))


def distance_for(duration, pace_draw) -> Column:
    """M6: distance = duration / pace draw, at 2 dp."""
    return python_round(_col(duration) / _col(pace_draw), 2)


def pace(duration, distance) -> Column:
    """M6: pace = duration / distance, at 2 dp."""
    return python_round(_col(duration) / _col(distance), 2)


def heat_index_or_sentinel(temp, split: float = 50.0, sentinel: float = -9999.0) -> Column:
    """A generated temperature is a heat index from ``split`` up, else the sentinel."""
    t = _col(temp)
    return F.when(t >= split, t).otherwise(F.lit(sentinel))


def wind_chill_or_sentinel(temp, split: float = 50.0, sentinel: float = -9999.0) -> Column:
    """A generated temperature is a wind chill below ``split``, else the sentinel."""
    t = _col(temp)
    return F.when(t < split, t).otherwise(F.lit(sentinel))
