"""Column helpers; all of them stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitpanel.params import DAY, DEFAULTS, Params

# Coefficients of the rational error-function approximation
# (Abramowitz and Stegun, formula 7.1.26), absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Multipliers and modulus of the integer hash behind every seeded draw.
DRAW_MOD = 2147483647
DRAW_M1 = 48271
DRAW_M2 = 69621


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(c) -> Column:
    """Timestamp (zoned or zone-less, UTC session) to epoch milliseconds."""
    return F.unix_millis(col(c).cast("timestamp"))


def floor_to(c, step: int) -> Column:
    return col(c) - F.pmod(col(c), F.lit(step))


def on_grid(c, step: int) -> Column:
    return F.pmod(col(c), F.lit(step)) == 0


def div(c, step: int) -> Column:
    """Floor division that stays BIGINT, also for negative numerators."""
    n = col(c)
    return F.call_function("div", n - F.pmod(n, F.lit(step)), F.lit(step).cast("bigint"))


def day_of(c) -> Column:
    return div(c, DAY)


def month_of(c) -> Column:
    """``YYYY-MM`` of an epoch-millisecond column."""
    return F.date_format(F.timestamp_millis(col(c)), "yyyy-MM")


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def normalize_epoch(c) -> Column:
    """Microsecond epochs (beyond 1e14) become milliseconds."""
    n = col(c).cast("bigint")
    return F.when(n > 100_000_000_000_000, div(n, 1000)).otherwise(n)


def clip_finite(c, lo: float, hi: float) -> Column:
    """+inf goes to ``hi``; -inf and NaN to ``lo``; anything else is clamped. NULL counts as NaN."""
    x = col(c)
    return (F.when(x.isNull() | F.isnan(x), F.lit(lo))
            .otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), x))))


def safe_div(a, b) -> Column:
    return F.when(col(b) != 0, col(a) / col(b))


def erf(c) -> Column:
    x = F.abs(col(c))
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * k
    return F.signum(col(c)) * (F.lit(1.0) - poly * F.exp(-x * x))


def normal_cdf(c) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(col(c) / F.lit(math.sqrt(2.0))))


def draw(seed: int, a, b) -> Column:
    """Reproducible pseudo-random BIGINT in [0, 2^31-1) from a seed and two indices."""
    def mix(x):
        x = F.pmod(x * F.lit(DRAW_M1), F.lit(DRAW_MOD))
        x = x.bitwiseXOR(F.shiftright(x, 13))
        x = F.pmod(x * F.lit(DRAW_M2), F.lit(DRAW_MOD))
        return x.bitwiseXOR(F.shiftright(x, 11))
    first = mix(F.pmod(col(a).cast("bigint") + F.lit(seed).cast("bigint"), F.lit(DRAW_MOD)))
    return mix(F.pmod(first + col(b).cast("bigint"), F.lit(DRAW_MOD)))


def bucket_of(c, cuts, values) -> Column:
    """Value at the position equal to the number of cuts strictly below ``c``."""
    x = col(c)
    out = F.lit(values[len(cuts)])
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(x <= cuts[i], F.lit(values[i])).otherwise(out)
    return F.when(x.isNotNull(), out)


def tier(rank, p: Params = DEFAULTS) -> Column:
    return F.when(col(rank) <= p.tier1_top, F.lit(1)).otherwise(F.lit(2))


def by_tier(rank, pair, p: Params = DEFAULTS) -> Column:
    return F.when(col(rank) <= p.tier1_top, F.lit(pair[0])).otherwise(F.lit(pair[1]))


def entry_fill(ref, side, rank, p: Params = DEFAULTS) -> Column:
    cost = by_tier(rank, p.half_spread, p) + by_tier(rank, p.slippage, p)
    return col(ref) * (F.lit(1.0) + col(side) * cost)


def exit_fill(ref, side, rank, mult: float = 1.0, p: Params = DEFAULTS) -> Column:
    cost = by_tier(rank, p.half_spread, p) + by_tier(rank, p.slippage, p) * F.lit(mult)
    return col(ref) * (F.lit(1.0) - col(side) * cost)
