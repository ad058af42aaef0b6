"""Column functions and aggregates with the numeric conventions of the engine.

Population deviations everywhere, linear quantiles, sign(0) = 0, and 0 instead of an undefined correlation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pearson(x: str | Column, y: str | Column) -> Column:
    """Population correlation over rows where both are known; 0 with fewer than 3 rows or a constant side."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    good = (F.count(a) >= 3) & (F.stddev_pop(a) > EPS) & (F.stddev_pop(b) > EPS)
    return F.coalesce(F.when(good, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))), F.lit(0.0))


def safe_float(c: str | Column) -> Column:
    """A finite double or null."""
    d = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def clip(c: str | Column, low: float, high: float) -> Column:
    """Clamped to [low, high]; null stays null and non-finite becomes null."""
    d = col(c).cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(~bad, F.greatest(F.lit(low), F.least(F.lit(high), d)))


def neg_rmse(pred: str | Column, y: str | Column) -> Column:
    return -F.sqrt(F.avg(F.pow(col(pred) - col(y), 2))) / (F.stddev_pop(col(y)) + 1e-9)


def excess_free_kurtosis(c: str | Column) -> Column:
    """Fourth standardised moment (3 for a normal law)."""
    return F.kurtosis(col(c)) + 3


def shrunk_mean(c: str | Column, prior: Column, strength: float = 4.0) -> Column:
    return (F.coalesce(F.sum(col(c)), F.lit(0.0)) + prior * strength) / (F.count(col(c)) + strength)


def path_width(score: str | Column, seed_variance: Column | float = 0.0, penalty: Column | float = 0.0) -> Column:
    """mean - sd + min(0, worst) less what is charged for, over the rows of fold scores."""
    s = col(score)
    return F.avg(s) - F.stddev_pop(s) + F.least(F.lit(0.0), F.min(s)) - seed_variance - penalty


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of sha1 over the parts joined by a bar; nulls are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)
