"""Small column expressions shared by every report.

Sums of decimals and whole numbers are exact, and every mean is one division of two exact
sums. A figure therefore does not depend on how Spark happened to partition the rows.
"""

from pyspark.sql import Column, functions as F

from cohortlake import settings as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den in double precision; null when the denominator is 0."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean(c) -> Column:
    return ratio(F.sum(col(c)), F.count(col(c)))


def weighted_mean(value, weight) -> Column:
    return ratio(F.sum(col(value) * col(weight)), F.sum(col(weight)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def clip(c, lo=None, hi=None) -> Column:
    """Limit to [lo, hi]; null stays null (least and greatest alone would drop it)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def same_season(key: str, latest: Column | int) -> Column:
    """Autumn keys are even, spring keys odd."""
    return F.pmod(F.col(key), F.lit(2)) == F.pmod(F.lit(latest), F.lit(2))


def first_match(c: Column, bounds, inclusive: bool) -> Column:
    """Label of the first (upper bound, label) pair that holds the value."""
    out = None
    for bound, label in bounds:
        test = (c <= bound) if inclusive else (c < bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def risk_level(p) -> Column:
    """A probability on a bound belongs to the level above it."""
    return first_match(col(p), S.RISK_LEVELS, inclusive=False)


def difficulty(rate) -> Column:
    return first_match(col(rate), S.DIFFICULTY, inclusive=True)


def is_high_risk(level="RiskLevel") -> Column:
    return col(level).isin(*S.HIGH_RISK)


def grade_of(total, index: int) -> Column:
    """Grade label (index 1) or grade points (index 2) of a total score."""
    out = None
    for step in S.GRADE_SCALE:
        test = col(total) >= step[0]
        out = F.when(test, step[index]) if out is None else out.when(test, step[index])
    return out


def tenth_band(score, maximum: int) -> Column:
    """0..9: which tenth of the maximum; the maximum itself is in the last band."""
    return F.when(col(score) >= maximum, 9).otherwise(F.floor(col(score) * 10 / maximum)).cast("int")
