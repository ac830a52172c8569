"""Exact ratios: counts stay integers until one final division."""
from pyspark.sql import Column, functions as F


def whole_div(num: Column, den: Column) -> Column:
    """Integer division; null when `den` is 0."""
    return F.call_function("div", num, F.nullif(den, F.lit(0)))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when `den` is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """num / den rounded half away from zero, worked out on integers.

    Rounding a quotient that is already a double can go either way on a tie; integers can't."""
    scale = 10 ** digits
    units = whole_div(F.abs(num).cast("long") * (2 * scale) + den, den * 2)
    return F.when(num < 0, -units).otherwise(units) / F.lit(float(scale))


def percent(num: Column, den: Column) -> Column:
    """Percentage with one decimal."""
    return round_ratio(num.cast("long") * 100, den, 1)


def rate(flag) -> Column:
    """Aggregate: share of rows where the 0/1 column is 1."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return ratio(F.sum(flag), F.count(flag))


def percent_of(flag) -> Column:
    """Aggregate: percentage of rows where the 0/1 column is 1 (null rows left out)."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return percent(F.sum(flag), F.count(flag))


def mean_of_rounded(col: str, digits: int = 4) -> Column:
    """Aggregate: mean of a column stored with `digits` decimals.

    Values are added as whole units, so the mean doesn't depend on the order of the rows."""
    units = F.round(F.col(col) * 10 ** digits).cast("long")
    return ratio(F.sum(units), F.count(col)) / float(10 ** digits)
