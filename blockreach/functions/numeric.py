"""Numeric coercion, ratios and scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, functions as F

# Census codes that mean "no estimate".
MISSING_SENTINELS = (
    -999_999_999,
    -888_888_888,
    -666_666_666,
    -555_555_555,
    -333_333_333,
    -222_222_222,
)

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def census_number(value: Column) -> Column:
    """Text to double with the census missing codes turned into null."""
    number = to_number(value.cast("string"))
    return F.when(~number.isin([float(s) for s in MISSING_SENTINELS]), number)


def census_share(value: Column) -> Column:
    """Percent text to a 0..1 share."""
    return census_number(value) / 100.0


def safe_divide(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """Ratio that is null (or ``default``) for a zero or missing denominator and never infinite."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    ratio = F.when(F.abs(ratio) < float("inf"), ratio)
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def _census_column(name: str) -> Column:
    return census_number(F.col(name))


def sum_present(columns: Iterable[str], names: Sequence[str], number: Callable[[str], Column] = _census_column) -> Column:
    """Row sum over those ``names`` that exist, null when all of them are null or none exists.

    ``number`` gives the value of a column: parsed from census text, unless it is a number already.
    """
    existing = set(columns)
    parts = [number(n) for n in names if n in existing]
    if not parts:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def log1p_floor(value: Column) -> Column:
    """log(1 + max(value, 0)); null stays null."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value.cast("double"), F.lit(0.0))))


def undo_log1p(value: Column, was_logged: bool = True) -> Column:
    """Back to the raw scale for a column that went through :func:`log1p_floor`."""
    return F.expm1(value) if was_logged else value.cast("double")


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column. ``greatest``/``least`` skip nulls, so nulls are kept explicitly."""
    out = value.cast("double")
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low), zero for a constant column."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def weighted_sum(weights: dict[str, float]) -> Column:
    """Sum of columns times fixed weights, added in the given order."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name).cast("double") * F.lit(float(weight))
    return total


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the non-null columns of a row."""
    count = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.try_divide(total, count)
