"""Number coercion, guarded division, logs and binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, trim_all


def parse_int(value: str | Column) -> Column:
    """Whole-number text to bigint; anything else, ``'12.0'`` included, becomes null."""
    return trim_all(as_col(value).cast("string")).try_cast("bigint")


def coerce_int(value: str | Column) -> Column:
    """Numeric text to int with halves rounded away from zero; bad text becomes null."""
    return F.round(as_col(value).try_cast("double")).try_cast("int")


def coerce_double(value: str | Column) -> Column:
    return as_col(value).try_cast("double")


def to_year(value: str | Column) -> Column:
    """Numeric text to a whole year, halves to even."""
    return F.rint(as_col(value).try_cast("double")).try_cast("int")


def finite(value: Column) -> Column:
    """Null instead of NaN or an infinity."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """Division that is null for a null or zero denominator and for non-finite results."""
    return finite(F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def log_positive(value: str | Column) -> Column:
    """Natural log; null where the argument is not positive."""
    value = as_col(value).cast("double")
    return F.when(value > 0, F.log(value))


def log_plus1(value: str | Column, fill: float | None = None, floor: float | None = None) -> Column:
    """``ln(1 + x)`` with an optional fill for nulls and floor for negatives."""
    value = as_col(value).cast("double")
    if fill is not None:
        value = F.coalesce(value, F.lit(float(fill)))
    if floor is not None:
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))
    return F.when(value > -1, F.log1p(value))


def grid_floor(value: str | Column, per_unit: int) -> Column:
    """Lower edge of the fixed-width bin that holds the value."""
    return F.floor(as_col(value) * per_unit) / F.lit(float(per_unit))


def row_sample_std(columns: Sequence[str | Column]) -> Column:
    """Sample standard deviation across columns of one row, nulls skipped."""
    values = [as_col(c).cast("double") for c in columns]
    zero = F.lit(0.0)
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    mean = sum((F.coalesce(v, zero) for v in values), zero) / F.nullif(n, F.lit(0))
    squares = sum((F.coalesce((v - mean) * (v - mean), zero) for v in values), zero)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))
