"""Column functions with the panel's null rules: a comparison with a missing value is 0, a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def cyclic(x: str | Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a place in a period."""
    turn = F.lit(2.0) * F.pi() * col(x) / F.lit(float(period))
    return F.sin(turn), F.cos(turn)


def near(a: str | Column, b: str | Column, atol: float = 1e-6, rtol: float = 1e-5) -> Column:
    """abs(a - b) <= atol + rtol abs(b)."""
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null for a constant side or a single pair. Both sides must be null together."""
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def clip_low(x: str | Column, low: float = 0.0) -> Column:
    """Values below low become low; null stays null."""
    return F.when(col(x) < low, F.lit(low)).otherwise(col(x))


def rmse(actual: str | Column, predicted: str | Column) -> Column:
    """Root of the mean squared difference, as an aggregate."""
    return F.sqrt(F.avg(F.pow(col(actual) - col(predicted), F.lit(2.0))))


def relative_humidity(temperature: str | Column, dew_point: str | Column) -> Column:
    """Magnus approximation, in per cent."""
    pressure = lambda c: F.exp(F.lit(17.625) * c / (F.lit(243.04) + c))
    return F.lit(100.0) * (pressure(col(dew_point)) / pressure(col(temperature)))


def nan_to_null(df):
    """NaN in floating columns becomes null, the only form of missing that the operators know."""
    kinds = (DoubleType, FloatType)
    return df.select([F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])
