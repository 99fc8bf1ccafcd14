"""IEEE-style arithmetic: division by zero and logarithms give infinities and NaN instead of errors and nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ieee_div(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _log(x: Column, inner: Column) -> Column:
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(NAN)).when(x > 0, inner).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))


def ieee_ln(x: Column) -> Column:
    return _log(x, F.ln(x.cast("double")))


def ieee_log2(x: Column) -> Column:
    return _log(x, F.log2(x.cast("double")))


def nan_to_zero(x: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def round_scaled(x: Column, places: int) -> Column:
    """Rounded as SQL engines do that scale a double, round it and scale it back; F.round goes by its decimal digits, which from
    about 2**53 / 10**places on gives other last bits."""
    near = F.round(x * F.lit(10.0**places)) / F.lit(10.0**places)
    return F.when(F.isnan(near) | (F.abs(near) == INF), x).otherwise(near)


def hectares(square_metres: Column) -> Column:
    return F.lit(0.0001) * square_metres


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.2125) * r + F.lit(0.7154) * g + F.lit(0.0721) * b


def frame_name(k: Column) -> Column:
    return F.format_string("plot_%d.png", k)
