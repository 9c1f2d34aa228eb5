"""Scalar expressions: calendar, comfort indices, units, interactions, arrays. All are built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months of the meteorological seasons.
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def iso_timestamp(text: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ssXXX") -> Column:
    """Null where the text does not fit: the plain form throws in ANSI mode."""
    return F.try_to_timestamp(text, F.lit(pattern))


def any_iso_timestamp(text: Column) -> Column:
    """With an offset, or with a fraction and none."""
    return F.coalesce(iso_timestamp(text), iso_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), iso_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss"))


def number(text: Column) -> Column:
    return text.try_cast("double")


def time_parts(ts: Column) -> dict[str, Column]:
    """hour, day_of_year, month, day_of_week (Monday is 0), year, ISO week."""
    parts = {"hour": F.hour(ts), "day_of_year": F.dayofyear(ts), "month": F.month(ts), "day_of_week": F.weekday(ts), "year": F.year(ts), "week": F.weekofyear(ts)}
    return {k: v.cast("long") for k, v in parts.items()}


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * F.pi() / period)
    return F.sin(angle), F.cos(angle)


def season_flags(ts: Column) -> dict[str, Column]:
    return {f"is_{name}": F.month(ts).isin(*months).cast("long") for name, months in SEASONS.items()}


def heat_index(temp_f: Column, humidity: Column) -> Column:
    """The simple form, for hot and humid air only."""
    return F.when((temp_f > 80) & (humidity > 40), temp_f + 0.5 * (temp_f + humidity)).otherwise(temp_f)


def wind_chill(temp_f: Column, wind_mph: Column) -> Column:
    v = F.pow(wind_mph, 0.16)
    return F.when((temp_f < 50) & (wind_mph > 3), 35.74 + 0.6215 * temp_f - 35.75 * v + 0.4275 * temp_f * v).otherwise(temp_f)


def dew_point(temp: Column, humidity: Column) -> Column:
    return temp - (100 - humidity) / 5


def humidity_proxy(dew: Column, median_dew: Column) -> Column:
    return F.least(F.greatest(50 + 2 * (dew - median_dew), F.lit(0.0)), F.lit(100.0))


def fahrenheit(celsius: Column, places: int = 1) -> Column:
    return F.round(celsius * 9 / 5 + 32, places)


def hectopascal(pascal: Column, places: int = 2) -> Column:
    return F.round(pascal / 100, places)


def path_name(name: Column) -> Column:
    return F.translate(name, " /", "__")


def interactions(high: Column, low: Column, wind: Column, precip: Column) -> dict[str, Column]:
    mid = (high + low) / 2
    return {"temp_range": high - low, "temp_mid": mid, "wind_temp": wind * mid, "precip_temp": precip * mid, "has_precip": (precip > 0).cast("long"), "log_precip": F.log1p(precip)}


def array_stats(values: Column, current: Column, head: int = 6) -> dict[str, Column]:
    """Statistics of a forecast array; nothing but nulls for an empty one."""

    def mean(a: Column) -> Column:
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))

    rest = F.slice(values, head + 1, F.greatest(F.size(values) - head, F.lit(0)))
    return {"avg_forecast": mean(values), "min_forecast": F.array_min(values), "max_forecast": F.array_max(values), "delta_first": F.try_element_at(values, F.lit(1)) - current, "head_avg": mean(F.slice(values, 1, head)), "rest_avg": mean(rest)}
