"""Features of a row by itself: calendar, wind, missing values, sensor limits, physics and products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.functions import cyclic, flag, ratio, relative_humidity
from hourloom.schema import COMPASS, MEASURED, PRIMARY

Columns = dict[str, Column]


def calendar(ts: str = "observation_timestamp") -> Columns:
    """Parts of the timestamp (Monday is 0), their place in the period as sine and cosine, and two seasons."""
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "dayofweek": F.weekday(ts), "dayofyear": F.dayofyear(ts)}
    out = dict(parts)
    for name, period in (("hour", 24), ("month", 12), ("dayofweek", 7), ("dayofyear", 365)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(parts[name], period)
    out["is_winter"] = flag(parts["month"].isin(11, 12, 1, 2))
    out["is_heating_season"] = flag(parts["month"].isin(11, 12, 1, 2, 3))
    return out


def wind_degrees(wd: str = "wd") -> Column:
    """Degrees of a compass label; null for others."""
    table = F.create_map(*[F.lit(x) for pair in COMPASS.items() for x in pair])
    return F.try_element_at(table, F.col(wd))


def wind() -> Columns:
    turn = F.radians(wind_degrees())
    return {"wd_sin": F.sin(turn), "wd_cos": F.cos(turn), "wind_u": F.col("WSPM") * F.sin(turn), "wind_v": F.col("WSPM") * F.cos(turn), "is_calm": flag(F.col("WSPM") < 1.0)}


def missingness() -> Columns:
    return {f"{c}_missing": F.col(c).isNull().cast("int") for c in MEASURED}


def quality_flags() -> Columns:
    return {"co_floor": flag(F.col("CO") == 100), "co_ceiling": flag(F.col("CO") == 10000), "o3_extreme": flag(F.col("O3") > 400), "rain_active": flag(F.col("RAIN") > 0)}


def physical() -> Columns:
    out = {"TEMP_DEWP_diff": F.col("TEMP") - F.col("DEWP")}
    for a, b in (("NO2", "CO"), ("SO2", "CO"), ("SO2", "NO2"), ("PM10", "CO"), ("NO2", "O3")):
        out[f"{a}_{b}_ratio"] = ratio(a, b)
    return out | {"rh_proxy": relative_humidity("TEMP", "DEWP")}


def interactions() -> Columns:
    """Products; they need the wind, calendar, physical and network columns."""
    pair = lambda a, b: F.col(a) * F.col(b)
    out = {f"{p}_x_{w}": pair(p, w) for p in PRIMARY for w in ("WSPM", "TEMP", "DEWP", "RAIN")}
    out |= {f"{a}_x_{b}": pair(a, b) for a, b in (("CO", "NO2"), ("CO", "SO2"), ("NO2", "SO2"), ("NO2", "O3"), ("PM10", "CO"), ("PM10", "NO2"))}
    for p in PRIMARY:
        out |= {f"WSPM_x_network_{p}_change": pair("WSPM", f"network_{p}_change_1h"), f"WSPM_x_network_{p}_mean": pair("WSPM", f"network_{p}_mean")}
    for p in PRIMARY:
        out |= {f"is_calm_x_{p}": pair("is_calm", p), f"is_winter_x_{p}": pair("is_winter", p)}
    return out | {f"{p}_x_ddd": pair(p, "TEMP_DEWP_diff") for p in PRIMARY}
