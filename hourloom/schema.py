"""Columns, fixed lookups and the input schema of the station-hour panel."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "PM2_5_next_hour"
FORBIDDEN = "current_PM2_5"
KEY = ("station", "observation_timestamp")
POLLUTANTS = ["PM10", "SO2", "NO2", "CO", "O3"]
WEATHER = ["TEMP", "PRES", "DEWP", "RAIN", "WSPM"]
MEASURED = [*POLLUTANTS, *WEATHER, "wd"]
PRIMARY = ["PM10", "CO"]
SECONDARY = ["SO2", "NO2", "O3"]
NETWORK = [*POLLUTANTS, "WSPM", "TEMP"]

# Degrees of the compass labels.
COMPASS = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5, "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5, "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}

# Longitude and latitude of the stations.
STATIONS = {
    "Aotizhongxin": (116.397, 39.982), "Changping": (116.230, 40.217), "Dingling": (116.220, 40.292), "Dongsi": (116.417, 39.929),
    "Guanyuan": (116.339, 39.929), "Gucheng": (116.184, 39.914), "Huairou": (116.628, 40.328), "Nongzhanguan": (116.461, 39.937),
    "Shunyi": (116.655, 40.127), "Tiantan": (116.407, 39.886), "Wanliu": (116.287, 39.987), "Wanshouxigong": (116.352, 39.878),
}


def input_schema(train: bool) -> T.StructType:
    """Of the CSV files, in their order; only the training file has the target."""
    fields = [("id", T.LongType()), ("observation_timestamp", T.TimestampNTZType()), ("station", T.StringType())]
    fields += [(c, T.IntegerType()) for c in ("year", "month", "day", "hour")]
    fields += [(c, T.DoubleType()) for c in [*POLLUTANTS, "TEMP", "PRES", "DEWP", "RAIN"]]
    fields += [("wd", T.StringType()), ("WSPM", T.DoubleType())]
    fields += [(TARGET, T.DoubleType())] if train else []
    return T.StructType([T.StructField(*f) for f in fields])
