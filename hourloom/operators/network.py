"""State of all stations in an hour, its history by timestamp, and how a station differs from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import ratio
from hourloom.operators.rowwise import Columns
from hourloom.operators.temporal import History, with_history
from hourloom.schema import NETWORK, PRIMARY

STATISTICS = ("mean", "std", "min", "max", "median")
MEAN_LAGS, HALO = (1, 3, 6, 24), 24


def hour_table(panel: DataFrame, ts: str = "observation_timestamp", more: Columns | None = None) -> DataFrame:
    """One row per hour: statistics of the network columns over its stations, the primary ones' range, and more aggregates."""
    aggs: list[Column] = [c.alias(n) for n, c in (more or {}).items()]
    for c in NETWORK:
        made = (F.avg(c), F.stddev_samp(c), F.min(c), F.max(c), F.median(c))
        aggs += [a.alias(f"network_{c}_{s}") for a, s in zip(made, STATISTICS)]
    out = panel.groupBy(ts).agg(*aggs)
    return out.select("*", *[(F.col(f"network_{c}_max") - F.col(f"network_{c}_min")).alias(f"network_{c}_range") for c in PRIMARY])


def history_columns(h: History) -> Columns:
    """Lags of the hour table, by timestamp alone: a station that misses an hour still sees the network's past."""
    out: Columns = {}
    for c in PRIMARY:
        out |= {f"network_{c}_mean_lag_{n}h": h.lag(f"network_{c}_mean", n) for n in MEAN_LAGS}
        out |= {f"network_{c}_{s}_lag_1h": h.lag(f"network_{c}_{s}", 1) for s in ("std", "min", "max")}
    return out


def network_rates() -> Columns:
    out: Columns = {}
    for c in PRIMARY:
        m = f"network_{c}_mean"
        out |= {f"network_{c}_change_{n}h": F.col(m) - F.col(f"{m}_lag_{n}h") for n in (1, 3, 24)}
        # The third point is three hours back, not two: the network keeps no lag of two hours.
        out[f"network_{c}_second_diff_1h"] = F.col(m) - 2 * F.col(f"{m}_lag_1h") + F.col(f"{m}_lag_3h")
    return out


def hours(panel: DataFrame, more: Columns | None = None) -> DataFrame:
    """The hour table with its history and rates."""
    table = with_history(hour_table(panel, more=more), [], history_columns, HALO)
    return table.select("*", *[c.alias(n) for n, c in network_rates().items()])


def gradients() -> Columns:
    out: Columns = {}
    for c in NETWORK:
        away = F.col(c) - F.col(f"network_{c}_mean")
        out |= {f"{c}_vs_network_mean": away, f"{c}_vs_network_z": ratio(away, f"network_{c}_std")}
    return out


def local_vs_network() -> Columns:
    return {f"local_vs_network_{c}_change": F.col(f"{c}_change_1h") - F.col(f"network_{c}_change_1h") for c in PRIMARY}


def pivot_stations(panel: DataFrame, column: str, stations: list[str]) -> DataFrame:
    """A row per hour and a column per station; the stations are given, so nothing is scanned for them."""
    return panel.groupBy("observation_timestamp").pivot("station", stations).agg(F.avg(column))
