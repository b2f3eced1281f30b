"""Statistics that are fitted once, on training rows, kept as a table and applied to any panel.

A table holds a row for every station and hour of the day, for every station, and for all, each with the means of its readings, how many there were, and the
range of time they come from. So what a model was trained with can be applied later and elsewhere, and whether a validation range had a part in it can be asked of the table itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS = "observation_timestamp"
#: Where a value comes from, by the level of the row that gave it.
LEVELS = ("station and hour", "station", "all")


def fit_means(training: DataFrame, columns: list[str], ts: str = TS) -> DataFrame:
    """level, station, hour, fitted_from, fitted_to, and mean_ and n_ of each column. One pass, pre-aggregated by Spark for all levels at once."""
    rows = training.select("station", F.hour(ts).alias("hour"), ts, *columns)
    found = rows.rollup("station", "hour").agg(F.grouping_id().alias("id"), F.min(ts).alias("fitted_from"), F.max(ts).alias("fitted_to"), *[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.count(c).alias(f"n_{c}"))])
    level = F.when(F.col("id") == 0, LEVELS[0]).when(F.col("id") == 1, LEVELS[1]).otherwise(LEVELS[2])
    # Without rows the table has no row for all either.
    return found.filter("fitted_from IS NOT NULL").select(level.alias("level"), *[c for c in found.columns if c != "id"])


def require_not_fitted_in(table: DataFrame, start: str, end: str) -> None:
    """Raises if rows from start to before end had a part in the table."""
    first, last = table.agg(F.min("fitted_from"), F.max("fitted_to")).first()
    inside = table.filter((F.col("fitted_from") < F.lit(end).cast("timestamp_ntz")) & (F.col("fitted_to") >= F.lit(start).cast("timestamp_ntz")))
    if inside.limit(1).count():
        raise ValueError(f"fitted on rows from {first} to {last}, which reach into {start} to {end}")


def fill_means(df: DataFrame, table: DataFrame, columns: list[str], least: int = 1, ts: str = TS) -> DataFrame:
    """Nulls become the mean of the station at that hour of the day, else of the station, else of all; {column}_from says which, or read, or null where nothing is known.

    A mean of fewer than least readings isn't used. The table is joined by its keys, its last row to every row; a station that training didn't know gets the mean of all."""
    of = lambda i: table.filter(F.col("level") == LEVELS[i])
    named = lambda t, i: t.select(*[F.col(k).alias(f"{k}_{i}_") for k in ("station", "hour")[: 2 - i]], *[F.when(F.col(f"n_{c}") >= least, F.col(f"mean_{c}")).alias(f"{c}_{i}_") for c in columns])
    hour = F.hour(ts)
    out = df.join(named(of(0), 0), (F.col("station") == F.col("station_0_")) & (hour == F.col("hour_0_")), "left")
    out = out.join(named(of(1), 1), F.col("station") == F.col("station_1_"), "left")
    one = of(2).agg(*[F.first(x).alias(x) for c in columns for x in (f"mean_{c}", f"n_{c}")])  # one row, also where the table is empty
    out = out.crossJoin(F.broadcast(named(one, 2)))
    filled = {c: F.coalesce(F.col(c), *[F.col(f"{c}_{i}_") for i in range(3)]) for c in columns}
    return out.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], *[source(c).alias(f"{c}_from") for c in columns])


def source(c: str) -> Column:
    given = [(F.col(c), "read"), *[(F.col(f"{c}_{i}_"), LEVELS[i]) for i in range(3)]]
    return reduce(lambda rest, x: F.when(x[0].isNotNull(), F.lit(x[1])).otherwise(rest), reversed(given), F.lit(None).cast("string"))
