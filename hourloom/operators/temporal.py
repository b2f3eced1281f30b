"""History by elapsed time: lags, trailing windows, rates and time since the last reading.

Rows are windowed by (keys, bucket of time). A bucket also holds the rows of the halo before it, so one entity's history is cut
into tasks of bounded size and every window still sees all it needs; halo rows leave again. All lags and windows of a
stage share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import ratio
from hourloom.schema import PRIMARY, SECONDARY, WEATHER
from hourloom.operators.rowwise import Columns

HOUR = 3600
BUCKET_HOURS = 24 * 28
ROLLING = (3, 6, 12, 24)
#: Columns and lags in hours, by family, in the order in which they are made.
LAGS = [
    ("LOCAL_LAGS_SHORT", PRIMARY, (1, 2, 3)), ("LOCAL_LAGS_MEDIUM", PRIMARY, (6, 12)), ("LOCAL_LAGS_LONG", PRIMARY, (24, 48)),
    ("LOCAL_LAGS_SHORT", SECONDARY, (1, 3)), ("LOCAL_LAGS_MEDIUM", SECONDARY, (6, 24)),
    ("LOCAL_LAGS_SHORT", WEATHER, (1, 3)), ("LOCAL_LAGS_MEDIUM", WEATHER, (6, 24)),
]


def epoch(ts: str | Column) -> Column:
    """Whole seconds; the panel is hourly."""
    return F.unix_timestamp(ts)


class History:
    """Window expressions over elapsed seconds before a row; name() and the frame say which rows count."""

    def __init__(self, keys: list[str]):
        self.window = Window.partitionBy(*keys, "bucket_").orderBy("epoch_")

    def lag(self, column: str, hours: int) -> Column:
        """The value exactly so many hours before, null if that row or value is missing."""
        return F.max(column).over(self.window.rangeBetween(-hours * HOUR, -hours * HOUR))

    def trailing(self, column: str, hours: int) -> dict[str, Column]:
        """Statistics over [t - hours, t): the left end counts, the row itself doesn't."""
        w = self.window.rangeBetween(-hours * HOUR, -1)
        return {"mean": F.avg(column).over(w), "std": F.stddev_samp(column).over(w), "min": F.min(column).over(w), "max": F.max(column).over(w)}


def with_history(df: DataFrame, keys: list[str], columns, halo_hours: int, ts: str = "observation_timestamp", bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """df with columns(History) added. No frame may reach back further than halo_hours."""
    size, halo = bucket_hours * HOUR, halo_hours * HOUR
    own = F.floor(epoch(ts) / F.lit(size))
    last = F.floor((epoch(ts) + F.lit(halo)) / F.lit(size))
    dealt = df.withColumns({"epoch_": epoch(ts), "own_": own}).withColumn("bucket_", F.explode(F.sequence("own_", last)))
    made = columns(History(keys))
    return dealt.select("*", *[c.alias(n) for n, c in made.items()]).filter("bucket_ = own_").drop("epoch_", "own_", "bucket_")


def lag_columns(h: History) -> Columns:
    return {f"{c}_lag_{n}h": h.lag(c, n) for _, columns, lags in LAGS for c in columns for n in lags}


def rolling_columns(h: History) -> Columns:
    return {f"{c}_roll_{s}_{n}h": x for c in PRIMARY for n in ROLLING for s, x in h.trailing(c, n).items()}


def rates() -> Columns:
    """Changes, from exact lags, so gaps give nulls."""
    out = {f"{c}_change_{n}h": F.col(c) - F.col(f"{c}_lag_{n}h") for c in [*PRIMARY, *SECONDARY] for n in (1, 3)}
    for c in PRIMARY:
        out[f"{c}_pct_change_1h"] = ratio(F.col(c) - F.col(f"{c}_lag_1h"), f"{c}_lag_1h")
        out[f"{c}_second_diff_1h"] = F.col(c) - 2 * F.col(f"{c}_lag_1h") + F.col(f"{c}_lag_2h")
        out[f"{c}_vs_roll_mean_24h"] = F.col(c) - F.col(f"{c}_roll_mean_24h")
    return out


def lags_by_join(df: DataFrame, keys: list[str], columns: list[str], hours: int, ts: str = "observation_timestamp") -> DataFrame:
    """The same as a point frame, as an equi-join on the shifted time; keys and time must be unique."""
    right = df.select(*keys, (F.col(ts) + F.make_interval(hours=F.lit(hours))).cast("timestamp_ntz").alias(ts), *[F.col(c).alias(f"{c}_lag_{hours}h") for c in columns])
    return df.join(right, [*keys, ts], "left")


def latest(df: DataFrame, keys: list[str], seen: dict[str, Column], inclusive: bool, ts: str = "observation_timestamp", bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """df with, for each name, the epoch of the last row up to the own one (or before it) where its condition holds; null while there is none.

    Rows are windowed by (keys, bucket of time). What lies in earlier buckets comes from one row per key and bucket, so no
    window holds an entity's whole history."""
    marked = df.withColumns({"epoch_": epoch(ts), "bucket_": F.floor(epoch(ts) / F.lit(bucket_hours * HOUR))}).withColumns({f"{n}_at_": F.when(c, F.col("epoch_")) for n, c in seen.items()})
    before = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*keys, "bucket_").agg(*[F.max(f"{n}_at_").alias(f"{n}_at_") for n in seen]).select(*keys, "bucket_", *[F.max(f"{n}_at_").over(before).alias(f"{n}_before_") for n in seen])
    own = Window.partitionBy(*keys, "bucket_").orderBy("epoch_").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    both = marked.join(carried, [*keys, "bucket_"], "left")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], "epoch_", *[F.greatest(F.max(f"{n}_at_").over(own), F.col(f"{n}_before_")).alias(n) for n in seen])


def gap_hours(df: DataFrame, keys: list[str], ts: str = "observation_timestamp", bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Each row with the hours since the row before it, null for the first."""
    out = latest(df, keys, {"last_": F.lit(True)}, False, ts, bucket_hours)
    return out.withColumn("gap_hours", (F.col("epoch_") - F.col("last_")) / F.lit(float(HOUR))).drop("epoch_", "last_")


def hours_since_observed(df: DataFrame, keys: list[str], columns: list[str], ts: str = "observation_timestamp", bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Hours since the last reading of each column at or before the row; null while none is known."""
    out = latest(df, keys, {f"{c}_last_": F.col(c).isNotNull() for c in columns}, True, ts, bucket_hours)
    return out.withColumns({f"{c}_hours_since": (F.col("epoch_") - F.col(f"{c}_last_")) / F.lit(float(HOUR)) for c in columns}).drop("epoch_", *[f"{c}_last_" for c in columns])
