"""Splits by time, and statistics that only training rows may set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import clip_low, rmse
from hourloom.schema import TARGET

#: Validation ranges, from the first hour to before the second.
HOLDOUTS = {"A": ("2015-09-01", "2016-03-01"), "B": ("2016-07-01", "2016-09-01")}


def known_before(start: str, ts: str = "observation_timestamp") -> Column:
    """Rows whose target hour, the next one, lies before start."""
    return F.col(ts) + F.expr("INTERVAL 1 HOUR") < F.lit(start).cast("timestamp_ntz")


def inside(start: str, end: str, ts: str = "observation_timestamp") -> Column:
    """Rows from start to before end."""
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def holdout(df: DataFrame, start: str, end: str, embargo: bool = True, ts: str = "observation_timestamp") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows. With the embargo a training row's target hour lies before the validation range too."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    known = F.col(ts) + F.expr("INTERVAL 1 HOUR") if embargo else F.col(ts)
    return df.filter(known < first), df.filter((F.col(ts) >= first) & (F.col(ts) < last))


def split(full: DataFrame, mark: str = "_is_train") -> tuple[DataFrame, DataFrame]:
    return tuple(full.filter(F.col(mark) == k).drop(mark) for k in (1, 0))


def union(train: DataFrame, test: DataFrame, mark: str = "_is_train") -> DataFrame:
    """Both panels by column name, without the target, marked 1 and 0."""
    return train.drop(TARGET).withColumn(mark, F.lit(1)).unionByName(test.withColumn(mark, F.lit(0)))


def fill_from_training(df: DataFrame, columns: list[str], mark: str = "_is_train") -> DataFrame:
    """Nulls become the training rows' mean: one row of statistics joins every row."""
    means = df.filter(F.col(mark) == 1).agg(*[F.avg(c).alias(f"{c}_fill_") for c in columns])
    filled = {c: F.coalesce(c, f"{c}_fill_") for c in columns}
    return df.crossJoin(F.broadcast(means)).withColumns(filled).drop(*means.columns)


def scale_from_training(df: DataFrame, columns: list[str], mark: str = "_is_train") -> DataFrame:
    """Columns less the training rows' mean, in their standard deviations; null where that is 0."""
    stats = df.filter(F.col(mark) == 1).agg(*[f(c).alias(f"{c}_{n}_") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])
    scaled = {c: (F.col(c) - F.col(f"{c}_mean_")) / F.nullif(F.col(f"{c}_std_"), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def ablation(scored: DataFrame, base: str, candidates: list[str], target: str = TARGET, holdouts: dict[str, tuple[str, str]] = HOLDOUTS, ts: str = "observation_timestamp") -> DataFrame:
    """candidate, base_rmse_* and rmse_* for each holdout, and accepted: whether the candidate beats the base in every one.

    scored holds the target and a column of predictions for each variant, e.g. of models with and without a family; predictions
    are clipped at 0. One pass, however many variants; a holdout without rows accepts nothing."""
    first, last = ({h: F.lit(x[i]).cast("timestamp_ntz") for h, x in holdouts.items()} for i in (0, 1))
    inside = {h: (F.col(ts) >= first[h]) & (F.col(ts) < last[h]) for h in holdouts}
    error = lambda h, c: rmse(F.when(inside[h], F.col(target)), clip_low(c))
    one = scored.agg(*[error(h, c).alias(f"{h}_{i}") for i, c in enumerate([base, *candidates]) for h in holdouts])
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), *[x for h in holdouts for x in (F.col(f"{h}_0").alias(f"base_rmse_{h}"), F.col(f"{h}_{i}").alias(f"rmse_{h}"))]) for i, c in enumerate(candidates, 1)])
    won = F.lit(True)
    for h in holdouts:
        won = won & (F.col(f"rmse_{h}") < F.col(f"base_rmse_{h}"))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("accepted", F.coalesce(won, F.lit(False)))
