"""Structural checks. Each measure is a DataFrame; require_* run it and raise."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hourloom.functions import correlation, flag, near
from hourloom.schema import FORBIDDEN, KEY


@dataclass(frozen=True)
class Rule:
    """broken holds for a row that breaks the rule; an unknown condition counts as kept."""

    name: str
    broken: Column


def calendar_fields(ts: str = "observation_timestamp") -> Column:
    """Whether year, month, day and hour are the timestamp's."""
    return reduce(and_, [F.col(n).eqNullSafe(f(ts)) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))])


def row_rules(columns: list[str], target: str | None = None, mark: str = "_is_train") -> list[Rule]:
    """Rules of a panel that each row meets or breaks by itself; those of columns that it doesn't have are left out.

    target: training rows must have one."""
    ts = "observation_timestamp"
    rules = [Rule(f"{c} is known", F.col(c).isNull()) for c in ("id", ts, "station") if c in columns]
    rules.append(Rule("timestamps are whole hours", (F.minute(ts) != 0) | (F.extract(F.lit("SECOND"), ts) != 0)))
    if {"year", "month", "day", "hour"} <= set(columns):
        rules.append(Rule("calendar fields are the timestamp's", ~calendar_fields(ts)))
    if target in columns:
        rules.append(Rule("training rows have a target", F.col(target).isNull() & (F.col(mark) == 1 if mark in columns else F.lit(True))))
    return rules


def broken(rules: list[Rule]) -> list[Column]:
    """Aggregates: how many rows break each rule."""
    return [F.count_if(r.broken).alias(r.name) for r in rules]


def row_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule and n_broken of every rule, in one pass."""
    return df.agg(*broken(rules)).unpivot([], [r.name for r in rules], "rule", "n_broken")


def watched(df: DataFrame, metrics: list[Column], name: str) -> tuple[DataFrame, Observation]:
    """df with metrics that ride on whatever job runs it first: no pass of their own. The observation's get waits for that job."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen


def refusing(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same rows; a job that meets a row that breaks a rule fails with the first such rule's name. For runs where nothing may be written before all is known to be right."""
    messages = [F.when(r.broken, F.lit(r.name)) for r in rules]
    return df.filter(F.assert_true(F.coalesce(*messages).isNull(), F.concat(F.lit("broken: "), F.coalesce(*messages))).isNull())


def key_violations(full: DataFrame, mark: str = "_is_train") -> DataFrame:
    """rule and n_broken of the rules that rows meet together: rows that repeat a station and hour, rows that repeat an id within a split, and ids of both splits.

    Two exchanges, of the keys alone; a row with a null key is row_rules' business and counts here like any other value."""
    repeats = full.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_broken"))
    out = repeats.select(F.lit("station and hour are unique").alias("rule"), F.col("n_broken").cast("bigint").alias("n_broken"))
    ids = full.groupBy("id").agg(F.count_if(F.col(mark) == 1).alias("a"), F.count_if(F.col(mark) == 0).alias("b"))
    per = ids.agg(F.sum(F.greatest(F.col("a") - 1, F.lit(0)) + F.greatest(F.col("b") - 1, F.lit(0))).alias("ids are unique"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("no id is in both splits"))
    names = ["ids are unique", "no id is in both splits"]
    return out.union(per.select(*[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(n) for n in names]).unpivot([], names, "rule", "n_broken"))


def violations(full: DataFrame, target: str | None = None, mark: str = "_is_train") -> DataFrame:
    """rule and n_broken of all rules of a panel with both splits."""
    return row_violations(full, row_rules(full.columns, target, mark)).union(key_violations(full, mark))


def require_rules(found: dict[str, int]) -> None:
    """Raises with every broken rule and its count; found: n_broken by rule."""
    if bad := {r: n for r, n in found.items() if n}:
        raise ValueError("broken rules: " + ", ".join(f"{r} ({n} rows)" for r, n in bad.items()))


def as_dict(found: DataFrame) -> dict[str, int]:
    """A row per rule, so a few."""
    return {r["rule"]: r["n_broken"] for r in found.collect()}


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_duplicates: rows beyond the first of each key."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def require_unique(df: DataFrame, keys: list[str] = list(KEY)) -> None:
    if n := duplicate_rows(df, keys).first()[0]:
        raise ValueError(f"{n} rows repeat a key of {', '.join(keys)}")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join after a check that the keys are unique on both sides."""
    require_unique(left, keys)
    require_unique(right, keys)
    return left.join(right, keys, "left")


def require_disjoint(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    if a.join(b, key, "left_semi").limit(1).count():
        raise ValueError(f"both sides hold the same {key}")


def require_no_nulls(df: DataFrame, column: str) -> None:
    if df.filter(F.col(column).isNull()).limit(1).count():
        raise ValueError(f"{column} has missing values")


def require_same_count(a: DataFrame, b: DataFrame) -> None:
    if (x := a.count()) != (y := b.count()):
        raise ValueError(f"{x} rows against {y}")


def require_same_columns(a: DataFrame, b: DataFrame, ordered: bool = True) -> None:
    """Names, their order if ordered, and types."""
    if extra := set(a.columns) ^ set(b.columns):
        raise ValueError(f"only one side has {', '.join(sorted(extra))}")
    if ordered and a.columns != b.columns:
        raise ValueError("the columns' order differs")
    other = dict(b.dtypes)
    if differ := [f"{c} is {t} and {other[c]}" for c, t in a.dtypes if t != other[c]]:
        raise ValueError(f"types differ: {', '.join(differ)}")


def reject_names(names: list[str], banned: tuple[str, ...] = (FORBIDDEN, "PM2_5_lag", "PM2_5_roll")) -> None:
    """No column may come from the forbidden measurement or from lags of the target."""
    if found := [n for n in names if any(b in n for b in banned)]:
        raise ValueError(f"derived from forbidden columns: {', '.join(found)}")


def calendar_disagreements(df: DataFrame, ts: str = "observation_timestamp") -> DataFrame:
    """n_wrong: rows whose year, month, day or hour isn't the timestamp's."""
    return df.agg(F.coalesce(F.sum((~calendar_fields(ts)).cast("bigint")), F.lit(0)).cast("bigint").alias("n_wrong"))


def require_calendar(df: DataFrame, ts: str = "observation_timestamp") -> None:
    """Only where the panel brings all four calendar fields."""
    if {"year", "month", "day", "hour"} <= set(df.columns) and (n := calendar_disagreements(df, ts).first()[0]):
        raise ValueError(f"{n} rows have calendar fields that aren't the timestamp's")


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column and missing_rate, in one pass."""
    columns = columns or df.columns
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "missing_rate")


def missing_counts(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, column and n_missing."""
    return df.groupBy(by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([by], columns, "column", "n_missing")


def fully_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return missing_rates(df, columns).filter(F.col("missing_rate") == 1.0)


def require_some_values(df: DataFrame, columns: list[str] | None = None) -> None:
    if found := [r["column"] for r in fully_missing(df, columns).collect()]:
        raise ValueError(f"no value in {', '.join(found)}")


def leak_audit(df: DataFrame, columns: list[str], target: str, keys: list[str] | None = None, ts: str = "observation_timestamp") -> DataFrame:
    """column, n, exact_match_rate and corr of each column one hour later against the target now; columns without a pair are left out.

    A column that is the target's source an hour later matches it nearly always."""
    keys = keys or ["station"]
    later = df.select(*keys, (F.col(ts) - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias(ts), *[F.col(c).alias(f"{c}_next") for c in columns])
    both = df.select(*keys, ts, F.col(target).alias("t_")).join(later, [*keys, ts], "left")
    parts = []
    for c in columns:
        paired = F.col("t_").isNotNull() & F.col(f"{c}_next").isNotNull()
        x, y = F.when(paired, F.col("t_")), F.when(paired, F.col(f"{c}_next"))
        parts.append(F.struct(F.count(y).alias("n"), F.avg(F.when(paired, flag(near(x, y)).cast("double"))).alias("exact_match_rate"), correlation(x, y).alias("corr")).alias(c))
    rows = both.agg(*parts).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.exact_match_rate").alias("exact_match_rate"), F.col(f"{c}.corr").alias("corr")) for c in columns])).alias("r"))
    return rows.select("r.*").filter("n > 0")


def require_no_leak(audit: DataFrame, most: float = 0.9) -> None:
    if found := [r["column"] for r in audit.filter(F.col("exact_match_rate") > most).collect()]:
        raise ValueError(f"leaks of the target: {', '.join(found)}")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, duplicates counted, with side left or right."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def require_same_release(a: DataFrame, b: DataFrame, position: str | None = None) -> None:
    """Columns, their order and types, and rows, duplicates counted. position: a column that holds a row's place in its file,
    so that rows must come in the same order too."""
    if (x := a.dtypes) != (y := b.dtypes):
        raise ValueError(f"schemas differ: {[c for c in x if c not in y] or x} against {[c for c in y if c not in x] or y}")
    if position and position not in a.columns:
        raise ValueError(f"no column {position}")
    if found := difference(a, b).groupBy("side").count().collect():
        raise ValueError("rows of one side only: " + ", ".join(f"{r['count']} {r['side']}" for r in found))


def order_differences(a: DataFrame, b: DataFrame, place: str = "place") -> DataFrame:
    """place and what differs there: value where both have a row, left or right where only one has. Both need a column of places (sources.with_place)."""
    columns = [c for c in a.columns if c != place]
    both = a.select(place, F.struct(*[f"`{c}`" for c in columns]).alias("l")).join(b.select(place, F.struct(*[f"`{c}`" for c in columns]).alias("r")), place, "full")
    differs = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").when(~F.col("l").eqNullSafe(F.col("r")), "value")
    return both.select(place, differs.alias("differs")).filter("differs IS NOT NULL")


def require_same_order(a: DataFrame, b: DataFrame, place: str = "place") -> None:
    """Columns, types, and the same rows at the same places."""
    require_same_columns(a, b)
    if found := order_differences(a, b, place).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 0").first():
        raise ValueError(f"{found['n']} places differ, the first is {found['first']}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
