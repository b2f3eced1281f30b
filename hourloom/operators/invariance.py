"""Whether features of the past stay as they are when later rows are taken away: the test of leaks that needs no knowledge of how a feature is made.

Features are built from the whole panel and from the panel up to each cut. Every (hour, column) becomes one digest that doesn't depend on the order of rows, so
what is compared are small tables: hours times columns, whatever the number of stations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.sources import staged

TS = "observation_timestamp"


def digests(features: DataFrame, columns: list[str], key: str = "id", ts: str = TS) -> DataFrame:
    """ts, column, n and digest. Rows must be unique by key. Doubles count as floats, as sums in another order differ in their last bits."""
    kinds = dict(features.dtypes)
    value = lambda c: F.col(f"`{c}`").cast("float") + F.lit(0.0).cast("float") if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    per = features.groupBy(ts).agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.col(key), value(c))).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("digest")) for i, c in enumerate(columns)])
    return per.select(ts, "n", F.explode(rows).alias("r")).select(ts, "n", "r.*")


def truncation_differences(build: Callable[[DataFrame], DataFrame], panel: DataFrame, cuts: list[str], columns: list[str] | None = None, key: str = "id", ts: str = TS) -> DataFrame:
    """cut, column, first_hour and n_hours: where the features that build makes of the rows up to a cut aren't those it makes of all rows.

    No row means that nothing was found. Cuts late in the panel find what reaches far; a leak of n hours shows in the last n hours before a cut. Rows that one of the two
    lacks differ in every column. Each cut costs one more building of the features."""
    whole = build(panel)
    columns = columns or [c for c in whole.columns if c not in (key, ts)]
    whole = staged(digests(whole, columns, key, ts), "digests")
    out = None
    for cut in cuts:
        until = F.col(ts) <= F.lit(cut).cast("timestamp_ntz")
        part = digests(build(panel.filter(until)), columns, key, ts)
        both = whole.filter(until).alias("a").join(part.alias("b"), [ts, "column"], "full")
        differ = both.filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | ~F.col("a.n").eqNullSafe(F.col("b.n")))
        found = differ.groupBy("column").agg(F.min(ts).alias("first_hour"), F.count(F.lit(1)).alias("n_hours")).select(F.lit(cut).cast("timestamp_ntz").alias("cut"), "column", "first_hour", "n_hours")
        out = found if out is None else out.union(found)
    return out


def require_invariant(build: Callable[[DataFrame], DataFrame], panel: DataFrame, cuts: list[str], **names) -> None:
    """Raises with each column that later rows change, and since when. A row per column at most comes to the driver."""
    found = truncation_differences(build, panel, cuts, **names).groupBy("column").agg(F.min("first_hour").alias("first_hour")).orderBy("column").collect()
    if found:
        raise ValueError("later rows change " + ", ".join(f"{r['column']} (from {r['first_hour']})" for r in found))
