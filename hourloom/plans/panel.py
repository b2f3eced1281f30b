"""The test panel: events become readings of twelve stations by hour, with gaps and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.schema import COMPASS, STATIONS, TARGET

SPLIT = "2024-01-25"
NAMES, LABELS = list(STATIONS), list(COMPASS)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, observation_timestamp, station, the measured columns, target and _is_train, one row per station and hour.

    Cells with (7 station + hour) % 50 = 3 are left out, so station-hours go missing at every size."""
    seconds = F.unix_timestamp("ts")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 12).alias("st"), F.floor(seconds / 3600).alias("eh"), F.col("event_type").alias("et"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    of = lambda kind: F.avg(F.when(F.col("et") == kind, F.col("v")))
    a = (
        e.filter((F.col("st") * 7 + F.col("eh")) % 50 != 3)
        .groupBy("st", "eh")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("av"), *[of(x).alias(x) for x in ("purchase", "view", "click", "signup")], F.count_if(F.col("et") == "error").alias("er"), F.avg("k").alias("ak"), F.min("k").alias("mk"), F.max("k").alias("xk"), F.sum("k").alias("sk"))
    )
    ts = F.timestamp_seconds(F.col("eh") * 3600).cast("timestamp_ntz")
    pm10, wspm = F.round("av", 6), (F.col("xk") % 40) / F.lit(10.0)
    pick = lambda names, i: F.try_element_at(F.array(*[F.lit(x) for x in names]), i.cast("int") + 1)
    return a.select(
        (F.col("st") * 100000 + F.col("eh") % 100000).cast("bigint").alias("id"),
        ts.alias("observation_timestamp"),
        pick(NAMES, F.col("st")).alias("station"),
        pm10.alias("PM10"),
        F.round(F.col("view"), 6).alias("SO2"),
        F.round(F.col("click"), 6).alias("NO2"),
        F.round(F.least(F.lit(10000.0), F.greatest(F.lit(100.0), F.when(F.col("purchase").isNotNull(), F.col("purchase") * 50))), 6).alias("CO_"),
        F.round(F.col("signup") * 4, 6).alias("O3"),
        F.round(F.col("ak") / 2 - 10, 6).alias("TEMP"),
        (1000 + F.col("n")).cast("double").alias("PRES"),
        (F.col("mk") / F.lit(4.0) - 10).alias("DEWP"),
        F.col("er").cast("double").alias("RAIN"),
        F.when(F.col("sk") % 17 < 16, pick(LABELS, F.col("sk") % 17)).alias("wd"),
        wspm.alias("WSPM"),
        (F.lit(0.5) * pm10 + wspm).alias(TARGET),
        (ts < F.lit(SPLIT).cast("timestamp_ntz")).cast("int").alias("_is_train"),
        F.col("purchase").isNotNull().alias("has_co"),
    ).withColumn("CO", F.when(F.col("has_co"), F.col("CO_"))).drop("CO_", "has_co")


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


#: The same rows in the oracle's dialect, as the first common table expressions of its queries.
SQL = f"""
e AS (SELECT user_id % 12 AS st, epoch_us(ts) // 3600000000 AS eh, event_type AS et, value AS v, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
a AS (SELECT st, eh, count(*) AS n, avg(v) AS av, avg(CASE WHEN et = 'purchase' THEN v END) AS pu, avg(CASE WHEN et = 'view' THEN v END) AS vi, avg(CASE WHEN et = 'click' THEN v END) AS cl,
             avg(CASE WHEN et = 'signup' THEN v END) AS si, count(*) FILTER (et = 'error') AS er, avg(k) AS ak, min(k) AS mk, max(k) AS xk, sum(k) AS sk
      FROM e WHERE (st * 7 + eh) % 50 <> 3 GROUP BY st, eh),
p AS (SELECT (st * 100000 + eh % 100000)::BIGINT AS id, make_timestamp(eh * 3600000000) AS ts, ({listed(NAMES)})[st + 1] AS station, round(av, 6) AS PM10, round(vi, 6) AS SO2, round(cl, 6) AS NO2,
             CASE WHEN pu IS NOT NULL THEN round(least(10000.0::DOUBLE, greatest(100.0::DOUBLE, pu * 50)), 6) END AS CO, round(si * 4, 6) AS O3, round(ak / 2 - 10, 6) AS TEMP, (1000 + n)::DOUBLE AS PRES,
             mk / 4.0::DOUBLE - 10 AS DEWP, er::DOUBLE AS RAIN, CASE WHEN sk % 17 < 16 THEN ({listed(LABELS)})[(sk % 17)::INT + 1] END AS wd, (xk % 40) / 10.0::DOUBLE AS WSPM,
             0.5::DOUBLE * round(av, 6) + (xk % 40) / 10.0::DOUBLE AS target, (make_timestamp(eh * 3600000000) < TIMESTAMP '{SPLIT}')::INT AS is_train FROM a)"""
