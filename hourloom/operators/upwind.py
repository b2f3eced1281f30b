"""Readings from upwind: which stations lie within 45 degrees of where the wind comes from, and their state in the hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import ratio
from hourloom.operators.rowwise import Columns
from hourloom.operators.temporal import History
from hourloom.schema import COMPASS, PRIMARY, STATIONS


def fixed(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of constants in one partition, so that joins of such tables don't multiply partitions."""
    each = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*each)).alias("row")).select("row.*")


def edges(spark: SparkSession, stations: dict[str, tuple[float, float]] = STATIONS) -> DataFrame:
    """station, wd, up_station and align (cosine of the angle), strictly within the cone. Fixed tables: 12 stations and 16 labels."""
    places = fixed(spark, [(s, *at) for s, at in stations.items()], "station", "lon", "lat")
    middle = F.radians(F.lit(sum(lat for _, lat in stations.values()) / len(stations)))
    places = places.select("station", (F.col("lon") * F.cos(middle)).alias("x"), F.col("lat").alias("y"))
    winds = fixed(spark, list(COMPASS.items()), "wd", "degrees")
    other = places.select(F.col("station").alias("up_station"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    pairs = places.join(other, F.col("station") != F.col("up_station"))
    dx, dy = F.col("ux") - F.col("x"), F.col("uy") - F.col("y")
    pairs = pairs.withColumn("length", F.sqrt(dx * dx + dy * dy)).select("station", "up_station", ratio(dx, "length").alias("dx"), ratio(dy, "length").alias("dy"))
    turn = F.radians("degrees")
    met = pairs.crossJoin(winds).select("station", "wd", "up_station", (F.col("dx") * F.sin(turn) + F.col("dy") * F.cos(turn)).alias("align"))
    return met.filter(F.col("align") > F.cos(F.radians(F.lit(45.0))))


def readings() -> Column:
    """An aggregate over the rows of an hour: station to its primary readings, of the stations that have a place. Their number is fixed, however many stations report."""
    known = F.when(F.col("station").isin(list(STATIONS)), F.struct(F.col("station").alias("key"), F.struct(*PRIMARY).alias("value")))
    return F.map_from_entries(F.collect_list(known))


def links(spark: SparkSession) -> DataFrame:
    """station, wd and links: all of edges() for that station and wind, as one array. A fixed table."""
    return edges(spark).coalesce(1).groupBy("station", "wd").agg(F.sort_array(F.collect_list(F.struct("up_station", "align"))).alias("links"))


def state(readings: str = "readings", links: str = "links") -> Columns:
    """Over the stations of a row's links: means of the readings there are, weighted by align too, and the number of stations, readings or not."""
    met = F.transform(links, lambda e: F.struct(e["align"].alias("align"), F.try_element_at(readings, e["up_station"]).alias("read")))
    total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda s, x: s + value(x))
    out: Columns = {}
    for c in PRIMARY:
        some = F.filter(met, lambda x: x["read"][c].isNotNull())
        weight = F.nullif(total(some, lambda x: x["align"]), F.lit(0.0))
        out[f"upwind_{c}_mean"] = total(some, lambda x: x["read"][c]) / F.nullif(F.size(some), F.lit(0))
        out[f"upwind_{c}_weighted"] = total(some, lambda x: x["read"][c] * x["align"]) / weight
    count = F.coalesce(F.size(links), F.lit(0))
    return out | {"upwind_count": count, "upwind_missing": (count <= 0).cast("int")}


def with_upwind(panel: DataFrame, ts: str = "observation_timestamp") -> DataFrame:
    """Adds state() to a panel that is unique by station and hour.

    The hour's readings are one row of a table by hour, which the rows join, unless they have met it already and have the column; the fixed table of links is
    broadcast. So rows are exchanged by hour once, whatever the number of their edges."""
    if "readings" not in panel.columns:
        panel = panel.join(panel.groupBy(ts).agg(readings().alias("readings")), ts, "left")
    out = panel.join(F.broadcast(links(panel.sparkSession)), ["station", "wd"], "left")
    made = state()
    return out.select(*[F.col(f"`{c}`") for c in panel.columns if c != "readings"], *[c.alias(n) for n, c in made.items()])


def history_columns(h: History) -> Columns:
    return {f"upwind_{c}_mean_lag_{n}h": h.lag(f"upwind_{c}_mean", n) for c in PRIMARY for n in (1, 3)}


def contrasts() -> Columns:
    out: Columns = {}
    for c in PRIMARY:
        m = f"upwind_{c}_mean"
        out[f"WSPM_x_upwind_{c}_contrast"] = F.col("WSPM") * (F.col(m) - F.col(c))
        out[f"upwind_{c}_change_1h"] = F.col(m) - F.col(f"{m}_lag_1h")
    return out


def coverage(panel: DataFrame) -> DataFrame:
    """coverage: the share of rows with a station upwind; n_rows. A row without a wind has none."""
    known = edges(panel.sparkSession).coalesce(1).select("station", "wd").distinct().withColumn("found", F.lit(1.0))
    met = panel.select("station", "wd").join(F.broadcast(known), ["station", "wd"], "left")
    return met.agg(F.avg(F.coalesce("found", F.lit(0.0))).alias("coverage"), F.count(F.lit(1)).alias("n_rows"))


def edge_use(panel: DataFrame, ts: str = "observation_timestamp") -> DataFrame:
    """station, wd, up_station, align, n_rows and n_read: for each edge that rows ask for how many do, and how many find a row of its station in their hour."""
    wanted = panel.select("station", ts, "wd").join(F.broadcast(edges(panel.sparkSession)), ["station", "wd"])
    there = panel.select(ts, F.col("station").alias("up_station"), F.lit(1).alias("there"))
    met = wanted.join(there, [ts, "up_station"], "left")
    return met.groupBy("station", "wd", "up_station", "align").agg(F.count(F.lit(1)).alias("n_rows"), F.count("there").alias("n_read"))
