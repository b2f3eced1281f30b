"""One query per operator over the driver's tables, with the same result in the oracle's SQL.

Doubles are rounded to six decimals on both sides, as sums may run in any order. The panel's values have six decimals, so the mean of
two of them often lies on the border of two roundings; SHIFT moves all values off that border first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import clip_low, rmse
from hourloom.operators import causality, checks, fitted, invariance, network, ridge, rowwise, splits, temporal, upwind
from hourloom.plans import features
from hourloom.plans.panel import NAMES, SPLIT, SQL, panel
from hourloom.schema import COMPASS, MEASURED, NETWORK, POLLUTANTS, PRIMARY, SECONDARY, STATIONS, TARGET, WEATHER, input_schema
from hourloom.sources import column_types as types_of
from hourloom.sources import content_digest, fault_counts, fingerprints, parse_lines, staged, with_place

TS = "observation_timestamp"
SHIFT = 3.7e-8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, on_panel: bool = True):
    """Registers a query by its function's name; on_panel: the oracle starts with the panel's table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if oracle:
            head, sep, rest = oracle.strip().partition("WITH ")
            ORACLES[f.__name__] = (f"WITH {SQL.strip()}, {rest}" if sep and not head else f"WITH {SQL.strip()} {oracle.strip()}") if on_panel else oracle.strip()
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers to bigint."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((F.round(x + F.lit(SHIFT), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else x.cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else x)
    return df.select(*out)


def on_rows(columns: dict, *keep: str):
    return lambda df: df.select("id", *keep, *[c.alias(n) for n, c in columns.items()])


def r(expr: str, name: str) -> str:
    return f"round({expr} + {SHIFT:.1e}::DOUBLE, 6) + 0.0::DOUBLE AS {name}"


def pick(names, source: str = "", keys: str = "id", table: str = "x") -> str:
    """SELECT of rounded columns from a table."""
    return f"SELECT {keys}, " + ", ".join(r(f"{source}{n}", n) for n in names) + f" FROM {table}"


# --- the oracle's families, as table expressions on the panel p ---------------------------------------------------------------

LAG_NAMES = [f"{c}_lag_{n}h" for _, columns, lags in temporal.LAGS for c in columns for n in lags]
LAG_SQL = (
    "l AS (SELECT p.*, "
    + ", ".join(f"l{n}.{c} AS {c}_lag_{n}h" for _, columns, lags in temporal.LAGS for c in columns for n in lags)
    + " FROM p "
    + " ".join(f"LEFT JOIN p l{n} ON l{n}.station = p.station AND l{n}.ts = p.ts - INTERVAL {n} HOUR" for n in (1, 2, 3, 6, 12, 24, 48))
    + ")"
)
ROLL = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLL_NAMES = [f"{c}_roll_{s}_{n}h" for c in PRIMARY for n in temporal.ROLLING for s in ROLL]
ROLL_SQL = (
    "w AS (SELECT id, ts, station, PM10, CO, "
    + ", ".join(f"{f}({c}) OVER w{n} AS {c}_roll_{s}_{n}h" for c in PRIMARY for n in temporal.ROLLING for s, f in ROLL.items())
    + " FROM p WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY station ORDER BY ts RANGE BETWEEN INTERVAL {n} HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING)" for n in temporal.ROLLING)
    + ")"
)
RATES = {f"{c}_change_{n}h": f"l.{c} - {c}_lag_{n}h" for c in [*PRIMARY, *SECONDARY] for n in (1, 3)}
for _c in PRIMARY:
    RATES |= {f"{_c}_pct_change_1h": f"(l.{_c} - {_c}_lag_1h) / nullif({_c}_lag_1h, 0)", f"{_c}_second_diff_1h": f"l.{_c} - 2 * {_c}_lag_1h + {_c}_lag_2h", f"{_c}_vs_roll_mean_24h": f"l.{_c} - {_c}_roll_mean_24h"}
STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
NET_NAMES = [f"network_{c}_{s}" for c in NETWORK for s in STAT]
NET_SQL = "n AS (SELECT ts, " + ", ".join(f"{f}({c}) AS network_{c}_{s}" for c in NETWORK for s, f in STAT.items()) + " FROM p GROUP BY ts)"
HIST = {f"network_{c}_mean_lag_{n}h": f"h{n}.network_{c}_mean" for c in PRIMARY for n in network.MEAN_LAGS} | {f"network_{c}_{s}_lag_1h": f"h1.network_{c}_{s}" for c in PRIMARY for s in ("std", "min", "max")}
HIST_SQL = "h AS (SELECT n.*, " + ", ".join(f"{x} AS {k}" for k, x in HIST.items()) + " FROM n " + " ".join(f"LEFT JOIN n h{k} ON h{k}.ts = n.ts - INTERVAL {k} HOUR" for k in network.MEAN_LAGS) + ")"
NET_RATES = {f"network_{c}_change_{n}h": f"network_{c}_mean - network_{c}_mean_lag_{n}h" for c in PRIMARY for n in (1, 3, 24)}
NET_RATES |= {f"network_{c}_second_diff_1h": f"network_{c}_mean - 2 * network_{c}_mean_lag_1h + network_{c}_mean_lag_3h" for c in PRIMARY}
PLACES = ", ".join(f"('{s}', {lon}::DOUBLE, {lat}::DOUBLE)" for s, (lon, lat) in STATIONS.items())
WINDS = ", ".join(f"('{w}', {d}::DOUBLE)" for w, d in COMPASS.items())
EDGE_SQL = f"""
s0(station, lon, lat) AS (VALUES {PLACES}), c0(wd, deg) AS (VALUES {WINDS}),
s1 AS (SELECT station, lon * cos(radians((SELECT avg(lat) FROM s0))) AS x, lat AS y FROM s0),
g AS (SELECT a.station, c0.wd, b.station AS up_station, ((b.x - a.x) * sin(radians(deg)) + (b.y - a.y) * cos(radians(deg))) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS align
      FROM s1 a JOIN s1 b ON a.station <> b.station, c0 WHERE align > cos(radians(45)))"""
UP_SQL = f"""{EDGE_SQL},
u AS (SELECT p.id, any_value(p.ts) AS ts, any_value(p.station) AS station, any_value(p.WSPM) AS WSPM, any_value(p.PM10) AS PM10, any_value(p.CO) AS CO, count(g.up_station) AS upwind_count,
      {', '.join(f"avg(q.{c}) AS upwind_{c}_mean, sum(q.{c} * g.align) / nullif(sum(CASE WHEN q.{c} IS NOT NULL THEN g.align END), 0) AS upwind_{c}_weighted" for c in PRIMARY)}
      FROM p LEFT JOIN g ON g.station = p.station AND g.wd = p.wd LEFT JOIN p q ON q.ts = p.ts AND q.station = g.up_station GROUP BY p.id)"""
UP_HIST = {f"upwind_{c}_mean_lag_{n}h": f"u{n}.upwind_{c}_mean" for c in PRIMARY for n in (1, 3)}
UP_HIST |= {f"WSPM_x_upwind_{c}_contrast": f"u.WSPM * (u.upwind_{c}_mean - u.{c})" for c in PRIMARY} | {f"upwind_{c}_change_1h": f"u.upwind_{c}_mean - u1.upwind_{c}_mean" for c in PRIMARY}
UP_JOIN = "FROM u LEFT JOIN u u1 ON u1.station = u.station AND u1.ts = u.ts - INTERVAL 1 HOUR LEFT JOIN u u3 ON u3.station = u.station AND u3.ts = u.ts - INTERVAL 3 HOUR"
RH = "100 * (exp(17.625 * DEWP / (243.04 + DEWP)) / exp(17.625 * TEMP / (243.04 + TEMP)))"
CAL_INT = {"year": "year({t})", "month": "month({t})", "day": "day({t})", "hour": "hour({t})", "dayofweek": "isodow({t}) - 1", "dayofyear": "dayofyear({t})", "is_winter": "(month({t}) IN (11, 12, 1, 2))::INT", "is_heating_season": "(month({t}) IN (11, 12, 1, 2, 3))::INT"}
CAL_CYC = {f"{n}_{f}": f"{f}(2 * pi() * ({CAL_INT[n]}) / {k})" for n, k in (("hour", 24), ("month", 12), ("dayofweek", 7), ("dayofyear", 365)) for f in ("sin", "cos")}
INTER = {f"{p}_x_{w}": f"{p} * {w}" for p in PRIMARY for w in ("WSPM", "TEMP", "DEWP", "RAIN")}
INTER |= {f"{a}_x_{b}": f"{a} * {b}" for a, b in (("CO", "NO2"), ("CO", "SO2"), ("NO2", "SO2"), ("NO2", "O3"), ("PM10", "CO"), ("PM10", "NO2"))}
for _c in PRIMARY:
    INTER |= {f"WSPM_x_network_{_c}_change": f"WSPM * (network_{_c}_mean - network_{_c}_mean_lag_1h)", f"WSPM_x_network_{_c}_mean": f"WSPM * network_{_c}_mean"}
    INTER |= {f"is_calm_x_{_c}": f"coalesce(WSPM < 1.0, false)::INT * {_c}", f"is_winter_x_{_c}": f"(month(p.ts) IN (11, 12, 1, 2))::INT * {_c}", f"{_c}_x_ddd": f"{_c} * (TEMP - DEWP)"}


def as_list(columns: dict[str, str], t: str = "ts") -> str:
    return ", ".join(r(x.replace("{t}", t), n) for n, x in columns.items())


def as_ints(columns: dict[str, str], t: str = "ts") -> str:
    return ", ".join(f"({x.replace('{t}', t)})::BIGINT AS {n}" for n, x in columns.items())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans and structure ------------------------------------------------------------------------------------------------------


@query(f"SELECT id, ts AS observation_timestamp, station, wd, {', '.join(r(c, c) for c in [*POLLUTANTS, *WEATHER])}, {r('target', TARGET)}, is_train::BIGINT AS _is_train FROM p")
def panel_hourly(spark, sf_dir):
    return panel(spark, sf_dir)


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)", on_panel=False)
def dup_keys(spark, sf_dir):
    return checks.duplicate_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM (SELECT station, ts FROM p UNION ALL SELECT station, ts FROM p WHERE PM10 > 50) GROUP BY station, ts)")
def dup_keys_panel(spark, sf_dir):
    """A panel of which some rows were read twice."""
    p = panel(spark, sf_dir)
    return checks.duplicate_rows(p.union(p.filter("PM10 > 50")), ["station", TS])


GAPS = "WITH d AS (SELECT date_diff('second', lag(ts) OVER (PARTITION BY station ORDER BY ts), ts) / 3600.0::DOUBLE AS gap_hours FROM p)"


@query(f"{GAPS} SELECT gap_hours, count(*) AS n FROM d WHERE gap_hours IS NOT NULL GROUP BY gap_hours ORDER BY n DESC, gap_hours LIMIT 5")
def gap_histogram(spark, sf_dir):
    gaps = temporal.gap_hours(panel(spark, sf_dir), ["station"]).filter("gap_hours IS NOT NULL")
    return gaps.groupBy("gap_hours").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap_hours").limit(5)


@query(f"{GAPS} SELECT count(*) FILTER (gap_hours <> 1) AS n_other, {r('avg((gap_hours <> 1)::INT)', 'share_other')} FROM d WHERE gap_hours IS NOT NULL")
def gap_share(spark, sf_dir):
    gaps = temporal.gap_hours(panel(spark, sf_dir), ["station"]).filter("gap_hours IS NOT NULL")
    return gaps.agg(F.count_if(F.col("gap_hours") != 1).alias("n_other"), F.avg((F.col("gap_hours") != 1).cast("double")).alias("share_other"))


@query("SELECT count(*) FILTER (EXTRACT(hour FROM ts) >= 20) AS n_wrong FROM p")
def calendar_agreement(spark, sf_dir):
    """Fields of a clock that stops at 19."""
    p = panel(spark, sf_dir)
    parts = {n: c for n, c in rowwise.calendar().items() if n in ("year", "month", "day")}
    return checks.calendar_disagreements(p.withColumns(parts | {"hour": F.least(F.hour(TS), F.lit(19))}))


#: Faults that csv_records plants in the panel's records: every so manieth id has this cell, or a cell more or less.
BAD_CELLS = {"PM10": (11, "abc"), "observation_timestamp": (13, "not a time"), "hour": (29, "3.5"), "CO": (31, "1e999")}
LONG, SHORT, KEYLESS = 17, 19, 23


def csv_records(df: DataFrame) -> DataFrame:
    """The panel as lines of CSV, with faults."""
    parts = {n: c for n, c in rowwise.calendar().items() if n in ("year", "month", "day", "hour")}
    cells = df.withColumns(parts).withColumn(TS, F.date_format(TS, "yyyy-MM-dd HH:mm:ss"))
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in input_schema(True).names}
    text |= {c: F.when(F.col("id") % n == 0, F.lit(bad)).otherwise(text[c]) for c, (n, bad) in BAD_CELLS.items()}
    text["id"] = F.when(F.col("id") % KEYLESS == 0, F.lit("")).otherwise(text["id"])
    line, short = (F.concat_ws(",", *x) for x in (list(text.values()), list(text.values())[:-1]))
    return cells.select(F.when(F.col("id") % LONG == 0, F.concat(line, F.lit(",9"))).when(F.col("id") % SHORT == 0, short).otherwise(line).alias("line"))


@query(
    f"WITH w AS (SELECT id FROM p WHERE id % {LONG} <> 0 AND id % {SHORT} <> 0) SELECT \"column\", reason, count(*) AS n FROM (SELECT NULL::VARCHAR AS \"column\", 'wrong length' AS reason FROM p WHERE id % {LONG} = 0 OR id % {SHORT} = 0"
    + f" UNION ALL SELECT 'id', 'missing key' FROM w WHERE id % {KEYLESS} = 0"
    + "".join(f" UNION ALL SELECT '{c}', 'malformed' FROM w WHERE id % {n} = 0" for c, (n, _) in BAD_CELLS.items())
    + ") GROUP BY \"column\", reason"
)
def csv_rejects(spark, sf_dir):
    """Bad numbers, times, lengths and keys in records of CSV, by column and reason."""
    return fault_counts(parse_lines(csv_records(panel(spark, sf_dir)), input_schema(True)))


GOOD = {c: f"CASE WHEN id % {n} <> 0 THEN {{}} END" for c, (n, _) in BAD_CELLS.items()}


@query(
    f"SELECT CASE WHEN id % {KEYLESS} <> 0 THEN id ELSE -1 END AS id, {GOOD[TS].format('ts')} AS observation_timestamp, station, coalesce({GOOD['hour'].format('hour(ts)')}, -1)::BIGINT AS hour, {r(GOOD['PM10'].format('PM10'), 'PM10')}, {r(GOOD['CO'].format('CO'), 'CO')}, wd FROM p WHERE id % {LONG} <> 0 AND id % {SHORT} <> 0"
)
def csv_parsed(spark, sf_dir):
    """The same records' cells in their types; what is malformed is null and listed as a fault, records of a wrong length left out here."""
    read = staged(parse_lines(csv_records(panel(spark, sf_dir)), input_schema(True))).filter("NOT exists(faults, f -> f.reason = 'wrong length')")
    unknown = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return read.select(unknown("id"), TS, "station", unknown("hour"), "PM10", "CO", "wd")


WHOLE_SQL = "CASE WHEN min({0}) >= -128 AND max({0}) <= 127 THEN 'tinyint' WHEN min({0}) >= -32768 AND max({0}) <= 32767 THEN 'smallint' WHEN min({0}) >= -2147483648 AND max({0}) <= 2147483647 THEN 'int' ELSE 'bigint' END"


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {WHOLE_SQL.format(c)} AS type, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    + "".join(f" UNION ALL SELECT '{c}', '{t}', '-', '-'" for c, t in (("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"))),
    on_panel=False,
)
def column_types(spark, sf_dir):
    """One type for each column of two parts of a table that are to be read together."""
    lines = read(spark, sf_dir, "lineitem")
    first = F.col("l_orderkey") < 100
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return types_of(lines.filter(first).unionByName(lines.filter(~first))).select("column", "type", text("least"), text("most"))


@query(
    f"""WITH q AS (SELECT CASE WHEN id % 31 <> 0 THEN id END AS id, ts, station, is_train, hour(ts) > 19 AS late, CASE WHEN id % 7 <> 0 THEN target END AS target FROM (SELECT * FROM p UNION ALL SELECT * FROM p WHERE PM10 > 50 UNION ALL SELECT * REPLACE (0 AS is_train) FROM p WHERE is_train = 1 AND id % 9 = 0)),
k AS (SELECT count(*) - 1 AS n FROM q GROUP BY station, ts), i AS (SELECT count(*) FILTER (is_train = 1) AS a, count(*) FILTER (is_train = 0) AS b FROM q GROUP BY id)
SELECT 'id is known' AS rule, count(*) AS n_broken FROM q WHERE id IS NULL UNION ALL SELECT 'observation_timestamp is known', 0 UNION ALL SELECT 'station is known', 0 UNION ALL SELECT 'timestamps are whole hours', 0
UNION ALL SELECT 'calendar fields are the timestamp''s', count(*) FROM q WHERE late UNION ALL SELECT 'training rows have a target', count(*) FROM q WHERE target IS NULL AND is_train = 1
UNION ALL SELECT 'station and hour are unique', sum(n)::BIGINT FROM k UNION ALL SELECT 'ids are unique', sum(greatest(a - 1, 0) + greatest(b - 1, 0))::BIGINT FROM i UNION ALL SELECT 'no id is in both splits', count(*) FROM i WHERE a > 0 AND b > 0"""
)
def rule_violations(spark, sf_dir):
    """A panel with unknown ids, a clock that stops at 19, missing targets, rows read twice and training rows among the test rows."""
    p = panel(spark, sf_dir)
    full = p.union(p.filter("PM10 > 50")).union(p.filter("_is_train = 1 AND id % 9 = 0").withColumn("_is_train", F.lit(0)))
    parts = {n: c for n, c in rowwise.calendar().items() if n in ("year", "month", "day")}
    full = full.withColumns(parts | {"hour": F.least(F.hour(TS), F.lit(19)), TARGET: F.when(F.col("id") % 7 != 0, F.col(TARGET))})
    return checks.violations(staged(full.withColumn("id", F.when(F.col("id") % 31 != 0, F.col("id")))), TARGET)


# --- row-wise families --------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {as_ints(CAL_INT, 'o_orderdate')} FROM orders", on_panel=False)
def calendar(spark, sf_dir):
    made = {n: c for n, c in rowwise.calendar("o_orderdate").items() if n in CAL_INT}
    return read(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in made.items()])


@query(f"SELECT id, {as_list(CAL_CYC)} FROM p")
def calendar_cyclic(spark, sf_dir):
    return on_rows({n: c for n, c in rowwise.calendar().items() if n in CAL_CYC})(panel(spark, sf_dir))


@query(f"WITH c0(wd, deg) AS (VALUES {WINDS}) SELECT id, {r('sin(radians(deg))', 'wd_sin')}, {r('cos(radians(deg))', 'wd_cos')}, {r('WSPM * sin(radians(deg))', 'wind_u')}, {r('WSPM * cos(radians(deg))', 'wind_v')}, coalesce(WSPM < 1.0, false)::BIGINT AS is_calm FROM p LEFT JOIN c0 USING (wd)")
def wind_encoding(spark, sf_dir):
    return on_rows(rowwise.wind())(panel(spark, sf_dir))


@query("SELECT id, " + ", ".join(f"({c} IS NULL)::BIGINT AS {c}_missing" for c in MEASURED) + " FROM p")
def missing_flags(spark, sf_dir):
    return on_rows(rowwise.missingness())(panel(spark, sf_dir))


@query("SELECT id, " + ", ".join(f"coalesce({x}, false)::BIGINT AS {n}" for n, x in (("co_floor", "CO = 100"), ("co_ceiling", "CO = 10000"), ("o3_extreme", "O3 > 400"), ("rain_active", "RAIN > 0"))) + " FROM p")
def quality_flags(spark, sf_dir):
    return on_rows(rowwise.quality_flags())(panel(spark, sf_dir))


@query("SELECT id, " + ", ".join([r("TEMP - DEWP", "TEMP_DEWP_diff"), *[r(f"{a} / nullif({b}, 0)", f"{a}_{b}_ratio") for a, b in (("NO2", "CO"), ("SO2", "CO"), ("SO2", "NO2"), ("PM10", "CO"), ("NO2", "O3"))], r(RH, "rh_proxy")]) + " FROM p")
def physical(spark, sf_dir):
    return on_rows(rowwise.physical())(panel(spark, sf_dir))


# --- history ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LAG_SQL} " + pick(LAG_NAMES, table="l"))
def lag_exact(spark, sf_dir):
    out = temporal.with_history(panel(spark, sf_dir), ["station"], temporal.lag_columns, 48)
    return out.select("id", *LAG_NAMES)


@query("SELECT p.id, " + ", ".join(r(f"q.{c}", f"{c}_lag_3h") for c in PRIMARY) + " FROM p LEFT JOIN p q ON q.station = p.station AND q.ts = p.ts - INTERVAL 3 HOUR")
def lag_exact_join(spark, sf_dir):
    return temporal.lags_by_join(panel(spark, sf_dir), ["station"], PRIMARY, 3).select("id", *[f"{c}_lag_3h" for c in PRIMARY])


@query(f"WITH {ROLL_SQL} " + pick(ROLL_NAMES, table="w"))
def rolling_closed_left(spark, sf_dir):
    return temporal.with_history(panel(spark, sf_dir), ["station"], temporal.rolling_columns, 24).select("id", *ROLL_NAMES)


@query(f"WITH {LAG_SQL}, {ROLL_SQL} SELECT l.id, {as_list(RATES)} FROM l JOIN w ON w.id = l.id")
def local_rates(spark, sf_dir):
    out = temporal.with_history(panel(spark, sf_dir), ["station"], lambda h: temporal.lag_columns(h) | temporal.rolling_columns(h), 48)
    return on_rows(temporal.rates())(out)


@query("SELECT id, " + ", ".join(r(f"date_diff('second', max(CASE WHEN {c} IS NOT NULL THEN ts END) OVER (PARTITION BY station ORDER BY ts), ts) / 3600.0::DOUBLE", f"{c}_hours_since") for c in POLLUTANTS) + " FROM p")
def time_since_observed(spark, sf_dir):
    return temporal.hours_since_observed(panel(spark, sf_dir), ["station"], POLLUTANTS).select("id", *[f"{c}_hours_since" for c in POLLUTANTS])


# --- network ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {NET_SQL} " + pick(NET_NAMES, table="p JOIN n USING (ts)"))
def network_state(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.join(network.hour_table(p), TS).select("id", *NET_NAMES)


@query(f"WITH {NET_SQL} SELECT ts AS observation_timestamp, " + ", ".join(r(f"network_{c}_max - network_{c}_min", f"network_{c}_range") for c in PRIMARY) + " FROM n")
def network_range(spark, sf_dir):
    return network.hour_table(panel(spark, sf_dir)).select(TS, *[f"network_{c}_range" for c in PRIMARY])


@query(f"WITH {NET_SQL} SELECT id, " + ", ".join(x for c in NETWORK for x in (r(f"{c} - network_{c}_mean", f"{c}_vs_network_mean"), r(f"({c} - network_{c}_mean) / nullif(network_{c}_std, 0)", f"{c}_vs_network_z"))) + " FROM p JOIN n USING (ts)")
def spatial_gradients(spark, sf_dir):
    p = panel(spark, sf_dir)
    return on_rows(network.gradients())(p.join(network.hour_table(p), TS))


@query(f"WITH {NET_SQL}, {HIST_SQL} " + pick(HIST, table="p JOIN h USING (ts)"))
def network_history(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.join(network.hours(p), TS).select("id", *HIST)


@query(f"WITH {NET_SQL}, {HIST_SQL} SELECT ts AS observation_timestamp, {as_list(NET_RATES)} FROM h")
def network_rates(spark, sf_dir):
    return network.hours(panel(spark, sf_dir)).select(TS, *NET_RATES)


@query(f"WITH {LAG_SQL}, {NET_SQL}, {HIST_SQL} SELECT id, " + ", ".join(r(f"({c} - {c}_lag_1h) - (network_{c}_mean - network_{c}_mean_lag_1h)", f"local_vs_network_{c}_change") for c in PRIMARY) + " FROM l JOIN h USING (ts)")
def local_vs_network(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = temporal.with_history(p.join(network.hours(p), TS), ["station"], lambda h: {f"{c}_lag_1h": h.lag(c, 1) for c in PRIMARY}, 1)
    return on_rows(network.local_vs_network())(out.withColumns({f"{c}_change_1h": F.col(c) - F.col(f"{c}_lag_1h") for c in PRIMARY}))


@query("SELECT ts AS observation_timestamp, " + ", ".join(r(f"avg(PM10) FILTER (station = '{s}')", s) for s in NAMES) + " FROM p GROUP BY ts")
def pivot_station(spark, sf_dir):
    return network.pivot_stations(panel(spark, sf_dir), "PM10", NAMES)


@query("SELECT DISTINCT ts AS observation_timestamp FROM p ORDER BY 1")
def distinct_axis(spark, sf_dir):
    return panel(spark, sf_dir).select(TS).distinct().orderBy(TS)


@query(f"WITH {NET_SQL} SELECT DISTINCT ts AS observation_timestamp, {r('network_PM10_mean', 'network_PM10_mean')} FROM p JOIN n USING (ts)")
def dedup_first(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.join(network.hour_table(p), TS).select(TS, "network_PM10_mean").dropDuplicates([TS])


# --- upwind -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGE_SQL.strip()} SELECT g.station, g.wd, g.up_station, {r('g.align', 'align')}, count(*) AS n_rows, count(q.ts) AS n_read FROM p JOIN g USING (station, wd) LEFT JOIN p q ON q.ts = p.ts AND q.station = g.up_station GROUP BY g.station, g.wd, g.up_station, g.align")
def upwind_map(spark, sf_dir):
    """Each edge that the panel's winds ask for: by how many rows, and how many of them find its station's reading."""
    return upwind.edge_use(staged(panel(spark, sf_dir)))


@query(f"WITH {EDGE_SQL.strip()} SELECT {r('avg((k.station IS NOT NULL)::INT)', 'coverage')}, count(*) AS n_rows FROM p LEFT JOIN (SELECT DISTINCT station, wd FROM g) k USING (station, wd)")
def upwind_coverage(spark, sf_dir):
    """Share of the panel's rows with a station upwind."""
    return upwind.coverage(panel(spark, sf_dir))


UP_NAMES = [f"upwind_{c}_{s}" for c in PRIMARY for s in ("mean", "weighted")]


@query(f"WITH {UP_SQL.strip()} " + pick(UP_NAMES, keys="id, upwind_count, (upwind_count = 0)::BIGINT AS upwind_missing", table="u"))
def upwind_state(spark, sf_dir):
    p = panel(spark, sf_dir)
    return upwind.with_upwind(p).select("id", "upwind_count", "upwind_missing", *UP_NAMES)


@query(f"WITH {UP_SQL.strip()} SELECT u.id, {as_list(UP_HIST)} {UP_JOIN}")
def upwind_history(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = temporal.with_history(upwind.with_upwind(p), ["station"], upwind.history_columns, 3)
    return out.select("id", *[f"upwind_{c}_mean_lag_{n}h" for c in PRIMARY for n in (1, 3)], *[c.alias(n) for n, c in upwind.contrasts().items()])


# --- products and the whole table ---------------------------------------------------------------------------------------------


@query(f"WITH {NET_SQL}, {HIST_SQL} SELECT id, {as_list(INTER)} FROM p JOIN h USING (ts)")
def interactions(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = p.join(network.hours(p), TS).withColumns(rowwise.calendar() | rowwise.wind() | rowwise.physical())
    return on_rows(rowwise.interactions())(out)


FLAGSHIP = [*LAG_NAMES, *ROLL_NAMES, *NET_NAMES, *HIST, *NET_RATES, *UP_NAMES]


@query(f"WITH {LAG_SQL}, {ROLL_SQL}, {NET_SQL}, {HIST_SQL}, {UP_SQL.strip()}, k AS (SELECT h.*, {', '.join(f'{x} AS {n}' for n, x in NET_RATES.items())} FROM h) SELECT l.id, l.ts AS observation_timestamp, l.station, " + ", ".join(r(n, n) for n in FLAGSHIP) + " FROM l JOIN w ON w.id = l.id JOIN k ON k.ts = l.ts JOIN u ON u.id = l.id")
def feature_matrix(spark, sf_dir):
    return features.build_features(staged(panel(spark, sf_dir))).select("id", TS, "station", *FLAGSHIP)


def whole_sql() -> str:
    """Every family's own oracle as a table by id, all joined, with the columns of the input."""
    body = lambda name: ORACLES[name].removeprefix(f"WITH {SQL.strip()}").strip().removeprefix(",").strip()
    parts = ("calendar_cyclic", "wind_encoding", "missing_flags", "quality_flags", "physical", "lag_exact", "rolling_closed_left", "local_rates", "network_state", "spatial_gradients", "network_history", "local_vs_network", "upwind_state", "upwind_history", "interactions")
    nested = {f"f_{n}": body(n) if body(n).startswith("SELECT") else f"WITH {body(n)}" for n in parts}
    nested["f_calendar"] = f"SELECT id, {as_ints(CAL_INT)} FROM p"
    for n in ("network_range", "network_rates"):
        nested[f"f_{n}"] = f"SELECT p.id, t.* EXCLUDE (observation_timestamp) FROM p JOIN (WITH {body(n)}) t ON t.observation_timestamp = p.ts"
    own = f"SELECT id, ts AS observation_timestamp, is_train::BIGINT AS _is_train, station, {', '.join(r(c, c) for c in [*POLLUTANTS, *WEATHER])} FROM p"
    return f"WITH {SQL.strip()}, " + ", ".join(f"{n} AS MATERIALIZED ({x})" for n, x in nested.items()) + f", f_own AS ({own}) SELECT * FROM f_own " + " ".join(f"JOIN {n} USING (id)" for n in nested)


@query(whole_sql(), on_panel=False)
def feature_matrix_full(spark, sf_dir):
    """All 261 columns. The panel is written once, as a table that the plan reads twice: by hour and by row."""
    return features.build_features(staged(panel(spark, sf_dir)))


LOCAL = ["RAW", "LOCAL_LAGS_SHORT", "LOCAL_LAGS_MEDIUM", "LOCAL_LAGS_LONG"]
PAST = ["RAW", "STATION", "CALENDAR", "WIND_ENCODING", "MISSINGNESS", "QUALITY_FLAGS", "PHYSICAL", "LOCAL_LAGS_SHORT", "LOCAL_LAGS_MEDIUM", "LOCAL_LAGS_LONG", "LOCAL_ROLLING", "LOCAL_RATES", "NETWORK_HISTORY"]
SHARED = ["NETWORK_STATE", "SPATIAL_GRADIENTS", "NETWORK_RATES", "INTERACTIONS"]


def names_of(families: list[str]) -> str:
    """Columns of families, from the oracle's own names."""
    own = {
        "RAW": [*POLLUTANTS, *WEATHER], "STATION": ["station"], "CALENDAR": [*CAL_INT, *CAL_CYC], "WIND_ENCODING": ["wd_sin", "wd_cos", "wind_u", "wind_v", "is_calm"], "MISSINGNESS": [f"{c}_missing" for c in MEASURED],
        "QUALITY_FLAGS": ["co_floor", "co_ceiling", "o3_extreme", "rain_active"], "PHYSICAL": ["TEMP_DEWP_diff", "NO2_CO_ratio", "SO2_CO_ratio", "SO2_NO2_ratio", "PM10_CO_ratio", "NO2_O3_ratio", "rh_proxy"],
        "LOCAL_ROLLING": ROLL_NAMES, "LOCAL_RATES": list(RATES), "NETWORK_STATE": [*NET_NAMES, *[f"network_{c}_range" for c in PRIMARY]], "SPATIAL_GRADIENTS": [f"{c}_vs_network_{k}" for c in NETWORK for k in ("mean", "z")],
        "NETWORK_HISTORY": list(HIST), "NETWORK_RATES": list(NET_RATES), "UPWIND": ["upwind_count", "upwind_missing", *UP_NAMES, *UP_HIST], "INTERACTIONS": list(INTER), "LOCAL_VS_NETWORK": [f"local_vs_network_{c}_change" for c in PRIMARY],
    }
    for f in ("LOCAL_LAGS_SHORT", "LOCAL_LAGS_MEDIUM", "LOCAL_LAGS_LONG"):
        own[f] = [f"{c}_lag_{n}h" for g, columns, lags in temporal.LAGS if g == f for c in columns for n in lags]
    return ", ".join(dict.fromkeys(c for f in families for c in own[f]))


def part(only: list[str]) -> str:
    return f"SELECT id, observation_timestamp, _is_train, {names_of(only)} FROM ({whole_sql()})"


@query(part(LOCAL), on_panel=False)
def features_local(spark, sf_dir):
    """Readings and their lags: rows are exchanged once."""
    return features.build_features(panel(spark, sf_dir), only=LOCAL)


@query(part(PAST), on_panel=False)
def features_without_same_hour(spark, sf_dir):
    """What a forecast knows before the other stations' readings of its hour arrive."""
    return features.build_features(staged(panel(spark, sf_dir)), only=features.without_same_hour(features.families()))


@query(part(SHARED), on_panel=False)
def features_shared(spark, sf_dir):
    """Network families and products, without any window over a station's rows."""
    return features.build_features(staged(panel(spark, sf_dir)), only=SHARED)


@query(part(["UPWIND"]), on_panel=False)
def features_upwind(spark, sf_dir):
    return features.build_features(staged(panel(spark, sf_dir)), only=["UPWIND"])


# --- splits, alignment and audits ---------------------------------------------------------------------------------------------


@query(f"SELECT id, station, is_train::BIGINT AS _is_train, {r('PM10', 'PM10')} FROM p")
def union_split(spark, sf_dir):
    p = panel(spark, sf_dir)
    train, test = (p.filter(F.col("_is_train") == k).drop("_is_train") for k in (1, 0))
    full = splits.union(train, test.drop(TARGET))
    a, b = splits.split(full)
    return a.withColumn("_is_train", F.lit(1)).unionByName(b.withColumn("_is_train", F.lit(0))).select("id", "station", "_is_train", "PM10")


@query(f"SELECT p.id, p.station, p.ts AS observation_timestamp, {r('q.target', TARGET)} FROM p LEFT JOIN p q ON q.station = p.station AND q.ts = p.ts + INTERVAL 2 HOUR AND q.is_train = 1 WHERE p.is_train = 1")
def align_target(spark, sf_dir):
    """Targets that come from another table, by the key two hours later; some rows have none."""
    train = panel(spark, sf_dir).filter("_is_train = 1")
    other = train.select("station", (F.col(TS) - F.expr("INTERVAL 2 HOUR")).cast("timestamp_ntz").alias(TS), TARGET)
    return checks.join_one_to_one(train.select("id", "station", TS), other, ["station", TS])


AUDITED = [*POLLUTANTS, *WEATHER]


def audit_sql(target: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, {r(f'avg((abs(t - {c}) <= 1e-6 + 1e-5 * abs({c}))::INT)', 'exact_match_rate')}, {r(f'covar_samp(t, {c}) / nullif(stddev_samp(t) * stddev_samp({c}), 0)', 'corr')} FROM b WHERE t IS NOT NULL AND {c} IS NOT NULL HAVING count(*) > 0"
        for c in AUDITED
    )
    return f"WITH b AS (SELECT {target} AS t, {', '.join(f'q.{c}' for c in AUDITED)} FROM p LEFT JOIN p q ON q.station = p.station AND q.ts = p.ts + INTERVAL 1 HOUR LEFT JOIN p z ON z.station = p.station AND z.ts = p.ts + INTERVAL 1 HOUR) {each}"


@query(audit_sql("p.target"))
def leak_audit(spark, sf_dir):
    return checks.leak_audit(panel(spark, sf_dir), AUDITED, TARGET)


@query(audit_sql("z.PM10"))
def leak_audit_found(spark, sf_dir):
    """The target is PM10 an hour later, so its rate is 1."""
    p = panel(spark, sf_dir)
    later = p.select("station", (F.col(TS) - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz").alias(TS), F.col("PM10").alias("leak"))
    return checks.leak_audit(p.join(later, ["station", TS], "left"), AUDITED, "leak")


@query("SELECT \"column\", round(rate, 4) + 0.0 AS missing_rate FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(({c} IS NULL)::INT) AS rate FROM p" for c in MEASURED) + ") ORDER BY rate DESC, \"column\" LIMIT 15")
def missing_rate_topk(spark, sf_dir):
    rates = checks.missing_rates(panel(spark, sf_dir), MEASURED).orderBy(F.desc("missing_rate"), "column").limit(15)
    return rates.select("column", F.round("missing_rate", 4).alias("missing_rate"))


@query("SELECT is_train::BIGINT AS _is_train, \"column\", n_missing::BIGINT AS n_missing FROM (" + " UNION ALL ".join(f"SELECT is_train, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM p GROUP BY is_train" for c in MEASURED) + ")")
def missing_counts(spark, sf_dir):
    return checks.missing_counts(panel(spark, sf_dir), "_is_train", MEASURED)


@query("SELECT 'nothing' AS \"column\", 1.0::DOUBLE AS missing_rate")
def fully_missing(spark, sf_dir):
    return checks.fully_missing(panel(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double")), [*MEASURED, "nothing"])


NUMERIC = [f for f in (*PAST, *SHARED, "LOCAL_VS_NETWORK", "UPWIND")]


def family_sql() -> str:
    rows = ", ".join(f"{{'family': '{f}', 'n_columns': {len(own)}::BIGINT, 'n_missing': ({' + '.join(f'count(*) - count({c})' for c in own)})::BIGINT, 'n_complete': (count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in own)}))::BIGINT}}" for f in NUMERIC if (own := names_of([f]).split(", ")))
    return f"SELECT unnest([{rows}], recursive := true) FROM ({whole_sql()})"


@query(family_sql(), on_panel=False)
def family_counts(spark, sf_dir):
    """Columns of each family, their missing values in the panel, and the rows in which all of them are known."""
    return features.family_counts(features.build_features(staged(panel(spark, sf_dir))))


@query("SELECT 'gap' AS \"column\", count(*) AS n_rows, count(PM10 - CO) AS n_known FROM p UNION ALL SELECT 'wd_deg', count(*), count(wd) FROM p")
def unassigned(spark, sf_dir):
    """Columns of a table of features that no family has, with how much they hold."""
    made = features.build_features(panel(spark, sf_dir).withColumn("wd_deg", rowwise.wind_degrees()), ("id", TS, "_is_train", "wd_deg"), ["RAW", "STATION", "CALENDAR"])
    made = made.withColumn("gap", F.col("PM10") - F.col("CO"))
    rest = [c for c in features.unassigned(made.columns, features.families()) if c not in ("id", TS, "_is_train")]
    return made.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in rest]).unpivot(["n_rows"], rest, "column", "n_known").select("column", "n_rows", "n_known")


@query("SELECT event_id, 'left' AS side FROM events WHERE event_id % 97 = 0 UNION ALL SELECT event_id, 'right' AS side FROM events WHERE event_id % 97 = 0", on_panel=False)
def release_diff(spark, sf_dir):
    """Two releases of which one has a changed value in every 97th row."""
    old = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    new = old.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return checks.difference(old, new).select("event_id", "side")


@query("SELECT id, 'train' AS part FROM p WHERE ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-20' UNION ALL SELECT id, 'validate' AS part FROM p WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25'")
def holdout_embargo(spark, sf_dir):
    train, validate = splits.holdout(panel(spark, sf_dir), "2024-01-20", "2024-01-25")
    return train.select("id", F.lit("train").alias("part")).union(validate.select("id", F.lit("validate").alias("part")))


@query(f"SELECT is_train::BIGINT AS _is_train, {r('sqrt(avg(pow(target - CASE WHEN TEMP < 0 THEN 0 ELSE TEMP END, 2)))', 'rmse')} FROM p GROUP BY is_train")
def rmse_clip(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("_is_train").agg(rmse(TARGET, clip_low("TEMP")).alias("rmse"))


@query(f"SELECT {r('min(target)', 'least')}, {r('max(target)', 'most')}, min(ts) AS first, max(ts) AS last, count(*) AS n FROM p")
def report_ranges(spark, sf_dir):
    return panel(spark, sf_dir).agg(F.min(TARGET).alias("least"), F.max(TARGET).alias("most"), F.min(TS).alias("first"), F.max(TS).alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, {r('coalesce(CO, (SELECT avg(CO) FROM p WHERE is_train = 1))', 'CO')}, {r('coalesce(O3, (SELECT avg(O3) FROM p WHERE is_train = 1))', 'O3')} FROM p")
def fill_from_training(spark, sf_dir):
    return splits.fill_from_training(panel(spark, sf_dir), ["CO", "O3"]).select("id", "CO", "O3")


@query(f"SELECT id, {r('(TEMP - (SELECT avg(TEMP) FROM p WHERE is_train = 1)) / nullif((SELECT stddev_samp(TEMP) FROM p WHERE is_train = 1), 0)', 'TEMP')} FROM p")
def scale_from_training(spark, sf_dir):
    return splits.scale_from_training(panel(spark, sf_dir), ["TEMP"]).select("id", "TEMP")


VARIANTS = {"base": "TEMP", "better": "0.4 * PM10 + WSPM", "mixed": "CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0.4 * PM10 ELSE -PM10 END", "negative": "-PM10"}
PARTS = {"A": ("2024-01-10", "2024-01-15"), "B": ("2024-01-20", "2024-01-25")}
ABLATION_RMSE = ", ".join(f"(SELECT sqrt(avg(pow(target - CASE WHEN {{0}} < 0 THEN 0 ELSE {{0}} END, 2))) FROM v WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}') AS {{1}}_{h}" for h, (a, b) in PARTS.items())


@query(
    "WITH v AS (SELECT ts, target, " + ", ".join(f"{x} AS {n}" for n, x in VARIANTS.items()) + " FROM p), o AS (SELECT " + ABLATION_RMSE.format("base", "b") + "), k AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS candidate, {ABLATION_RMSE.format(n, 'c')}" for n in VARIANTS if n != "base")
    + f") SELECT candidate, {r('b_A', 'base_rmse_A')}, {r('c_A', 'rmse_A')}, {r('b_B', 'base_rmse_B')}, {r('c_B', 'rmse_B')}, c_A < b_A AND c_B < b_B AS accepted FROM k, o"
)
def ablation(spark, sf_dir):
    """Three variants of a prediction against a base in two holdouts: better in both, in one, in none."""
    p = panel(spark, sf_dir)
    scored = p.select(TS, TARGET, *[F.expr(x.replace("ts <", f"{TS} <").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")).alias(n) for n, x in VARIANTS.items()])
    return splits.ablation(scored, "base", [n for n in VARIANTS if n != "base"], TARGET, PARTS)


# --- models, causality, releases and fitted tables -----------------------------------------------------------------------------

ALPHA = 2.5
SUBSETS = {"base": ["TEMP"], "base + CO": ["TEMP", "CO"], "base + PM10": ["TEMP", "PM10"], "all": ["TEMP", "CO", "PM10"], "WSPM, PM10": ["WSPM", "PM10"]}


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {x} * {determinant([r[:j] + r[j + 1 :] for r in m[1:]])}" for j, x in enumerate(m[0])) + ")"


def ridge_sql() -> str:
    """Ridge by Cramer's rule: standard scores of the training rows, normal equations, errors row by row."""
    columns = list(dict.fromkeys(c for own in SUBSETS.values() for c in own))
    tables, rows = [], []
    for h, (a, b) in PARTS.items():
        train, valid = f"ts + INTERVAL 1 HOUR < TIMESTAMP '{a}'", f"ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'"
        tables.append(f"s{h} AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}" for c in columns) + f", avg(target) AS m FROM p WHERE {train})")
        tables.append(f"z{h} AS (SELECT ts, target, m, " + ", ".join(f"coalesce(({c} - m_{c}) / d_{c}, 0) AS {c}" for c in columns) + f" FROM p, s{h})")
        for v, own in SUBSETS.items():
            matrix = [[f"(sum({x} * {y}) - sum({x}) * sum({y}) / count(*) + {ALPHA if x == y else 0})" for y in own] for x in own]
            right = [f"(sum({x} * target) - sum({x}) * avg(target))" for x in own]
            solved = [f"{determinant([[right[i] if j == k else matrix[i][j] for j in range(len(own))] for i in range(len(own))])} / {determinant(matrix)} AS w_{x}" for k, x in enumerate(own)]
            name = f"{h}{list(SUBSETS).index(v)}"
            tables.append(f"w{name} AS (SELECT {', '.join(solved)}, avg(target) AS m0, " + ", ".join(f"avg({x}) AS c_{x}" for x in own) + f" FROM z{h} WHERE {train})")
            tables.append(f"e{name} AS (SELECT sqrt(avg(pow(target - m0 - " + " - ".join(f"w_{x} * ({x} - c_{x})" for x in own) + f", 2))) AS e FROM z{h}, w{name} WHERE {valid})")
    for i, (v, own) in enumerate(SUBSETS.items()):
        won = " AND ".join(f"(SELECT e FROM e{h}{i}) < (SELECT e FROM e{h}0)" for h in PARTS) if i else "false"
        rows.append(f"SELECT '{v}' AS variant, {len(own)}::BIGINT AS n_columns, " + ", ".join(r(f"(SELECT e FROM e{h}{i})", f"rmse_{h}") for h in PARTS) + f", {won} AS accepted")
    return "WITH " + ", ".join(tables) + " " + " UNION ALL ".join(rows)


@query(ridge_sql())
def ridge_ablation(spark, sf_dir):
    """Ridge of five subsets of columns in two holdouts, from one pass."""
    return ridge.ablation(panel(spark, sf_dir), SUBSETS, "base", ALPHA, TARGET, PARTS)


CUTS = ("2024-01-12 05:00:00", "2024-01-24 23:00:00")


@query(" UNION ALL ".join(f"SELECT TIMESTAMP '{c}' AS cut, 'PM10_next' AS \"column\", min(p.ts) AS first_hour, count(DISTINCT p.ts) AS n_hours FROM p JOIN p q ON q.station = p.station AND q.ts = p.ts + INTERVAL 1 HOUR WHERE p.ts <= TIMESTAMP '{c}' AND q.ts > TIMESTAMP '{c}' HAVING count(*) > 0" for c in CUTS))
def truncation_audit(spark, sf_dir):
    """Features of the past and a planted one that reads the next hour: only that one changes when later rows go."""
    later = temporal.Window.partitionBy("station").orderBy(temporal.epoch(TS)).rangeBetween(temporal.HOUR, temporal.HOUR)

    def build(rows: DataFrame) -> DataFrame:
        made = features.build_features(rows, ("id", TS, "station"), ["RAW", "LOCAL_LAGS_LONG", "LOCAL_ROLLING", "NETWORK_HISTORY"])
        return made.withColumn("PM10_next", F.max("PM10").over(later)).drop("station")

    return invariance.truncation_differences(build, staged(panel(spark, sf_dir)), list(CUTS))


READ = [*(f for f in PAST if f not in ("STATION", "CALENDAR", "MISSINGNESS")), *SHARED, "LOCAL_VS_NETWORK", "UPWIND"]


def reads_sql() -> str:
    """How far back and how late a column reads, by its name, and how many of its values are missing."""
    back = "CASE WHEN c LIKE 'network%second_diff_1h' THEN -3 WHEN c LIKE '%second_diff_1h' THEN -2 WHEN c LIKE 'local_vs_network%' OR c LIKE 'WSPM_x_network%_change' THEN -1 WHEN regexp_matches(c, '[0-9]h$') THEN -regexp_extract(c, '([0-9]+)h$', 1)::INT ELSE 0 END"
    late = f"CASE WHEN regexp_matches(c, '_lag_[0-9]+h$') THEN {back} WHEN c LIKE '%\\_roll\\_%' ESCAPE '\\' AND c NOT LIKE '%\\_vs\\_%' ESCAPE '\\' THEN -1 / 3600 ELSE 0 END".replace("\\\\", "\\")
    columns = [c.strip() for c in names_of(READ).split(",")]
    counts = ", ".join(f"{{'c': '{c}', 'n_missing': count(*) - count({c})}}" for c in columns)
    others = "(c LIKE '%network%' OR c LIKE '%upwind%') AND c NOT IN ('upwind_count', 'upwind_missing')"
    return f"SELECT c AS \"column\", {r(f'({back})::DOUBLE', 'earliest_hours')}, {r(f'({late})::DOUBLE', 'latest_hours')}, {others} AS others, n_missing FROM (SELECT unnest([{counts}], recursive := true) FROM ({whole_sql()}))"


@query(reads_sql(), on_panel=False)
def feature_reads(spark, sf_dir):
    """For each column of the families made of readings: how many hours before and after its row it reads them, by the plan, whether from other stations too, and how many values it lacks."""
    p = staged(panel(spark, sf_dir))
    made = features.build_features(p, only=READ)
    found = {c: [x for x in own if x.column not in ("station", TS)] for c, own in causality.reads(made).items()}
    columns = [c for c in made.columns if c not in ("id", TS, "_is_train")]
    missing = made.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column", "n_missing")
    rows = [(c, min(x.first for x in found[c]) / 3600, max(x.last for x in found[c]) / 3600, any(x.others for x in found[c])) for c in columns]
    known = spark.createDataFrame(rows, "column string, earliest_hours double, latest_hours double, others boolean")
    return known.join(missing, "column")


@query("WITH l AS (SELECT row_number() OVER () - 1 AS place, * FROM orders), s AS (SELECT CASE WHEN place % 1000 = 1 AND place + 1 < (SELECT count(*) FROM l) THEN place + 1 WHEN place % 1000 = 2 THEN place - 1 ELSE place END AS place, * EXCLUDE (place) FROM l) SELECT l.place, 'value' AS differs FROM l JOIN s USING (place) WHERE l.o_orderkey <> s.o_orderkey", on_panel=False)
def release_order(spark, sf_dir):
    """Two releases of which one has every thousandth pair of neighbours swapped: the same rows, in another order."""
    old = with_place(read(spark, sf_dir, "orders"))
    n = old.count()
    place = F.when((F.col("place") % 1000 == 1) & (F.col("place") + 1 < n), F.col("place") + 1).when(F.col("place") % 1000 == 2, F.col("place") - 1).otherwise(F.col("place"))
    new = staged(old.withColumn("place", place).orderBy("place").drop("place"), "release")
    return checks.order_differences(old, with_place(new))


@query(
    "SELECT count(*) AS n_rows, sum(('0x' || substr(md5(coalesce(length(event_id::VARCHAR) || ':' || event_id, '-') || coalesce(length(v::VARCHAR) || ':' || v, '-') || coalesce(length(event_type) || ':' || event_type, '-') || coalesce(length(props) || ':' || props, '-')), 1, 12))::BIGINT)::VARCHAR AS digest FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN round(value * 1000)::BIGINT END AS v FROM events)",
    on_panel=False,
)
def release_digest(spark, sf_dir):
    """A digest of the events' contents that doesn't depend on files or order."""
    v = F.when(F.col("event_id") % 5 != 0, F.round(F.col("value") * 1000).cast("bigint"))
    return content_digest(read(spark, sf_dir, "events").select("event_id", v.alias("v"), "event_type", "props").repartition(3))


FITTED = ["CO", "O3"]


@query(
    "WITH t AS (SELECT * FROM p WHERE is_train = 1), fa AS (SELECT station, hour(ts) AS h, " + ", ".join(f"CASE WHEN count({c}) >= 3 THEN avg({c}) END AS {c}" for c in FITTED) + " FROM t GROUP BY ALL), fb AS (SELECT station, "
    + ", ".join(f"CASE WHEN count({c}) >= 3 THEN avg({c}) END AS {c}" for c in FITTED) + " FROM t GROUP BY ALL), fc AS (SELECT " + ", ".join(f"CASE WHEN count({c}) >= 3 THEN avg({c}) END AS {c}" for c in FITTED) + " FROM t) SELECT p.id, "
    + ", ".join(r(f"coalesce(p.{c}, fa.{c}, fb.{c}, fc.{c})", c) + f", CASE WHEN p.{c} IS NOT NULL THEN 'read' WHEN fa.{c} IS NOT NULL THEN 'station and hour' WHEN fb.{c} IS NOT NULL THEN 'station' WHEN fc.{c} IS NOT NULL THEN 'all' END AS {c}_from" for c in FITTED)
    + " FROM p LEFT JOIN fa ON fa.station = p.station AND fa.h = hour(p.ts) LEFT JOIN fb ON fb.station = p.station, fc WHERE p.is_train = 0"
)
def fill_by_station_hour(spark, sf_dir):
    """Missing readings of the test rows from a table fitted on the training rows."""
    p = panel(spark, sf_dir)
    table = staged(fitted.fit_means(p.filter("_is_train = 1"), FITTED), "fitted")
    fitted.require_not_fitted_in(table, SPLIT, "2025-01-01")
    return fitted.fill_means(p.filter("_is_train = 0"), table, FITTED, least=3).select("id", *[x for c in FITTED for x in (c, f"{c}_from")])


@query()
def sha256_files(spark, sf_dir):
    """All files of the tables; raw bytes can't be read from the oracle's views, so the tests hash them by themselves."""
    return fingerprints(spark, f"{sf_dir}/*.parquet")
