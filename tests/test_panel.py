"""Toy panels: gaps, missing readings, single stations, constant hours, zero denominators, missing wind, truncated history."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from hourloom.functions import clip_low, correlation, ratio
from hourloom.operators import checks, network, rowwise, splits, temporal, upwind
from hourloom.plans import features
from hourloom.schema import COMPASS, POLLUTANTS, STATIONS, TARGET, WEATHER
from hourloom.sources import fingerprints, guard_columns, read_panel_csv, read_registry, write_parquet

START = dt.datetime(2016, 1, 1)
NUMBERS = [*POLLUTANTS, *WEATHER]
SCHEMA = "id long, observation_timestamp timestamp_ntz, station string, wd string, " + ", ".join(f"{c} double" for c in NUMBERS)


def panel(spark, rows):
    """rows: (hour, station, values); values not given are 1, wd is N."""
    out = []
    for i, (h, s, values) in enumerate(rows):
        out.append((i, START + dt.timedelta(hours=h), s, values.get("wd", "N"), *[None if values.get(c, 1.0) is None else float(values.get(c, 1.0)) for c in NUMBERS]))
    return spark.createDataFrame(out, SCHEMA)


def by_hour(df):
    return {int((r["observation_timestamp"] - START).total_seconds() // 3600): r for r in df.collect()}


def test_gap_lag_and_closed_left_window(spark):
    p = panel(spark, [(h, "Dongsi", {"PM10": v}) for h, v in ((0, 10), (1, 20), (3, 40), (4, 50), (9, 60))])
    got = by_hour(temporal.with_history(p, ["station"], lambda h: {"lag": h.lag("PM10", 1), **{f"r_{k}": x for k, x in h.trailing("PM10", 3).items()}}, 3))
    assert got[3]["lag"] is None and got[1]["lag"] == 10 and got[4]["lag"] == 40
    assert got[3]["r_mean"] == 15 and got[3]["r_min"] == 10 and got[4]["r_mean"] == 30
    assert got[0]["r_mean"] is None and got[1]["r_std"] is None and got[9]["r_max"] is None


@pytest.mark.parametrize("bucket", [1, 5, 48, 10_000])
def test_buckets_with_halo_change_nothing(spark, bucket):
    p = panel(spark, [(h, s, {"PM10": h * 7 % 13, "CO": None if h % 5 == 0 else h}) for h in range(60) if h % 7 for s in ("Dongsi", "Wanliu")])
    made = lambda b: temporal.with_history(p, ["station"], lambda h: temporal.lag_columns(h) | temporal.rolling_columns(h), 48, bucket_hours=b)
    assert sorted(map(str, made(bucket).collect())) == sorted(map(str, made(temporal.BUCKET_HOURS).collect()))


def test_lag_by_frame_equals_lag_by_join(spark):
    p = panel(spark, [(h, s, {"PM10": h}) for h in (0, 1, 2, 5, 6, 9) for s in ("Dongsi", "Wanliu")])
    a = temporal.with_history(p, ["station"], lambda h: {"x": h.lag("PM10", 3)}, 3).select("id", "x")
    b = temporal.lags_by_join(p, ["station"], ["PM10"], 3).select("id", F.col("PM10_lag_3h").alias("x"))
    assert checks.difference(a, b).count() == 0


def test_missing_value_is_not_a_missing_row(spark):
    p = panel(spark, [(0, "Dongsi", {}), (1, "Dongsi", {"PM10": None}), (3, "Dongsi", {})])
    got = by_hour(features.build_features(p))
    assert [got[h]["PM10_missing"] for h in (0, 1, 3)] == [0, 1, 0]
    assert got[3]["PM10_lag_2h"] is None and got[3]["PM10_lag_3h"] == 1


def test_network_of_one_station_and_of_equal_stations(spark):
    one = by_hour(features.build_features(panel(spark, [(0, "Dongsi", {"PM10": 5})])))[0]
    assert one["network_PM10_mean"] == 5 and one["network_PM10_std"] is None and one["PM10_vs_network_z"] is None
    same = features.build_features(panel(spark, [(0, s, {"PM10": 5}) for s in STATIONS])).first()
    assert same["network_PM10_std"] == 0 and same["PM10_vs_network_z"] is None and same["network_PM10_median"] == 5


def test_zero_denominators_are_null(spark):
    r = by_hour(features.build_features(panel(spark, [(0, "Dongsi", {"PM10": 0}), (1, "Dongsi", {"CO": 0, "O3": 0})])))[1]
    assert r["NO2_CO_ratio"] is None and r["NO2_O3_ratio"] is None and r["PM10_pct_change_1h"] is None and r["PM10_change_1h"] == 1


def test_local_lag_is_missing_where_the_network_is_not(spark):
    p = panel(spark, [(0, "Wanliu", {"PM10": 8}), (1, "Dongsi", {"PM10": 3}), (1, "Wanliu", {"PM10": 5})])
    r = features.build_features(p).filter("station = 'Dongsi'").first()
    assert r["PM10_lag_1h"] is None and r["network_PM10_mean_lag_1h"] == 8 and r["network_PM10_change_1h"] == -4


def test_unknown_wind_and_unread_upwind_stations(spark):
    p = panel(spark, [(0, "Dongsi", {"wd": None}), (0, "Tiantan", {}), (1, "Tiantan", {}), (2, "Elsewhere", {})])
    rows = {(r["station"], r["observation_timestamp"].hour): r for r in features.build_features(p).collect()}
    still = rows["Dongsi", 0]
    assert still["upwind_count"] == 0 and still["upwind_missing"] == 1 and still["upwind_PM10_mean"] is None and still["wd_sin"] is None
    assert rows["Tiantan", 0]["upwind_count"] > 0 and rows["Tiantan", 0]["upwind_PM10_mean"] == 1
    alone = rows["Tiantan", 1]
    assert alone["upwind_count"] > 0 and alone["upwind_missing"] == 0 and alone["upwind_CO_mean"] is None
    assert rows["Elsewhere", 2]["upwind_count"] == 0


def test_upwind_edges_by_hand(spark):
    got = {(r["station"], r["wd"], r["up_station"]): r["align"] for r in upwind.edges(spark).collect()}
    middle = math.radians(sum(lat for _, lat in STATIONS.values()) / len(STATIONS))
    for s, (lon, lat) in STATIONS.items():
        for o, (lon2, lat2) in STATIONS.items():
            if s != o:
                x, y = (lon2 - lon) * math.cos(middle), lat2 - lat
                for w, d in COMPASS.items():
                    align = (x * math.sin(math.radians(d)) + y * math.cos(math.radians(d))) / math.hypot(x, y)
                    if abs(align - math.cos(math.radians(45))) > 1e-9:
                        assert ((s, w, o) in got) == (align > math.cos(math.radians(45)))
    # Two stations share a latitude, so NE and SE lie on the cone's border, which doesn't count.
    assert ("Guanyuan", "E", "Dongsi") in got and ("Guanyuan", "NE", "Dongsi") not in got


def test_weighted_upwind_mean(spark):
    p = panel(spark, [(0, s, {"PM10": i, "wd": "NE"}) for i, s in enumerate(STATIONS)])
    edges = {}
    for r in upwind.edges(spark).filter("wd = 'NE'").collect():
        edges.setdefault(r["station"], []).append((list(STATIONS).index(r["up_station"]), r["align"]))
    for r in features.build_features(p).collect():
        own = edges.get(r["station"], [])
        assert r["upwind_count"] == len(own)
        if own:
            assert r["upwind_PM10_mean"] == pytest.approx(sum(v for v, _ in own) / len(own))
            assert r["upwind_PM10_weighted"] == pytest.approx(sum(v * w for v, w in own) / sum(w for _, w in own))


def test_truncated_history_leaves_the_past_alone(spark):
    rows = [(h, s, {"PM10": h * h % 17, "CO": h, "wd": "S"}) for h in range(30) for s in ("Dongsi", "Tiantan", "Huairou") if (h + len(s)) % 6]
    whole, cut = (features.build_features(panel(spark, rows[:n])) for n in (len(rows), 50))
    last = rows[49][0] - 1
    old = lambda df: df.filter(F.col("observation_timestamp") <= F.lit(START + dt.timedelta(hours=last)).cast("timestamp_ntz"))
    assert sorted(map(str, old(whole).collect())) == sorted(map(str, old(cut).collect()))


def test_row_order_does_not_matter(spark):
    p = panel(spark, [(h, s, {"PM10": h}) for h in range(8) for s in ("Dongsi", "Tiantan")])
    a, b = features.build_features(p), features.build_features(p.orderBy(F.desc("id")))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_leap_day_and_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 31),), (dt.datetime(2024, 1, 1),)], "observation_timestamp timestamp_ntz").select("observation_timestamp", *[c.alias(n) for n, c in rowwise.calendar().items()])
    a, b = df.orderBy(F.desc("observation_timestamp")).collect()
    assert a["dayofyear"] == 366 and b["dayofweek"] == 0 and a["is_winter"] == 1


def test_families_and_order(spark):
    known = features.families()
    names = [c for own in known.values() for c in own]
    assert len(known) == 19 and len(names) == len(set(names)) == 261
    order = features.column_order(known)
    assert len(order) == 261 and set(order) == set(names) and features.unassigned(order, known) == []
    built = features.build_features(panel(spark, [(0, "Dongsi", {})]), keep=())
    assert built.columns == order
    features.register(known, "RAW", ["PM10", "new"])
    assert known["RAW"].count("PM10") == 1 and known["RAW"][-1] == "new"


def test_structural_checks(spark):
    p = panel(spark, [(0, "Dongsi", {}), (0, "Dongsi", {})])
    assert checks.duplicate_rows(p, ["station", "observation_timestamp"]).first()[0] == 1
    with pytest.raises(ValueError):
        checks.require_unique(p)
    with pytest.raises(ValueError):
        checks.join_one_to_one(p, p, ["station", "observation_timestamp"])
    with pytest.raises(ValueError):
        checks.require_disjoint(p, p)
    with pytest.raises(ValueError):
        checks.require_same_columns(p, p.drop("CO"))
    with pytest.raises(ValueError):
        checks.require_same_columns(p.select("id", "CO"), p.select("CO", "id"))
    with pytest.raises(ValueError):
        checks.require_no_nulls(p.withColumn("x", F.lit(None)), "x")
    with pytest.raises(ValueError):
        checks.require_some_values(p.withColumn("x", F.lit(None).cast("double")), ["x", "CO"])
    with pytest.raises(ValueError):
        checks.reject_names(["current_PM2_5_lag_1h"])
    with pytest.raises(ValueError):
        checks.require_same_count(p, p.limit(1))
    for names, train in (([TARGET, "current_PM2_5"], True), (["id"], True), ([TARGET], False)):
        with pytest.raises(ValueError):
            guard_columns(names, train)
    assert checks.numeric_columns(p) == ["id", *NUMBERS]


def test_leak_is_found(spark):
    p = panel(spark, [(h, "Dongsi", {"PM10": h * 3 % 11, "CO": h}) for h in range(20)])
    leaky = p.withColumn(TARGET, F.lead("PM10").over(temporal.Window.partitionBy("station").orderBy("observation_timestamp")))
    audit = {r["column"]: r for r in checks.leak_audit(leaky, NUMBERS, TARGET).collect()}
    assert audit["PM10"]["exact_match_rate"] == 1 and audit["PM10"]["n"] == 19 and audit["SO2"]["corr"] is None
    with pytest.raises(ValueError):
        checks.require_no_leak(checks.leak_audit(leaky, NUMBERS, TARGET))
    assert checks.leak_audit(p.limit(1).withColumn(TARGET, F.lit(1.0)), ["CO"], TARGET).count() == 0


def test_embargo(spark):
    p = panel(spark, [(h, "Dongsi", {}) for h in range(6)])
    train, validate = splits.holdout(p, "2016-01-01 04:00:00", "2016-01-01 05:00:00")
    assert [r["id"] for r in train.orderBy("id").collect()] == [0, 1, 2] and [r["id"] for r in validate.collect()] == [4]


def test_small_functions(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (None, 2.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(clip_low("a")).collect()] == [0.0, None, 4.0]
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, None, 2.0]
    assert spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double").agg(correlation("a", "b")).first()[0] is None


def test_time_since_observed(spark):
    p = panel(spark, [(0, "Dongsi", {"CO": None}), (1, "Dongsi", {}), (4, "Dongsi", {"CO": None})])
    got = by_hour(temporal.hours_since_observed(p, ["station"], ["CO"]))
    assert [got[h]["CO_hours_since"] for h in (0, 1, 4)] == [None, 0, 3]


@pytest.mark.parametrize("bucket", [1, 3, 7, 100_000])
def test_gaps_and_readings_over_buckets(spark, bucket):
    hours = [h for h in range(40) if h % 6 not in (2, 3)]
    p = panel(spark, [(h, s, {"CO": h if h % 5 == 0 and h > 3 else None}) for h in hours for s in ("Dongsi", "Wanliu")])
    for s in ("Dongsi", "Wanliu"):
        gaps = by_hour(temporal.gap_hours(p, ["station"], bucket_hours=bucket).filter(F.col("station") == s))
        since = by_hour(temporal.hours_since_observed(p, ["station"], ["CO"], bucket_hours=bucket).filter(F.col("station") == s))
        for before, h in zip([None, *hours], hours):
            assert gaps[h]["gap_hours"] == (None if before is None else h - before)
            seen = [x for x in hours if x <= h and x % 5 == 0 and x > 3]
            assert since[h]["CO_hours_since"] == (h - seen[-1] if seen else None)


def test_ablation_wants_both_holdouts(spark):
    rows = [(START + dt.timedelta(days=d), 2.0, 1.0, a, b, -1.0) for d, a, b in ((0, 2.0, 2.0), (1, 1.5, -9.0))]
    df = spark.createDataFrame(rows, f"observation_timestamp timestamp_ntz, {TARGET} double, base double, both double, one double, neither double")
    parts = {"A": ("2016-01-01", "2016-01-02"), "B": ("2016-01-02", "2016-01-03")}
    got = {r["candidate"]: r for r in splits.ablation(df, "base", ["both", "one", "neither"], TARGET, parts).collect()}
    assert [got[c]["accepted"] for c in ("both", "one", "neither")] == [True, False, False]
    assert got["both"]["rmse_A"] == 0 and got["one"]["rmse_B"] == 2 and got["neither"]["base_rmse_A"] == 1  # clipped at 0
    assert not any(r["accepted"] for r in splits.ablation(df, "base", ["both"], TARGET, parts | {"C": ("2020-01-01", "2020-02-01")}).collect())


def test_releases(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "place long, k string, v double")
    checks.require_same_release(a, a.orderBy(F.desc("place")), "place")
    swapped = spark.createDataFrame([(2, "x", 1.0), (1, "y", 2.0)], a.schema)
    checks.require_same_release(a.drop("place"), swapped.drop("place"))
    for other in (swapped, a.select("k", "place", "v"), a.withColumn("v", F.col("v").cast("float")), a.limit(1), a.union(a)):
        with pytest.raises(ValueError):
            checks.require_same_release(a, other, "place")


def test_narrow_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 127, -129, 40_000, 1 << 40, None, 1.5, "s"), (2, -128, 0, 0, 0, None, 2.5, "t")], "i int, a long, b long, c long, d long, e long, f double, g string")
    write_parquet(df, str(tmp_path / "x"), narrow=True)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert [t for _, t in back.dtypes] == ["tinyint", "tinyint", "smallint", "int", "bigint", "bigint", "float", "string"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_fingerprints_of_all_files(spark, tmp_path):
    import hashlib

    for i in range(3):
        spark.range(i + 1).coalesce(1).write.parquet(str(tmp_path / f"t{i}.parquet"))
    want = sorted((x.name, x.stat().st_size, hashlib.sha256(x.read_bytes()).hexdigest()) for x in tmp_path.glob("*.parquet/part-*"))
    assert len(want) == 3 and sorted(map(tuple, fingerprints(spark, f"{tmp_path}/*.parquet").collect())) == want


def test_prepare_finds_broken_releases(spark):
    own = [*NUMBERS, "wd", "id", "observation_timestamp", "station"]
    p = panel(spark, [(h, "Dongsi", {"PM10": h * 3 % 11}) for h in range(9)]).select(own)
    train = p.filter("id < 6").withColumn(TARGET, F.col("id") * 1.0)
    test = p.filter("id >= 6")
    assert features.prepare(train, test).features.columns
    with pytest.raises(ValueError):  # an id of the training panel
        features.prepare(train, test.withColumn("id", F.lit(3).cast("long")).limit(1))
    parts = {n: c for n, c in rowwise.calendar().items() if n in ("year", "month", "day", "hour")}
    wrong = lambda df: df.withColumns(parts).withColumn("hour", F.col("hour") + 1)
    with pytest.raises(ValueError):
        features.prepare(wrong(train), wrong(test))


def test_csv_to_files(spark, tmp_path):
    """The whole run: CSV in, five files out, columns of both splits alike, test rows looking back into training rows."""
    head = ["id", "observation_timestamp", "station", "year", "month", "day", "hour", *POLLUTANTS, "TEMP", "PRES", "DEWP", "RAIN", "wd", "WSPM"]

    def write(path, hours, train, first):
        lines = [",".join(head + [TARGET] * train)]
        for i, (h, s) in enumerate((h, s) for h in hours for s in ("Dongsi", "Tiantan")):
            t = START + dt.timedelta(hours=h)
            k = int(s == "Tiantan")
            values = [first + i, t, s, t.year, t.month, t.day, t.hour, h + k, 2 + k, "NaN" if h == 2 else 3 + k, "NA" if h == 1 else 4 + k, "", 1 + k, 1000, -3, 0, "N", 1.5 + k]
            lines.append(",".join(map(str, values + [h % 5 + 0.5] * train)))
        path.write_text("\n".join(lines) + "\n")

    write(tmp_path / "train.csv", range(60), True, 0)
    write(tmp_path / "test.csv", range(60, 64), False, 1000)
    with pytest.raises(ValueError):  # O3 has no value at all
        features.run(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "out"))
    text = (tmp_path / "train.csv").read_text().replace(",,1,1000", ",7,1,1000").replace(",,2,1000", ",8,2,1000")
    (tmp_path / "train.csv").write_text(text)
    read = read_panel_csv(spark, str(tmp_path / "train.csv"), True)
    assert read.filter("NO2 IS NULL").count() == 2 and read.filter("CO IS NULL").count() == 2 and read.filter("isnan(NO2)").count() == 0
    assert checks.calendar_disagreements(read).first()[0] == 0
    made = features.run(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "out"))
    train, test = (spark.read.parquet(str(tmp_path / "out" / f"features_{x}.parquet")) for x in ("train", "test"))
    assert train.columns == test.columns and len(train.columns) == 262 and train.count() == 120 and test.count() == 8
    kinds = dict(train.dtypes)
    assert kinds == dict(test.dtypes) and kinds["PM10"] == "float" and kinds["id"] == "smallint" and kinds["year"] == "smallint" and kinds["CO_missing"] == "tinyint"
    assert not (tmp_path / "out" / "_features.parquet").exists()
    first = test.filter("station = 'Dongsi'").orderBy("id").first()
    assert first["PM10_lag_1h"] == 59 and first["PM10_lag_48h"] == 12
    labels = spark.read.parquet(str(tmp_path / "out" / "y.parquet"))
    assert labels.columns == ["id", TARGET] and labels.count() == 120
    groups = read_registry(spark, str(tmp_path / "out" / "feature_groups.json"))
    assert groups == json.loads(json.dumps(made.families)) and "UNASSIGNED" not in groups
    assert features.select_families(train, groups, ["RAW", "CALENDAR"]).columns == groups["RAW"] + groups["CALENDAR"]
    assert fingerprints(spark, str(tmp_path / "train.csv")).first()["n_bytes"] == (tmp_path / "train.csv").stat().st_size


def test_statistics_come_from_training_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (None, 0), (100.0, 0)], "x double, _is_train int")
    assert [r["x"] for r in splits.fill_from_training(df, ["x"]).collect()] == [1.0, 3.0, 2.0, 100.0]
    got = [r["x"] for r in splits.scale_from_training(df, ["x"]).collect()]
    assert got == [pytest.approx(-1 / math.sqrt(2)), pytest.approx(1 / math.sqrt(2)), None, pytest.approx(98 / math.sqrt(2))]


def test_hour_table_and_pivot(spark):
    p = panel(spark, [(0, "Dongsi", {"PM10": 1}), (0, "Wanliu", {"PM10": 4}), (1, "Dongsi", {"PM10": 2})])
    row = network.hour_table(p).orderBy("observation_timestamp").first()
    assert row["network_PM10_range"] == 3 and row["network_PM10_median"] == 2.5
    wide = network.pivot_stations(p, "PM10", ["Dongsi", "Wanliu"]).orderBy("observation_timestamp").collect()
    assert wide[0]["Wanliu"] == 4 and wide[1]["Wanliu"] is None


def test_every_family_has_its_note(spark):
    from hourloom.plans import notes

    assert {n.family for n in notes.NOTES} == set(features.families()) and len(notes.NOTES) == 19
    assert notes.as_table(spark).count() == 19
