"""Input and output contracts, plans by family, models from moments, causality and releases: negative cases and brute force."""

import datetime as dt
import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourloom.operators import causality, checks, fitted, invariance, ridge, temporal
from hourloom.plans import features, notes
from hourloom.schema import POLLUTANTS, STATIONS, TARGET, WEATHER, input_schema
from hourloom.sources import content_digest, fault_counts, fingerprints, narrow_types, parse_panel_csv, range_metrics, read_json, read_panel_csv, with_place, write_parquet

START = dt.datetime(2016, 1, 1)
NUMBERS = [*POLLUTANTS, *WEATHER]
TS = "observation_timestamp"


def panel(spark, hours, stations=("Dongsi", "Tiantan"), seed=1):
    r = random.Random(seed)
    rows = []
    for i, (h, s) in enumerate((h, s) for h in hours for s in stations):
        rows.append((i, START + dt.timedelta(hours=h), s, r.choice(["N", "SE", None]), *[None if r.random() < 0.1 else round(r.uniform(1, 50), 3) for _ in NUMBERS]))
    return spark.createDataFrame(rows, f"id long, {TS} timestamp_ntz, station string, wd string, " + ", ".join(f"{c} double" for c in NUMBERS))


def records(hours, train, first=0, stations=("Dongsi", "Tiantan"), **cells):
    """Lines of CSV; cells: values by column for the record of index 3."""
    names = input_schema(train).names
    out = [",".join(names)]
    for i, (h, s) in enumerate((h, s) for h in hours for s in stations):
        t = START + dt.timedelta(hours=h)
        row = dict.fromkeys(names, 1.5 + h % 5) | {"id": first + i, TS: t, "station": s, "year": t.year, "month": t.month, "day": t.day, "hour": t.hour, "wd": "N", "PM10": h + i, TARGET: h % 7 + 0.5}
        row |= cells if i == 3 else {}
        out.append(",".join(str(row[n]) for n in names))
    return out


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


FAULTS = [
    ({"PM10": "abc"}, None, "PM10: malformed"), ({"CO": "1e999"}, None, "CO: malformed"), ({"O3": "1d"}, None, "O3: malformed"), ({"hour": "3.5"}, None, "hour: malformed"), ({"year": "99999999999"}, None, "year: malformed"),
    ({TS: "not a time"}, None, f"{TS}: malformed"), ({TS: "2016-02-30 00:00:00"}, None, f"{TS}: malformed"), ({TS: ""}, None, f"{TS}: missing key"), ({"id": "NA"}, None, "id: missing key"), ({"station": ""}, None, "station: missing key"),
    ({}, lambda x: x + ",9", "record: wrong length"), ({}, lambda x: x.rsplit(",", 1)[0], "record: wrong length"),
]
BROKEN = [({TARGET: "NA"}, "training rows have a target"), ({"hour": 23}, "calendar fields are the timestamp's"), ({TS: "2016-01-01 01:30:00"}, "timestamps are whole hours")]


def test_faults_of_csv_are_loud(spark, tmp_path):
    for i, (cells, edit, message) in enumerate(FAULTS):
        lines = records(range(6), True, **cells)
        lines[4] = edit(lines[4]) if edit else lines[4]
        with pytest.raises(ValueError, match=f"{message} in 1 records"):
            read_panel_csv(spark, write(tmp_path / f"{i}.csv", lines), True)


def test_a_run_names_all_faults_and_leaves_nothing(spark, tmp_path):
    test = write(tmp_path / "test.csv", records(range(6, 8), False, first=1000))
    for cells, message in [*BROKEN, ({"PM10": "abc", "id": "NA"}, "id: missing key .1 rows.*PM10: malformed .1 rows")]:
        train = write(tmp_path / "train.csv", records(range(6), True, **cells))
        with pytest.raises(ValueError, match=message) as found:
            features.run(spark, train, test, str(tmp_path / "out"))
        assert "train.csv" in str(found.value) and not list((tmp_path / "out").glob("*"))


def test_every_fault_is_counted_and_missing_values_are_none(spark, tmp_path):
    lines = records(range(6), True, PM10="abc", CO="NaN", SO2="", O3="n/a", year="2016.0", wd="NA")
    lines[7] = lines[7].replace("Dongsi", "Dongsi", 1).replace("2016-01-01 03:00:00", "2016-01-01T03:00:00")
    lines[2] += ",1"
    parsed = parse_panel_csv(spark, write(tmp_path / "x.csv", lines), True)
    assert {tuple(r) for r in fault_counts(parsed).collect()} == {("PM10", "malformed", 1), (None, "wrong length", 1)}
    row = parsed.filter("id = 3").first()
    assert row["CO"] is row["SO2"] is row["O3"] is row["wd"] is None and row["year"] == 2016
    assert parsed.filter("id = 6").first()[TS] == dt.datetime(2016, 1, 1, 3)
    assert parsed.select("PM10").filter("PM10 IS NULL").count() == 1  # whatever columns are asked for
    assert parsed.select("faults").filter("size(faults) > 0").count() == 2
    with pytest.raises(ValueError, match="where"):
        parse_panel_csv(spark, write(tmp_path / "y.csv", [x.split(",", 1)[1] for x in lines]), True)


def test_rows_that_break_a_rule_stop_the_job(spark):
    p = panel(spark, range(3))
    rules = checks.row_rules(p.columns)
    assert checks.refusing(p, rules).count() == 6
    assert {r["rule"]: r["n_broken"] for r in checks.row_violations(p.withColumn("station", F.when(F.col("id") > 3, F.col("station"))), rules).collect()}["station is known"] == 4
    with pytest.raises(Exception, match="station is known"):
        checks.refusing(p.withColumn("station", F.when(F.col("id") > 3, F.col("station"))), rules).count()


def test_both_splits_have_the_types_of_both(spark, tmp_path):
    far = 3_000_000_000
    train, test = write(tmp_path / "train.csv", records(range(6), True)), write(tmp_path / "test.csv", records(range(6, 8), False, first=far))
    features.run(spark, train, test, str(tmp_path / "out"), only=["RAW", "CALENDAR", "LOCAL_LAGS_SHORT"][:2])
    parts = [str(tmp_path / "out" / f"features_{x}.parquet") for x in ("train", "test")]
    a, b = map(spark.read.parquet, parts)
    assert a.dtypes == b.dtypes and dict(a.dtypes)["id"] == "bigint" and dict(a.dtypes)["hour"] == "tinyint"
    both = spark.read.parquet(*parts)
    assert both.count() == 16 and both.agg(F.max("id")).first()[0] == far + 3
    types = read_json(spark, str(tmp_path / "out" / "feature_types.json"))
    assert {c: t["type"] for c, t in types.items()} == dict(a.dtypes) and (types["id"]["least"], types["id"]["most"]) == (0, far + 3) and types["PM10"] == {"type": "float", "least": None, "most": None}
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["feature_groups.json", "feature_types.json", "features_test.parquet", "features_train.parquet", "test_ids.parquet", "y.parquet"]
    x, y = spark.range(3), spark.range(2).selectExpr("id + 3000000000 AS id")
    with pytest.raises(ValueError, match="types differ"):
        checks.require_same_columns(x, y.selectExpr("int(1) AS id"))
    every = x.union(y)
    types = narrow_types(every, every.agg(*range_metrics(["id"])).first().asDict())
    for name, df in (("x", x), ("y", y)):
        write_parquet(df, str(tmp_path / name), types=types)
    assert spark.read.parquet(str(tmp_path / "x"), str(tmp_path / "y")).count() == 5


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line or "Exchange range" in line]


def test_only_what_is_asked_for_is_planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = panel(spark, range(4))
        made = lambda *only: exchanges(features.build_features(p, only=list(only)))
        assert len(made("RAW", "CALENDAR", "WIND_ENCODING", "PHYSICAL", "MISSINGNESS", "QUALITY_FLAGS", "STATION")) == 0
        assert len(made("RAW", "LOCAL_LAGS_SHORT", "LOCAL_LAGS_LONG")) == len(made("LOCAL_ROLLING", "LOCAL_RATES")) == 1
        assert len(made("NETWORK_STATE")) == len(made("UPWIND")) - 1 == 2  # rows and readings by hour; upwind lags by station
        whole = exchanges(features.build_features(p))
        assert len(whole) <= 5, whole
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_families_alone_are_those_of_the_whole_table(spark):
    p = panel(spark, [h for h in range(60) if h % 7 != 3], ("Dongsi", "Tiantan", "Huairou"))
    whole, known = features.build_features(p), features.families()
    both = {r["id"]: r.asDict() for r in whole.collect()}
    for only in (["RAW", "LOCAL_RATES"], ["LOCAL_VS_NETWORK"], ["UPWIND", "STATION"], ["INTERACTIONS"], features.without_same_hour(known)):
        got = features.build_features(p, only=only)
        assert set(got.columns) == {"id", TS, *(c for f in only for c in known[f])}
        assert all(r[c] == pytest.approx(both[r["id"]][c]) if isinstance(r[c], float) else r[c] == both[r["id"]][c] for r in got.collect() for c in got.columns)
    with pytest.raises(ValueError, match="no such family"):
        features.build_features(p, only=["RAW", "LAGS"])
    less = p.drop("wd", "RAIN", "O3")
    assert features.build_features(less, only=["LOCAL_ROLLING", "UPWIND"][:1]).count() == features.build_features(p.drop("O3"), only=["UPWIND"]).count() == p.count()
    with pytest.raises(ValueError, match="lacks wd, which WIND_ENCODING"):
        features.build_features(less, only=["WIND_ENCODING"])
    with pytest.raises(ValueError, match="lacks O3, RAIN, wd"):
        features.build_features(less)
    assert features.closure(["LOCAL_VS_NETWORK"]) >= {"LOCAL_RATES", "LOCAL_ROLLING", "NETWORK_HISTORY"}


# models -----------------------------------------------------------------------------------------------------------------------


def brute_ridge(x, y, train, valid, own, alpha):
    """Coefficients and error of standard scores, missing values at the training mean."""
    part = x[:, own]
    mean, deviation = np.nanmean(part[train], 0), np.nanstd(part[train], 0, ddof=1)
    z = np.where(np.isnan(part), 0, (part - mean) / deviation)
    c, b = z[train].mean(0), y[train].mean()
    w = np.linalg.solve((z[train] - c).T @ (z[train] - c) + alpha * np.eye(len(own)), (z[train] - c).T @ (y[train] - b))
    return w, math.sqrt(np.mean((y[valid] - b - (z[valid] - c) @ w) ** 2))


def test_ridge_equals_brute_force(spark):
    r = np.random.default_rng(3)
    n, names = 400, ["a", "b", "c", "d", "same"]
    x = r.normal(0, 1, (n, 5)) * [1, 1000, 0.01, 3, 0] + [5, 101_000, 0, -7, 2]
    x[r.random((n, 5)) < 0.15] = np.nan
    x[:, 4] = 2.0
    y = np.nan_to_num(x[:, 0]) * 2 + np.nan_to_num(x[:, 1] - 101_000) / 300 + r.normal(0, 1, n)
    hours = np.arange(n)
    rows = [(START + dt.timedelta(hours=int(h)), *[None if np.isnan(v) else float(v) for v in x[h]], float(y[h])) for h in hours]
    rows.append((START, 1.0, 1.0, 1.0, 1.0, 2.0, None))
    df = spark.createDataFrame(rows, f"{TS} timestamp_ntz, " + ", ".join(f"{c} double" for c in names) + f", {TARGET} double").repartition(7)
    parts = {"A": ("2016-01-09 08:00:00", "2016-01-11"), "B": ("2016-01-13", "2016-01-16")}
    variants = {"base": ["c"], "two": ["a", "b"], "all": ["a", "b", "c", "d"], "none": [], "with constant": ["a", "same"]}
    got = {r["variant"]: r for r in ridge.ablation(df, variants, "base", 2.0, TARGET, parts).collect()}
    sets = {}
    for h, (a, b) in parts.items():
        a, b = ((dt.datetime.fromisoformat(v) - START).total_seconds() / 3600 for v in (a, b))
        sets[h] = hours + 1 < a, (hours >= a) & (hours < b)
        for v, own in variants.items():
            at = [names.index(c) for c in own if c != "same"]
            want = brute_ridge(x, y, *sets[h], at, 2.0)[1] if at else math.sqrt(np.mean((y[sets[h][1]] - y[sets[h][0]].mean()) ** 2))
            assert got[v][f"rmse_{h}"] == pytest.approx(want, rel=1e-9), (h, v)
    assert got["two"]["accepted"] and got["all"]["accepted"] and not got["base"]["accepted"] and got["two"]["n_columns"] == 2
    conditions = {f"{side} {h}": F.expr(f"{TS} >= timestamp_ntz'2016-01-01'") & (ridge.known_before(p[0]) if side == "train" else ridge.inside(*p)) for h, p in parts.items() for side in ("train", "validate")}
    found = ridge.moments(df, names[:4], TARGET, conditions)
    for h in parts:
        scale = ridge.Scale.of(found.of(f"train {h}"))
        model = ridge.fit(scale.applied(found.of(f"train {h}")), names[:4], ["a", "b", "d"], 2.0)
        assert model.weights == pytest.approx(brute_ridge(x, y, *sets[h], [0, 1, 3], 2.0)[0], rel=1e-8)
    empty = ridge.ablation(df, {"base": ["a"], "b": ["b"]}, "base", 1.0, TARGET, {"X": ("2030-01-01", "2030-02-01"), "Y": ("2000-01-01", "2000-02-01")}).collect()
    assert all(r["rmse_X"] is None and r["rmse_Y"] is None and not r["accepted"] for r in empty)


def test_variants_of_families():
    known = {"RAW": ["a", "b"], "STATION": ["station"], "X": ["x"], "Y": ["y"]}
    assert ridge.family_variants(known, ["RAW"]) == {"base": ["a", "b"], "base + X": ["a", "b", "x"], "base + Y": ["a", "b", "y"], "all": ["a", "b", "x", "y"], "all - X": ["a", "b", "y"], "all - Y": ["a", "b", "x"]}


# causality --------------------------------------------------------------------------------------------------------------------


def test_what_features_read(spark):
    p = panel(spark, range(3))
    found = causality.reads(features.build_features(p))
    of = lambda c: {(r.column, r.first / 3600, r.last / 3600, r.others) for r in found[c] if r.column not in ("station", TS)}
    assert of("PM10") == {("PM10", 0, 0, False)} and of("CO_lag_3h") == {("CO", -3, -3, False)} and of("PM10_roll_mean_6h") == {("PM10", -6, -1 / 3600, False)}
    assert of("network_CO_mean") == {("CO", 0, 0, True)} and of("network_CO_mean_lag_24h") == {("CO", -24, -24, True)}
    assert of("upwind_PM10_mean_lag_3h") == {("PM10", -3, -3, True), ("wd", -3, -3, False)} | {x for x in of("upwind_PM10_mean_lag_3h") if x[0] == "CO"}
    assert of("local_vs_network_PM10_change") == {("PM10", 0, 0, False), ("PM10", -1, -1, False), ("PM10", 0, 0, True), ("PM10", -1, -1, True)}
    causality.require_causal(features.build_features(p))
    with pytest.raises(ValueError, match="same hour.*network_PM10_mean"):
        causality.require_causal(features.build_features(p), others=False)
    causality.require_causal(features.build_features(p, only=features.without_same_hour(features.families())), others=False)


def test_acausal_columns_are_refused(spark):
    p = panel(spark, range(5)).withColumn("_is_train", (F.col("id") < 6).cast("int"))
    by = Window.partitionBy("station").orderBy(F.unix_timestamp(TS))
    bad = {
        "lead": F.lead("PM10").over(by), "centred": F.avg("PM10").over(by.rangeBetween(-3600, 3600)), "open": F.avg("PM10").over(Window.partitionBy("station")), "rows": F.max("PM10").over(by.rowsBetween(-2, 1)),
        "next": F.max("PM10").over(by.rangeBetween(3600, 3600)), "filled": F.first("PM10", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)),
    }
    for name, c in bad.items():
        with pytest.raises(ValueError, match=f"{name} "):
            causality.require_causal(p.select("id", TS, c.alias(name)))
    causality.require_causal(p.select(F.lag("PM10").over(by).alias("lag"), F.avg("PM10").over(by.rangeBetween(-7200, 0)).alias("past"), F.avg("PM10").over(Window.partitionBy(TS)).alias("hour")))
    for rows, fine in ((p, False), (p.filter("_is_train = 1"), True)):
        mean = p.crossJoin(rows.agg(F.avg("CO").alias("mean_")))
        filled = mean.select("id", F.coalesce("CO", "mean_").alias("CO"))
        if fine:
            causality.require_causal(filled)
        else:
            with pytest.raises(ValueError, match="CO .any time"):
                causality.require_causal(filled)
    later = p.select("station", (F.col(TS) - F.expr("INTERVAL 2 HOURS")).cast("timestamp_ntz").alias(TS), F.col("O3").alias("ahead"))
    with pytest.raises(ValueError, match="ahead .up to 2 hours"):
        causality.require_causal(p.join(later, ["station", TS], "left").select("id", "ahead"))
    causality.require_causal(temporal.lags_by_join(p, ["station"], ["CO"], 3))


def test_notes_are_held_against_the_plan(spark):
    made, known = features.build_features(panel(spark, range(3))), features.families()
    notes.require_true(made, known)
    wrong = {"PHYSICAL": {"reads": ("TEMP",)}, "LOCAL_ROLLING": {"others": True}, "UPWIND": {"reads": ("wd", "WSPM", "PM10", "CO", "O3")}}
    for family, change in wrong.items():
        with pytest.raises(ValueError, match=family):
            notes.require_true(made, known, [replace(n, **change) if n.family == family else n for n in notes.NOTES])


def test_later_rows_that_change_the_past_are_found(spark):
    p = panel(spark, range(40), ("Dongsi", "Tiantan", "Huairou"))
    cuts = ["2016-01-01 20:00:00", "2016-01-02 03:00:00"]
    fine = lambda rows: features.build_features(rows, only=["LOCAL_LAGS_SHORT", "NETWORK_STATE", "UPWIND"])
    invariance.require_invariant(fine, p, cuts)
    by = Window.partitionBy("station").orderBy(F.unix_timestamp(TS))
    leaky = lambda rows: rows.select("id", TS, "PM10", F.avg("CO").over(by.rangeBetween(-7200, 7200)).alias("centred"), F.max("SO2").over(by.rangeBetween(3600, 3600)).alias("next"))
    got = {(r["cut"].isoformat(" "), r["column"]): (r["first_hour"].isoformat(" "), r["n_hours"]) for r in invariance.truncation_differences(leaky, p, cuts).collect()}
    assert got == {(cuts[0], "centred"): ("2016-01-01 19:00:00", 2), (cuts[0], "next"): (cuts[0], 1), (cuts[1], "centred"): ("2016-01-02 02:00:00", 2), (cuts[1], "next"): (cuts[1], 1)}
    with pytest.raises(ValueError, match="centred .from 2016-01-01 19.*next"):
        invariance.require_invariant(leaky, p, cuts)


# releases and fitted tables -----------------------------------------------------------------------------------------------------


def test_order_of_rows_in_files(spark, tmp_path):
    lines = [f"{i},v{i % 10}" for i in range(5000)]
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_text("\n".join(["a,b", *lines]) + "\n")
    lines[40], lines[4000] = lines[4000], lines[40]
    new.write_text("\n".join(["a,b", *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        a, b = (with_place(spark.read.option("header", True).schema("a long, b string").csv(str(x))) for x in (old, new))
        assert a.rdd.getNumPartitions() > 3
        assert [r[0] for r in a.orderBy("place").select("place").collect()] == list(range(5000)) and a.filter("place <> a").count() == 0
        assert {r["place"] for r in checks.order_differences(a, b).collect()} == {40, 4000}
        checks.require_same_order(a, a)
        with pytest.raises(ValueError, match="2 places differ, the first is 40"):
            checks.require_same_order(a, b)
        checks.require_same_release(a.drop("place"), b.drop("place"))  # the same rows
        assert content_digest(a.drop("place")).collect() == content_digest(b.drop("place").repartition(3)).collect() != content_digest(a.limit(4999).drop("place")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    folder = tmp_path / "parts"
    spark.range(1000).repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(str(folder))
    assert with_place(spark.read.parquet(str(folder))).filter("place <> id").count() == 0


def test_fingerprints_in_chunks(spark, tmp_path):
    data = bytes(range(256)) * 5000
    for name in ("a file.bin", "ü.bin"):
        (tmp_path / name).write_bytes(data + name.encode())
    got = {tuple(r) for r in fingerprints(spark, str(tmp_path), chunk=1000).collect()}
    assert got == {(x.name, x.stat().st_size, hashlib.sha256(x.read_bytes()).hexdigest()) for x in tmp_path.iterdir()}


def test_fitted_means_fall_back_and_say_so(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2016, 1, day, hour)
    schema = f"id long, {TS} timestamp_ntz, station string, CO double"
    train = spark.createDataFrame([(1, at(1, 0), "a", 1.0), (2, at(2, 0), "a", 3.0), (3, at(1, 1), "a", 8.0), (4, at(1, 2), "a", None), (5, at(3, 0), "b", 10.0)], schema)
    fitted.fit_means(train, ["CO"]).write.parquet(str(tmp_path / "means"))
    table = spark.read.parquet(str(tmp_path / "means"))
    test = spark.createDataFrame([(1, at(9, 0), "a", None), (2, at(9, 1), "a", None), (3, at(9, 2), "a", None), (4, at(9, 0), "c", None), (5, at(9, 0), "c", 7.0)], schema)
    got = {r["id"]: (r["CO"], r["CO_from"]) for r in fitted.fill_means(test, table, ["CO"]).collect()}
    assert got == {1: (2.0, "station and hour"), 2: (8.0, "station and hour"), 3: (4.0, "station"), 4: (5.5, "all"), 5: (7.0, "read")}
    assert {r["id"]: r["CO_from"] for r in fitted.fill_means(test, table, ["CO"], least=2).collect()} == {1: "station and hour", 2: "station", 3: "station", 4: "all", 5: "read"}
    fitted.require_not_fitted_in(table, "2016-01-04", "2016-02-01")
    with pytest.raises(ValueError, match="reach into"):
        fitted.require_not_fitted_in(table, "2016-01-03", "2016-02-01")
    nothing = fitted.fit_means(train.limit(0), ["CO"])
    assert nothing.count() == 0 and [r["CO_from"] for r in fitted.fill_means(test, nothing, ["CO"]).orderBy("id").collect()] == [None] * 4 + ["read"]


def test_stations_without_places_are_left_alone(spark):
    p = panel(spark, range(4), ("Dongsi", "Elsewhere"))
    rows = features.build_features(p, only=["UPWIND"]).collect()
    assert len(rows) == 8 and "Elsewhere" not in STATIONS
