"""The feature table: every family of features of a panel, in one plan, and the registry of which column is whose."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators import causality, checks, network, rowwise, splits, temporal, upwind
from hourloom.plans import notes
from hourloom.schema import NETWORK, POLLUTANTS, PRIMARY, TARGET, WEATHER, input_schema
from hourloom.sources import cast_to, delete, fault_metrics, narrow_types, parse_panel_csv, range_metrics, whole_columns, write_json, write_parquet, write_registry

LONGEST = 48
TS = "observation_timestamp"


def names(columns) -> list[str]:
    """Names that a stage makes; the expressions are only built."""
    return list(columns)


def families() -> dict[str, list[str]]:
    """Family to columns, in order of creation. A session must be active, as names come from the expressions."""

    class Named(temporal.History):
        def __init__(self):
            super().__init__([])

    h = Named()
    out: dict[str, list[str]] = {
        "CALENDAR": names(rowwise.calendar()), "WIND_ENCODING": names(rowwise.wind()), "MISSINGNESS": names(rowwise.missingness()),
        "QUALITY_FLAGS": names(rowwise.quality_flags()), "PHYSICAL": names(rowwise.physical()),
    }
    for family, columns, lags in temporal.LAGS:
        register(out, family, [f"{c}_lag_{n}h" for c in columns for n in lags])
    out["LOCAL_ROLLING"] = names(temporal.rolling_columns(h))
    out["LOCAL_RATES"] = names(temporal.rates())
    out["NETWORK_STATE"] = [f"network_{c}_{s}" for c in NETWORK for s in network.STATISTICS] + [f"network_{c}_range" for c in PRIMARY]
    out["SPATIAL_GRADIENTS"] = names(network.gradients())
    out["NETWORK_HISTORY"] = names(network.history_columns(h))
    out["NETWORK_RATES"] = names(network.network_rates())
    out["LOCAL_VS_NETWORK"] = names(network.local_vs_network())
    made = names(upwind.state())
    for c in PRIMARY:
        made += [f"upwind_{c}_mean_lag_1h", f"upwind_{c}_mean_lag_3h", f"WSPM_x_upwind_{c}_contrast", f"upwind_{c}_change_1h"]
    out["UPWIND"] = made
    out["INTERACTIONS"] = names(rowwise.interactions())
    out["RAW"] = [*POLLUTANTS, *WEATHER]
    out["STATION"] = ["station"]
    return out


def register(families: dict[str, list[str]], family: str, columns: list[str]) -> None:
    """Adds columns that the family doesn't have yet."""
    own = families.setdefault(family, [])
    own += [c for c in columns if c not in own]


def unassigned(columns: list[str], families: dict[str, list[str]]) -> list[str]:
    known = {c for own in families.values() for c in own}
    return [c for c in columns if c not in known]


def select_families(df: DataFrame, families: dict[str, list[str]], chosen: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns of the chosen families; Parquet reads only these."""
    return df.select(*(keep or []), *[c for f in chosen for c in families[f]])


def column_order(families: dict[str, list[str]]) -> list[str]:
    """Input order first, then order of creation, in which each network column's gradients follow its statistics."""
    first = ["station", "year", "month", "day", "hour", *POLLUTANTS, "TEMP", "PRES", "DEWP", "RAIN", "WSPM"]
    made = [c for f in ("CALENDAR", "WIND_ENCODING", "MISSINGNESS", "QUALITY_FLAGS", "PHYSICAL") for c in families[f]]
    made += [f"{c}_lag_{n}h" for _, columns, lags in temporal.LAGS for c in columns for n in lags]
    made += families["LOCAL_ROLLING"] + families["LOCAL_RATES"]
    for c in NETWORK:
        made += [f"network_{c}_{s}" for s in network.STATISTICS] + [f"{c}_vs_network_mean", f"{c}_vs_network_z"]
    made += [f"network_{c}_range" for c in PRIMARY]
    made += [c for f in ("NETWORK_HISTORY", "NETWORK_RATES", "LOCAL_VS_NETWORK", "UPWIND", "INTERACTIONS") for c in families[f]]
    return first + [c for c in made if c not in first]


#: Families whose columns a family is made from; the row's own readings need no entry.
NEEDS: dict[str, tuple[str, ...]] = {
    "LOCAL_RATES": ("LOCAL_LAGS_SHORT", "LOCAL_ROLLING"),
    "SPATIAL_GRADIENTS": ("NETWORK_STATE",),
    "NETWORK_HISTORY": ("NETWORK_STATE",),
    "NETWORK_RATES": ("NETWORK_STATE", "NETWORK_HISTORY"),
    "LOCAL_VS_NETWORK": ("LOCAL_RATES", "NETWORK_RATES"),
    "INTERACTIONS": ("CALENDAR", "WIND_ENCODING", "PHYSICAL", "NETWORK_STATE", "NETWORK_RATES"),
}
#: Families with columns that hold what other stations read in the same hour, which a forecast may not have yet.
SAME_HOUR = ("NETWORK_STATE", "SPATIAL_GRADIENTS", "NETWORK_RATES", "LOCAL_VS_NETWORK", "UPWIND", "INTERACTIONS")
#: What a plan must exchange rows for.
OF_HOURS = ("NETWORK_HISTORY",)
BY_STATION = ("LOCAL_LAGS_SHORT", "LOCAL_LAGS_MEDIUM", "LOCAL_LAGS_LONG", "LOCAL_ROLLING", "UPWIND")


def closure(chosen) -> set[str]:
    """The families and all that they are made from."""
    out: set[str] = set()
    todo = list(chosen)
    while todo:
        f = todo.pop()
        if f not in out:
            out.add(f)
            todo += NEEDS.get(f, ())
    return out


def source_columns(chosen) -> list[str]:
    """The readings that families are made from, by their notes."""
    named = {c for n in notes.NOTES if n.family in chosen for c in n.reads}
    return [c for c in (*POLLUTANTS, *WEATHER, "wd") if c in named]


def without_same_hour(known: dict[str, list[str]]) -> list[str]:
    """The families that a forecast can use before the other stations' readings of its hour arrive."""
    return [f for f in known if f not in SAME_HOUR]


def build_features(panel: DataFrame, keep: tuple[str, ...] = ("id", TS, "_is_train"), only: list[str] | None = None) -> DataFrame:
    """The columns of the families in only (None: all) for every row of the panel, which must be unique by station and hour.

    Only what the chosen families need is planned: families of the row alone exchange nothing, lags and windows exchange rows by (station, bucket of time)
    and share one sort, and what stations have in common comes from one table by hour, which rows join once. The panel is read twice where that table is
    needed, so give it as a table (sources.staged) rather than as a long plan. Rows that are to be split later must be in one panel, since test rows look back into training rows."""
    known = families()
    chosen = list(known) if only is None else only
    if wrong := [f for f in chosen if f not in known]:
        raise ValueError(f"no such family: {', '.join(wrong)}")
    needed = closure(chosen)
    keep = tuple(c for c in keep if c in panel.columns)
    sources = source_columns(needed)
    if absent := [c for c in ("station", TS, *sources) if c not in panel.columns]:
        raise ValueError(f"the panel lacks {', '.join(absent)}, which {', '.join(chosen)} need")
    seen = panel.select(*dict.fromkeys([TS, *keep, "station", *sources]))
    if "NETWORK_STATE" in needed:
        more = {"readings": upwind.readings()} if "UPWIND" in needed else {}
        table = network.hours(seen, more) if needed & set(OF_HOURS) else network.hour_table(seen, more=more)
        seen = seen.join(table, TS, "left")
    if "UPWIND" in needed:
        seen = upwind.with_upwind(seen)
    if needed & set(BY_STATION):

        def history(h):
            made = temporal.lag_columns(h) | temporal.rolling_columns(h) | (upwind.history_columns(h) if "UPWIND" in needed else {})
            wanted = {c for f in needed for c in known[f]}
            return {n: c for n, c in made.items() if n in wanted}

        seen = temporal.with_history(seen, ["station"], history, LONGEST)
    makers = [
        ("CALENDAR", rowwise.calendar), ("WIND_ENCODING", rowwise.wind), ("MISSINGNESS", rowwise.missingness), ("QUALITY_FLAGS", rowwise.quality_flags),
        ("PHYSICAL", rowwise.physical), ("LOCAL_RATES", temporal.rates), ("SPATIAL_GRADIENTS", network.gradients), ("UPWIND", upwind.contrasts),
    ]
    local = {n: c for f, make in makers if f in needed for n, c in make().items()}
    full = seen.select("*", *[c.alias(n) for n, c in local.items()])
    last = {n: c for f, make in (("LOCAL_VS_NETWORK", network.local_vs_network), ("INTERACTIONS", rowwise.interactions)) if f in needed for n, c in make().items()}
    full = full.select("*", *[c.alias(n) for n, c in last.items()])
    wanted = {c for f in chosen for c in known[f]}
    return full.select(*keep, *[c for c in column_order(known) if c not in keep and c in wanted])


@dataclass
class Export:
    """features holds both splits, marked by _is_train; nothing has run yet but the checks. After run() the tables it was made from are gone: read the files."""

    features: DataFrame
    labels: DataFrame
    test_ids: DataFrame
    families: dict[str, list[str]] = field(default_factory=dict)


def prepare(train: DataFrame, test: DataFrame, audit: bool = True, only: list[str] | None = None, rows_checked: bool = False) -> Export:
    """Checks, features and alignment of a training and a test panel; raises with all broken rules at once.

    Rules of rows are one pass, rules of keys one pass of the keys, the leak audit a join of the readings; that no feature reads later rows is seen from the plan. rows_checked: the rows have met the row rules before, e.g. while they were written."""
    measured = [*POLLUTANTS, *WEATHER]
    full = splits.union(train, test)
    found = checks.as_dict(checks.key_violations(full))
    if not rows_checked:
        found |= checks.as_dict(checks.row_violations(full, checks.row_rules(full.columns)))
        found |= checks.as_dict(checks.row_violations(train, checks.row_rules([TARGET], TARGET)[-1:]))
    checks.require_rules(found)
    if audit:
        checks.require_no_leak(checks.leak_audit(train, measured, TARGET))
    features = build_features(full, only=only)
    known = families()
    known = known if only is None else {f: known[f] for f in only}
    checks.reject_names(features.columns)
    causality.require_causal(features, columns=[c for c in features.columns if c not in ("id", TS, "_is_train")])
    if rest := unassigned([c for c in features.columns if c not in ("id", TS, "_is_train")], known):
        known["UNASSIGNED"] = rest
    # Station and hour are unique, so a row's own id and target are what a join by key would find.
    return Export(features, train.select("id", TARGET), test.select("id"), known)


def export(spark: SparkSession, made: Export, folder: str) -> None:
    """features_train, features_test, y, test_ids, feature_groups.json and feature_types.json. Rows carry their id: files have no row order to align by.

    The features are made once, into a table by split that both files are read from; it goes again at the end. Ranges, missing values and row counts ride
    on that write. Both files get the types that hold the values of both, as feature_types.json says. Faults of the features are found before any of the other files is written."""
    stage = f"{folder}/_features.parquet"
    rows = made.features.drop(TS)
    columns = [c for c in rows.columns if c not in ("id", "_is_train")]
    train = F.col("_is_train") == 1
    metrics = [F.count_if(train).alias("train rows"), F.count_if(~train).alias("test rows"), *range_metrics(whole_columns(rows)), *[F.count(F.when(train, F.col(f"`{c}`"))).alias(f"known {c}") for c in columns]]
    watched, seen = checks.watched(rows, metrics, "features")
    watched.write.mode("overwrite").partitionBy("_is_train").parquet(stage)
    found = seen.get
    if found["train rows"] and (empty := [c for c in columns if not found[f"known {c}"]]):
        raise ValueError(f"no value in {', '.join(empty)}")
    labels, label_counts = checks.watched(made.labels, [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(TARGET).isNull()).alias("missing")], "labels")
    ids, id_counts = checks.watched(made.test_ids, [F.count(F.lit(1)).alias("rows")], "ids")
    write_parquet(labels, f"{folder}/y.parquet")
    write_parquet(ids, f"{folder}/test_ids.parquet")
    if n := label_counts.get["missing"]:
        raise ValueError(f"{TARGET} has {n} missing values")
    for name, mine, due in (("y", label_counts.get["rows"], found["train rows"]), ("test_ids", id_counts.get["rows"], found["test rows"])):
        if mine != due:
            raise ValueError(f"{name} has {mine} rows where the features have {due}")
    types = narrow_types(rows.drop("_is_train"), found)
    parts = splits.split(spark.read.schema(rows.schema).parquet(stage))
    checks.require_same_columns(*[cast_to(df, types) for df in parts])
    for name, df in zip(("features_train", "features_test"), parts):
        write_parquet(df, f"{folder}/{name}.parquet", types=types)
    delete(spark, stage)
    write_registry(spark, made.families, f"{folder}/feature_groups.json")
    write_json(spark, {c: {"type": t, "least": found.get(f"least {c}"), "most": found.get(f"most {c}")} for c, t in types.items()}, f"{folder}/feature_types.json")


def read_checked(spark: SparkSession, train_csv: str, test_csv: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and test panel as typed tables in folder, written in the one pass that reads each CSV; raises with every fault of cells, records and row rules, by count."""
    out, faults = [], {}
    for name, path, train in (("train", train_csv, True), ("test", test_csv, False)):
        parsed = parse_panel_csv(spark, path, train)
        rules = checks.row_rules(parsed.columns, TARGET)
        whole = F.size("faults") == 0  # what couldn't be read is counted as that, not as a broken rule too
        metrics = fault_metrics(input_schema(train)) + [F.count_if(whole & r.broken).alias(r.name) for r in rules]
        watched, seen = checks.watched(parsed, metrics, name)
        to = f"{folder}/_{name}.parquet"
        watched.drop("faults").write.mode("overwrite").parquet(to)
        found = seen.get
        faults |= {f"{path}: {k}": n for k, n in found.items()}
        out.append(spark.read.schema(parsed.drop("faults").schema).parquet(to))
    checks.require_rules(faults)
    return out[0], out[1]


def run(spark: SparkSession, train_csv: str, test_csv: str, folder: str, only: list[str] | None = None) -> Export:
    """CSV files in, feature files out. Each CSV is read once; everything after it reads typed tables in folder, which are deleted at the end, also after a fault."""
    try:
        made = prepare(*read_checked(spark, train_csv, test_csv, folder), only=only, rows_checked=True)
        export(spark, made, folder)
        return made
    finally:
        for name in ("train", "test"):
            delete(spark, f"{folder}/_{name}.parquet")
        delete(spark, f"{folder}/_features.parquet")


def family_counts(made: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """family, n_columns, n_missing (values) and n_complete (rows with a value in every column) of the families that a table of features has, in one pass."""
    own = {f: [c for c in columns if c in made.columns] for f, columns in (known or families()).items()}
    own = {f: columns for f, columns in own.items() if columns}
    null = lambda c: F.col(f"`{c}`").isNull().cast("bigint")
    lacks = {f: reduce(add, map(null, columns)) for f, columns in own.items()}
    one = made.agg(*[x for f, n in lacks.items() for x in (F.coalesce(F.sum(n), F.lit(0)).alias(f"{f}_missing"), F.count_if(n == 0).alias(f"{f}_complete"))])
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(len(columns)).cast("bigint").alias("n_columns"), F.col(f"{f}_missing").alias("n_missing"), F.col(f"{f}_complete").alias("n_complete")) for f, columns in own.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")
