"""What each family of features promises: inputs, formula, type, when it is known, what a missing value does, and its leak risk."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from hourloom.operators import causality
from hourloom.schema import KEY, MEASURED, NETWORK, POLLUTANTS, PRIMARY, WEATHER


@dataclass(frozen=True)
class Note:
    family: str
    inputs: str
    formula: str
    output: str
    available: str
    missing: str
    leak_risk: str
    reads: tuple[str, ...] = ()
    others: bool = False


READINGS, P = (*POLLUTANTS, *WEATHER), tuple(PRIMARY)
AT = "at t"
NETWORK_AT = "at t, if all stations' readings of the hour arrive by then"

NOTES = [
    Note("RAW", "the row's readings", "as read", "double", AT, "null", "none: the target is removed first", READINGS),
    Note("STATION", "station", "as read", "string", AT, "never missing", "none", ("station",)),
    Note("CALENDAR", "timestamp", "parts, sine and cosine of their place in the period, two seasons", "int, double", AT, "never missing", "none", ()),
    Note("WIND_ENCODING", "wd, WSPM", "sine and cosine of the compass degrees, components, WSPM < 1", "double, 0/1", AT, "null; the flag is 0", "none", ("wd", "WSPM")),
    Note("MISSINGNESS", "all readings", "1 where the reading is null", "0/1", AT, "never missing", "none", tuple(MEASURED)),
    Note("QUALITY_FLAGS", "CO, O3, RAIN", "CO = 100, CO = 10000, O3 > 400, RAIN > 0", "0/1", AT, "0", "none", ("CO", "O3", "RAIN")),
    Note("PHYSICAL", "readings", "TEMP - DEWP, five ratios, Magnus humidity", "double", AT, "null, also for a zero denominator", "none", ("TEMP", "DEWP", *POLLUTANTS)),
    Note("LOCAL_LAGS_SHORT", "the station's readings", "value exactly 1, 2 or 3 hours before", "double", AT, "null where that hour or value is missing", "none: past rows only", READINGS),
    Note("LOCAL_LAGS_MEDIUM", "the station's readings", "value exactly 6, 12 or 24 hours before", "double", AT, "null where that hour or value is missing", "none: past rows only", READINGS),
    Note("LOCAL_LAGS_LONG", "PM10, CO", "value exactly 24 or 48 hours before", "double", AT, "null where that hour or value is missing", "none: past rows only", P),
    Note("LOCAL_ROLLING", "PM10, CO", "mean, sample deviation, least and most over [t - N hours, t)", "double", AT, "null for an empty window; deviation null for one value", "none: the row itself is left out", P),
    Note("LOCAL_RATES", "readings, lags, 24-hour mean", "differences, relative change, second difference, distance to the mean", "double", AT, "null if any part is", "none", tuple(POLLUTANTS)),
    Note("NETWORK_STATE", "all stations at t", "mean, sample deviation, least, most, median; range", "double", NETWORK_AT, "null if no station has a value", "same-hour readings of others", tuple(NETWORK), True),
    Note("SPATIAL_GRADIENTS", "reading, network state", "distance to the mean, in deviations too", "double", NETWORK_AT, "null, also for deviation 0", "same-hour readings of others", tuple(NETWORK), True),
    Note("NETWORK_HISTORY", "network state", "state exactly 1, 3, 6 or 24 hours before, by timestamp alone", "double", AT, "null where no station reported then", "none: past rows only", P, True),
    Note("NETWORK_RATES", "network mean and lags", "changes over 1, 3, 24 hours; mean - 2 lag1 + lag3", "double", NETWORK_AT, "null if any part is", "same-hour readings of others", P, True),
    Note("LOCAL_VS_NETWORK", "local and network change", "difference of the changes over an hour", "double", NETWORK_AT, "null if any part is", "same-hour readings of others", P, True),
    Note("UPWIND", "wd, WSPM, stations within 45 degrees upwind", "mean, mean by alignment, count, lags, contrast with own reading", "double, int", NETWORK_AT, "null; count 0 for unknown wind", "same-hour readings of others", ("wd", "WSPM", *P), True),
    Note("INTERACTIONS", "readings, flags, network mean and change", "products", "double", NETWORK_AT, "null if any part is", "same-hour readings of others", ("SO2", "NO2", "O3", "TEMP", "DEWP", "RAIN", "WSPM", *P), True),
]


def as_table(spark: SparkSession) -> DataFrame:
    kinds = {"reads": "array<string>", "others": "boolean"}
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(n).values()) for n in NOTES], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in asdict(NOTES[0])))


def disagreements(features: DataFrame, families: dict[str, list[str]], notes: list[Note] = NOTES) -> list[str]:
    """Where notes aren't what the plan of the features says: source columns (other than station and hour) that a family reads and its note doesn't name or the
    other way round, and whether it reads other stations' rows. Families without a note or a column here are passed over."""
    found, out = causality.reads(features), []
    by = {n.family: n for n in notes}
    for family, columns in families.items():
        own = [c for c in columns if c in found]
        if not own or family not in by:
            continue
        every = [r for c in own for r in found[c]]
        keys = set(KEY) if family != "STATION" else {KEY[1]}
        read, named = {r.column for r in every} - keys, set(by[family].reads)
        out += [f"{family} reads {c}" for c in sorted(read - named)] + [f"{family} doesn't read {c}" for c in sorted(named - read)]
        if (shared := any(r.others for r in every)) != by[family].others:
            out.append(f"{family} {'reads' if shared else 'does not read'} other stations' rows")
    return out


def require_true(features: DataFrame, families: dict[str, list[str]], notes: list[Note] = NOTES) -> None:
    if found := disagreements(features, families, notes):
        raise ValueError("notes that aren't true: " + "; ".join(found))
