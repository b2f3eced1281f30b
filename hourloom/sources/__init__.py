"""Reading and writing: CSV panels, Parquet features, the JSON registry, and fingerprints of files."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.schema import FORBIDDEN, TARGET, input_schema


# Cells that stand for a missing value.
NULLS = ("", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "NULL", "null", "None", "<NA>", "#N/A", "#NA")
NUMBER, WHOLE_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", r"^[+-]?[0-9]+(\.0*)?$"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
#: Columns of a panel in which no cell may be missing.
KEYS = ("id", "observation_timestamp", "station")
#: Holds the text of a record whose cells are too few or too many.
RECORD = "_record"
#: Why a cell or record isn't taken.
REASONS = ("malformed", "missing key", "wrong length")


def raw_schema(schema: T.StructType) -> T.StructType:
    """Every cell as text, and the record where its length is wrong."""
    return T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(RECORD, T.StringType())])


def parsed(given: Column, kind: T.DataType) -> Column:
    """A cell's text in its type; null where it isn't of that type."""
    if isinstance(kind, T.StringType):
        return given
    if isinstance(kind, T.TimestampNTZType):
        return F.when(given.rlike(MOMENT), given.try_cast("timestamp_ntz"))
    if isinstance(kind, T.IntegralType):
        return F.when(given.rlike(WHOLE_NUMBER), F.regexp_replace(given, r"\.0*$", "").try_cast(kind))
    return F.when(given.rlike(NUMBER), F.nullif(given.try_cast("double"), F.lit(float("inf"))))


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of text (raw_schema) as typed columns, with faults: an array of column and reason, empty for a good record.

    A missing value is null and no fault, but for a key. A record of the wrong length has that fault alone, with no column: its cells may be any one's."""
    whole = F.col(RECORD).isNull()
    names = {f.name: f"{f.name}_text_" for f in schema.fields}
    # Each step's columns are used more than once by the next, so the steps stay apart in the plan.
    given = raw.select(RECORD, *[F.nullif(F.trim(c), F.lit("")).alias(t) for c, t in names.items()])
    given = given.select(RECORD, *[F.when(~F.col(t).isin(*NULLS), F.col(t)).alias(t) for t in names.values()])
    values = given.select("*", *[parsed(F.col(names[f.name]), f.dataType).alias(f.name) for f in schema.fields])
    faults = [F.when(~whole, fault(None, "wrong length"))]
    for f in schema.fields:
        text, value = F.col(names[f.name]), F.col(f.name)
        if not isinstance(f.dataType, T.StringType):
            faults.append(F.when(whole & text.isNotNull() & value.isNull(), fault(f.name, "malformed")))
        if f.name in KEYS:
            faults.append(F.when(whole & text.isNull(), fault(f.name, "missing key")))
    return values.select(*schema.names, F.array_compact(F.array(*faults)).alias("faults"))


def fault(column: str | None, reason: str) -> Column:
    return F.struct(F.lit(column).cast("string").alias("column"), F.lit(reason).alias("reason"))


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "line") -> DataFrame:
    """typed() of a column of CSV records, e.g. of a stream of messages; the other columns are dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD}
    read = F.from_csv(column, raw_schema(schema).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return typed(lines.select(read.alias("r")).select("r.*"), schema)


def parse_panel_csv(spark: SparkSession, path: str, train: bool) -> DataFrame:
    """A panel with header, typed, with the faults of each record; nothing is refused yet. The columns are checked against the split."""
    names = spark.read.option("header", True).csv(path).columns  # reads the header only
    guard_columns(names, train)
    schema = input_schema(train)
    if names != schema.names:
        raise ValueError(f"columns {names} where {schema.names} are due")
    # Without pruning, a record's length is judged whatever columns a query asks for.
    options = {"header": True, "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": False}
    return typed(spark.read.schema(raw_schema(schema)).options(**options).csv(path), schema)


def fault_counts(read: DataFrame) -> DataFrame:
    """column, reason and n of the faults of typed records."""
    # An outer explode: an inner one would move its condition, with all that makes the faults, below the parsing.
    return read.select(F.explode_outer("faults").alias("f")).filter("f IS NOT NULL").groupBy("f.column", "f.reason").agg(F.count(F.lit(1)).alias("n"))


def fault_metrics(schema: T.StructType) -> list[Column]:
    """The same as aggregates by name, for DataFrame.observe: one number for each fault that a record can have."""
    has = lambda c, reason: F.exists("faults", lambda f: f["column"].eqNullSafe(F.lit(c)) & (f["reason"] == reason))
    out = [F.count_if(has(None, "wrong length")).alias("record: wrong length")]
    for f in schema.fields:
        out += [F.count_if(has(f.name, "malformed")).alias(f"{f.name}: malformed")] if not isinstance(f.dataType, T.StringType) else []
        out += [F.count_if(has(f.name, "missing key")).alias(f"{f.name}: missing key")] if f.name in KEYS else []
    return out


def require_no_faults(found: dict[str, int], where: str) -> None:
    """Raises with column, reason and count of every fault; found: numbers of fault_metrics()."""
    if bad := {k: n for k, n in found.items() if n and k.partition(": ")[2] in REASONS}:
        raise ValueError(f"{where}: " + ", ".join(f"{k} in {n} records" for k, n in bad.items()))


def read_panel_csv(spark: SparkSession, path: str, train: bool) -> DataFrame:
    """A panel with header; cells of NULLS are null. Raises on malformed cells, missing keys and records of the wrong length, which takes a pass of its own; features.run() reads and checks in one."""
    read = parse_panel_csv(spark, path, train)
    require_no_faults(read.agg(*fault_metrics(input_schema(train))).first().asDict(), path)
    return read.drop("faults")


def guard_columns(names: list[str], train: bool) -> None:
    """Raises if the forbidden column is there, if a training panel lacks the target or if a test panel has it."""
    if FORBIDDEN in names:
        raise ValueError(f"{FORBIDDEN} must not be in the inputs")
    if train and TARGET not in names:
        raise ValueError(f"the training panel has no {TARGET}")
    if not train and TARGET in names:
        raise ValueError(f"the test panel has {TARGET}")


#: Whole types from the narrowest, with the largest value of each.
WHOLE = (("tinyint", (1 << 7) - 1), ("smallint", (1 << 15) - 1), ("int", (1 << 31) - 1))


def whole_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("bigint", "int", "smallint")]


def range_metrics(columns: list[str]) -> list[Column]:
    """Least and largest value of each column, as aggregates for DataFrame.agg or observe."""
    return [x for c in columns for x in (F.min(c).cast("bigint").alias(f"least {c}"), F.max(c).cast("bigint").alias(f"most {c}"))]


def narrow_types(df: DataFrame, ranges: dict[str, int | None]) -> dict[str, str]:
    """A type for each column: double as float, whole columns in the narrowest type that holds their range, the rest as they are.

    ranges: of range_metrics() over all rows that the types are for. Tables that are to be read together need one range of all their rows."""
    out = {}
    for c, t in df.dtypes:
        low, high = ranges.get(f"least {c}"), ranges.get(f"most {c}")
        fits = [k for k, most in WHOLE if low is not None and -most - 1 <= low and high <= most]
        out[c] = "float" if t == "double" else fits[0] if fits else t
    return out


def column_types(df: DataFrame) -> DataFrame:
    """column, type, least and most: the contract that narrow_types() gives, as a table from one pass."""
    whole = whole_columns(df)
    ranges = df.agg(*range_metrics(whole))
    kind = lambda c, t: F.coalesce(*[F.when((F.col(f"`least {c}`") >= -most - 1) & (F.col(f"`most {c}`") <= most), F.lit(k)) for k, most in WHOLE], F.lit(t)) if c in whole else F.lit("float" if t == "double" else t)
    bound = lambda side, c: F.col(f"`{side} {c}`") if c in whole else F.lit(None).cast("bigint")
    rows = [F.struct(F.lit(c).alias("column"), kind(c, t).alias("type"), bound("least", c).alias("least"), bound("most", c).alias("most")) for c, t in df.dtypes]
    return ranges.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cast_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select([F.col(f"`{c}`").cast(types.get(c, t)).alias(c) for c, t in df.dtypes])


def narrowed(df: DataFrame) -> DataFrame:
    """A table by itself in narrow types, which takes one pass over its ranges."""
    whole = whole_columns(df)
    return cast_to(df, narrow_types(df, df.agg(*range_metrics(whole)).first().asDict() if whole else {}))


def write_parquet(df: DataFrame, path: str, narrow: bool = False, types: dict[str, str] | None = None) -> None:
    """narrow: types as narrow as the values allow, as the last step only. types: those of a contract, for tables that belong together."""
    (cast_to(df, types) if types else narrowed(df) if narrow else df).write.mode("overwrite").parquet(path)


def staged(df: DataFrame, what: str = "stage") -> DataFrame:
    """df written once, into spark.checkpoint.dir, and read again: what reads it several times computes it once, and a lost executor costs no more than a reread.

    Where the setting is missing, a local master gets a temporary folder and any other raises."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder in any store that Spark can write."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file of text in any store that Spark can write."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(conf).create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_registry(spark: SparkSession, families: dict[str, list[str]], path: str) -> None:
    write_text(spark, json.dumps(families, indent=2), path)


def read_registry(spark: SparkSession, path: str) -> dict[str, list[str]]:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json(spark: SparkSession, value, path: str) -> None:
    write_text(spark, json.dumps(value, indent=2), path)


def read_json(spark: SparkSession, path: str):
    """A small file as a whole, e.g. the types of feature files."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Stores whose files a task can read as a stream.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs")


def fingerprints(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """file, n_bytes and sha256 of each file's raw bytes. A file is read in chunks, whatever its size; in a store that pyarrow doesn't know it is read whole by one task."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    first = files.select("path").limit(1).collect()
    if first and first[0]["path"].partition(":")[0] not in STREAMED:
        return files.select(name, F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                local = p.startswith("file:")
                store, place = (pa.fs.LocalFileSystem(), p.removeprefix("file:").replace("///", "/")) if local else pa.fs.FileSystem.from_uri(p.replace("s3a://", "s3://"))
                digest = hashlib.sha256()
                with store.open_input_stream(place) as f:
                    while data := f.read(chunk):
                        digest.update(data)
                out.append(digest.hexdigest())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "length", "sha256"])

    listed = files.select("path", "length").repartition("path")  # the contents aren't read here
    return listed.mapInArrow(run, "path string, length long, sha256 string").select(name, F.col("length").alias("n_bytes"), "sha256")


def content_digest(df: DataFrame) -> DataFrame:
    """n_rows and digest of a table's contents, whatever the order of rows and however they lie in files: the sum of the first 48 bits of the md5 of each row.

    A row is its columns' texts in order, each with its length in characters, - for a null. Repeated rows count each. Pre-aggregated by task; the sum is exact up to 10^23 rows."""
    texts = [F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    number = F.conv(F.substring(F.md5(F.concat(*texts).cast("binary")), 1, 12), 16, 10).cast("decimal(15,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(number.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def with_place(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows of files with their place, from 0, in the order of file names and within each file: what a table has in place of row positions.

    df: a scan, e.g. spark.read.parquet(folder) or .csv(folder). Rows of a split come in order, and a split knows its file and where in it it starts; what lies before it is a
    sum over a row per split. Nothing is sorted."""
    marked = df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"))
    splits = marked.groupBy("file_", "block_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1))
    shift = splits.select("file_", "block_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("shift_"))
    return marked.join(shift, ["file_", "block_"]).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("at_") + F.col("shift_")).alias(name))
