"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that the word and line rules treat as white space.
SPACE = r"[\x20\x09-\x0D]"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, as spark-submit --py-files does."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where the setting is missing, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Short rows that one task can take where materialise() is told how many there are at most.
ROWS_PER_TASK = 200_000


def materialise(df: DataFrame, what: str = "stage", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and gives the planner the true size.

    rows: a bound of its (short) rows, which sets the number of the writing tasks, so small tables don't become many tiny files."""
    spark = df.sparkSession
    path = new_path(spark, what)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with no column."""
    taken, lead = {c.lower() for c in columns}, "_"
    while any(c.startswith(lead) for c in taken):
        lead += "_"
    return [lead + n for n in names]


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with the columns of these names renamed, and what selects the columns of docs again from a result that has kept the others."""
    clash = [c for c in docs.columns if c.lower() in names]
    apart = dict(zip(clash, unused(docs.columns, *clash)))
    return docs.withColumnsRenamed(apart), [F.col(f"`{apart.get(c, c)}`").alias(c) for c in docs.columns]


def uniform(*parts) -> F.Column:
    """A number strictly between 0 and 1 from the md5 of the parts joined by ':' (13 hex digits, so exact in a double)."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about size bytes, so what a task builds for a slice stays bounded whatever a text's length.

    Workers live on between tasks: what Arrow's pool has kept goes back to the system at the end."""
    for b in batches:
        rows = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()


class Recent:
    """Results by key in two generations bounded by bytes: when the young one is full it becomes the old one, and what is used again moves on.

    look() makes every key of a batch known, so young holds them all until settle()."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.young: dict = {}
        self.old: dict = {}

    def look(self, keys: set) -> list:
        """The keys that neither generation has."""
        new = keys.difference(self.young)
        old = self.old
        self.add({k: old[k] for k in new if k in old}, 0)
        return [k for k in new if k not in old]

    def add(self, found: dict, size: int) -> None:
        """size: bytes of the values; keys count with their length and each entry with 150 bytes."""
        self.young.update(found)
        self.size += size + sum(map(len, found)) + 150 * len(found)

    def settle(self) -> None:
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, one text after another, and the places where they start, with the end. A null is an empty text."""
    column = column.cast(pa.string()).fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts, its first byte, which characters take several bytes, and the code points of these."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts]
    wide = np.flatnonzero(lead >= 0x80)
    at, first = starts[wide], lead[wide].astype(np.int32)
    code = (first & 0x1F) << 6 | data[at + 1] & 0x3F
    for size, least, bits in ((3, 0xE0, 0x3FF), (4, 0xF0, 0x7FFF)):
        long = first >= least
        code[long] = (code[long] & bits) << 6 | data[at[long] + size - 1] & 0x3F
    return starts, lead, wide, code


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[list[str], pa.Array]:
    """The distinct strings between neighbouring places of UTF-8 bytes, and for each of all strings which of them it is."""
    found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices


def closed(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places at which strings start, with an empty string at the end of each text, and the end of all."""
    return np.r_[np.insert(places, np.searchsorted(places, ends[1:]), ends[1:]), ends[-1]]
