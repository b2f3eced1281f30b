"""Operator 4: drop lines that many documents repeat, and give the result as compressed bitmaps.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least min_chars code points that at
least min_docs documents hold lose all their lines, except those of the largest doc_id with the key.

Keys become 128-bit hashes with their document and position. They are dealt by range of (hash, doc_id), so that a key
found in a third of all lines covers many partitions while the lines of one key in one document stay together, and are
sorted by hash, document (largest first) and position. Each partition is read as a stream: the first document of a run stays,
later ones wait, bounded by min_docs, until it is known whether the run has enough documents. Only the first and
last run of a partition may go on in another; their rows leave as open ones, and a table with at most two keys per partition
settles them. Drops meet again per document as zlib-compressed bitmaps with one bit for each line, 1 to keep.

Cases: a null or empty text is one empty line; a null doc_id counts as one document, smaller than the others; rows with one
doc_id and other texts count as one document and keep bitmaps of their own; repeated rows are alike; a very long text is split in its
own row's task; an empty table gives an empty one; other columns stay, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise, slices, unused

MIN_CHARS, MIN_DOCS = 40, 5
UPPER, LOWER, SPACES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"
NULL_ID = -(1 << 63)
DROP, OPEN, SUMMARY = 0, 1, 2
FIELDS = ("h1", "h2", "doc", "row", "pos", "kind")
SCHEMA = pa.schema([(x, pa.int64()) for x in FIELDS])


def keyed(docs: DataFrame, doc: str = "doc", row: str = "row") -> DataFrame:
    """doc and row, which name a row of documents in what follows: the id (null: NULL_ID) and a hash of the text."""
    return docs.withColumns({doc: F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), row: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, row and pos of every line with a long key."""
    lines = keyed(docs.select("doc_id", "text")).select("doc", "row", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    long = lines.filter(F.length("line") >= min_chars).withColumn("key", key).filter(F.length("key") >= min_chars)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "row", F.col("pos").cast("bigint").alias("pos"))


@dataclass
class Run:
    """A key's rows as they pass: documents so far, the last of them, and rows that wait for the run to have enough."""

    key: tuple
    top: int
    open: bool
    seen: int = 0
    doc: int | None = None
    wait: list = field(default_factory=list)

    def summary(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array([int(x)], pa.int64()) for x in (*self.key, self.top, self.seen, -1, SUMMARY)], schema=SCHEMA)


def stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches to drop; open ones, where the run may touch another partition; and those runs' summaries."""

    def marked(b: pa.RecordBatch, rows: np.ndarray, kind: int) -> pa.RecordBatch:
        b = b.filter(pa.array(rows))
        return pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, kind, np.int64))], schema=SCHEMA)

    now: Run | None = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = (b.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        ends = np.r_[starts[1:], b.num_rows]
        chosen = ends - starts >= min_docs  # others inside the batch can't have enough documents
        chosen[0] = chosen[-1] = True
        drop, opened = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
        for a, e in zip(starts[chosen].tolist(), ends[chosen].tolist()):
            if now is None or now.key != (h1[a], h2[a]):
                if now is not None and now.open:
                    yield now.summary()
                now = Run((h1[a], h2[a]), doc[a], now is None)
            own = doc[a:e]
            nth = now.seen + np.cumsum(np.r_[own[0] != now.doc, own[1:] != own[:-1]])  # 1: the largest document
            now.seen, now.doc = int(nth[-1]), own[-1]
            if now.open:
                opened[a:e] = True
            elif now.seen >= min_docs:
                yield from (marked(x, np.ones(x.num_rows, bool), DROP) for x in now.wait)
                now.wait = []
                drop[a:e] = nth > 1
            elif (nth > 1).any():
                now.wait.append(b.slice(a, e - a).filter(pa.array(nth > 1)))
        for rows, kind in ((drop, DROP), (opened, OPEN)):
            if rows.any():
                yield marked(b, rows, kind)
    if now is not None:
        yield now.summary()
        yield from (marked(x, np.ones(x.num_rows, bool), OPEN) for x in now.wait)


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row and pos of the lines to drop."""
    lines = materialise(keys(docs, min_chars), "line-keys")  # written, as range partitioning reads its input twice
    order = [F.col("h1"), F.col("h2"), F.desc("doc")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "pos")
    marks = materialise(dealt.mapInArrow(lambda it: stream(it, min_docs), ", ".join(f"{x} long" for x in FIELDS)), "line-marks")
    sums = marks.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("row").alias("n"), F.max("doc").alias("top")).filter(F.col("n") >= min_docs)
    settled = marks.filter(F.col("kind") == OPEN).join(F.broadcast(sums.select("h1", "h2", "top")), ["h1", "h2"]).filter(F.col("doc") < F.col("top"))  # two rows a partition at most
    return marks.filter(F.col("kind") == DROP).select("doc", "row", "pos").union(settled.select("doc", "row", "pos"))


def pack(positions: list[int]) -> bytes:
    """Bits up to the byte of the last dropped line, 0 to drop; lines beyond them stay."""
    bits = np.ones(max(positions) // 8 * 8 + 8, bool)
    bits[positions] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def kept(lines: list[str], keep: bytes) -> list[str]:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little").astype(bool).tolist()
    return [x for x, k in zip(lines, bits) if k] + lines[len(bits) :]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row, n_dropped and keep: for each row of documents that loses lines, bits up to its last dropped line; later lines stay."""
    per = drops(docs, min_chars, min_docs).groupBy("doc", "row").agg(F.collect_set("pos").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = b.column(2).to_pylist()
            yield pa.record_batch([b.column(0), b.column(1), pa.array([len(x) for x in each], pa.int64()), pa.array([pack(x) for x in each], pa.binary())], names=["doc", "row", "n_dropped", "keep"])

    return per.mapInArrow(run, "doc long, row long, n_dropped long, keep binary")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines gone from text, and n_lines (before) and n_dropped, which replace columns of these names."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    doc, row, keep = unused(docs.columns, "doc", "row", "keep")
    maps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc": doc, "row": row, "keep": keep})
    both = keyed(docs, doc, row).join(maps, [doc, row], "left").drop(doc, row)
    lines = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("bigint")
    both = both.select(*[F.col(f"`{c}`") for c in docs.columns], lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), keep)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in slices(batches):
            out = []
            for text, bits in zip(c.column(at).to_pylist(), c.column(c.num_columns - 1).to_pylist()):
                if bits is not None:
                    text = "\n".join(kept(text.split("\n"), bits))
                out.append(text)
            columns = list(c.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.record_batch(columns, names=c.schema.names[:-1])

    return both.mapInArrow(run, both.drop(keep).schema)


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT rid, doc_id, pos, x[pos] AS line, translate(regexp_replace(x[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) p),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, top IS NOT NULL AND l.doc_id <> top AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
