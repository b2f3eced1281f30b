"""Operator 9: token ids in Arrow files of equal-length sequences.

encode() turns texts into ids with the tokenizers library. write() puts all documents' ids, in ascending order of doc_id,
into shards. A shard is an Arrow IPC file of record batches with two fixed-size lists per row, ids and mask: the ids of its
documents one after another, cut into sequences of equal length, with only the last one padded (mask false). Beside it a
file of documents holds doc_id, first id in the shard and number of ids. Buffers are not compressed, so a memory-mapped
file gives any sequence without a copy; read() takes whole documents from them again.

Cases: a null or empty text has only the end id; a null doc_id comes first; rows with one doc_id are ordered by text
hash and each keep a place; a text may be as long as fits a task's memory, as its ids pass in blocks; an empty table gives no rows; other
columns are ignored. A task that is run again writes files of its own, so lost executors leave no broken shard.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import Recent, characters, closed, distinct, materialise, new_path, slices, utf8, vocabulary

#: Characters from BEYOND on have a class of their own, as versions of Unicode may differ about them.
BEYOND = 0x530
#: Bytes of kept pieces per worker, in each of two generations.
KEPT = 48 << 20
SEQUENCE, ROWS, SHARD_BYTES = 2048, 128, 64 << 20
#: Most tasks that read shards.
READERS = 20_000
#: What pyarrow calls the stores that Hadoop knows by other schemes.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
LETTER, NUMBER, OTHER, QUOTE, SPACE, FEED, FAR, HIDDEN = range(8)


def byte_signs() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def kinds() -> np.ndarray:
    """The class of each character up to BEYOND, which stands for all that follow."""
    by = {"L": LETTER, "N": NUMBER}
    out = np.array([by.get(unicodedata.category(chr(c))[0], OTHER) if chr(c).isprintable() else HIDDEN for c in range(BEYOND)] + [FAR], np.uint8)
    out[ord("'")], out[ord(" ")], out[ord("\n")] = QUOTE, SPACE, FEED
    return out


def borders() -> bytes:
    """By pair of classes, 8 * left + right: 1 where the byte-level pattern always ends a piece in a plain text, 2 where the text isn't plain.

    Letters, numbers and other signs are pieces of their own; a quote may belong to what follows (as in 't) and a space always does.
    A text is plain if each space and line feed stands alone between two visible characters, so that a piece always ends before it."""
    out = np.zeros((8, 8), np.uint8)
    for a in (LETTER, NUMBER, OTHER):
        out[a, [b for b in (LETTER, NUMBER, OTHER) if b != a]] = 1
    out[:, [SPACE, FEED]] = 1
    out[FEED] = 1
    out[np.ix_([SPACE, FEED], [SPACE, FEED])] = 2
    return out.tobytes() + bytes(192)


def byte_level(tokenizer) -> bool:
    """Whether texts may be cut at borders(): byte-level BPE with the usual pattern, nothing before it, and added tokens only where plain() sees them."""
    import json

    spec = json.loads(tokenizer.to_str())
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(t["content"].startswith("<|") and not t["lstrip"] for t in spec.get("added_tokens", []))
    )


class Encoder:
    """Ids of texts, little-endian. A byte-level BPE's texts are cut into pieces, which are encoded once while they stay among the recent ones."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cuts = byte_level(self.library)
        self.tokenize = self.library.model.tokenize
        self.signs = byte_signs()
        self.space = chr(self.signs[32])
        self.feed = self.whole("\n")
        self.kinds, self.borders = kinds(), borders()
        self.near = self.kinds[:128].tobytes() + bytes([FAR]) * 128
        self.recent = Recent(KEPT)

    def piece(self, x: str) -> bytes:
        """Letters, numbers or other signs, with or without a space before them, go to the library's model alone; the rest to the library."""
        body = x[1:] if x[0] == " " else x
        if body.isascii():
            if not (body.isalpha() or body.isdigit()) and (not body.isprintable() or "'" in body):
                return self.feed if x == "\n" else self.whole(x)
            spelt = x if body is x else self.space + body
        elif body.isalpha() and max(body) < chr(BEYOND):
            spelt = x.encode().decode("latin-1").translate(self.signs)
        else:
            return self.whole(x)
        return array(self.code, [t.id for t in self.tokenize(spelt)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, column: pa.Array, tail: bytes = b"") -> tuple[memoryview, np.ndarray]:
        """The ids of all texts, one text after another and each with the tail, and how many each has."""
        data, ends = utf8(column)
        at, plain = self.cut(data, ends)
        tails = np.flatnonzero(np.diff(at) == 0)  # no other piece is empty
        heads = np.r_[0, tails + 1]
        words, which = distinct(data, at)
        known = {words[i]: self.whole(words[i]) for i in np.unique(which.to_numpy()[heads[:-1][~plain]]).tolist()} | {"": tail}
        if new := self.recent.look({x for x in words if x not in known}):
            found = {x: self.piece(x) for x in new}
            self.recent.add(found, sum(map(len, found.values())))
        young = self.recent.young
        ids = pa.array([known[x] if x in known else young[x] for x in words], pa.binary()).take(which)
        self.recent.settle()
        _, places, raw = ids.buffers()
        places = np.frombuffer(places, "<i4")[heads].astype(np.int64)
        raw = memoryview(raw or b"").cast("B")[: places[-1]]
        if len(easy := np.flatnonzero(plain)[:1]):
            i = easy[0]
            if raw[places[i] : places[i + 1]] != self.whole(data[ends[i] : ends[i + 1]].tobytes().decode()) + tail:
                raise ValueError("the tokenizer ends pieces in other places than byte-level BPE does")
        return raw, np.diff(places) // self.dtype.itemsize

    def cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pieces, an empty one at the end of each text, and which texts are plain; the others are one piece."""
        plain = np.diff(ends) > 0
        starts, lead, wide, code = characters(data)
        full = np.flatnonzero(plain)
        heads, lasts = np.searchsorted(starts, ends[:-1][full]), np.searchsorted(starts, ends[1:][full]) - 1
        kind = np.frombuffer(bytearray(lead.tobytes().translate(self.near)), np.uint8)
        kind[wide] = self.kinds[np.minimum(code, BEYOND)]
        pair = np.frombuffer(bytearray(b"\1" + (kind[:-1] * 8 + kind[1:]).tobytes().translate(self.borders)), np.uint8)[: len(kind)]
        pair[1:][(lead[:-1] == ord("<")) & (lead[1:] == ord("|"))] = 2
        pair[heads] = 1
        blank = lambda i: (kind[i] == SPACE) | (kind[i] == FEED)
        odd = np.concatenate([np.flatnonzero(pair == 2), np.flatnonzero(kind == HIDDEN), heads[blank(heads)], lasts[blank(lasts)]])
        text = lambda i: np.searchsorted(ends, starts[i], "right") - 1
        plain[text(odd)] = False
        for i in np.unique(text(np.flatnonzero(kind == FAR))).tolist():
            plain[i] &= data[ends[i] : ends[i + 1]].tobytes().decode().replace("\n", "").isprintable()
        if not self.cuts:
            plain[:] = False
        cuts = pair == 1
        for i in np.flatnonzero(~plain[full]).tolist():
            cuts[heads[i] + 1 : lasts[i] + 1] = False
        return closed(starts[cuts], ends), plain


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class Store:
    """Files of a folder that all executors share, by its URI or path."""

    folder: str

    def at(self) -> tuple[pafs.FileSystem, str]:
        scheme, colon, rest = self.folder.partition(":")
        if not colon:
            return pafs.LocalFileSystem(), self.folder
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")

    def put(self, name: str, write) -> None:
        """write(sink) fills the file; names hold the attempt, so no two tasks write the same one."""
        fs, folder = self.at()
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as sink:
            write(sink)

    def open(self, name: str) -> pa.ipc.RecordBatchFileReader:
        fs, folder = self.at()
        local = isinstance(fs, pafs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(f"{folder}/{name}") if local else fs.open_input_file(f"{folder}/{name}"))


def sequences(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int, rows: int = ROWS) -> np.ndarray:
    """The ids of sequence i of a shard, without a copy."""
    b, length = reader.get_batch(i // rows), reader.schema.field("ids").type.list_size
    j = i % rows
    return b.column("ids").values.to_numpy(zero_copy_only=True)[j * length : (j + 1) * length]


def based(shards: DataFrame) -> DataFrame:
    """The shards with base, the ids of all shards before each: sums by thousands of shards first, so no task takes a row per shard."""
    block = (F.col("shard") / 1000).cast("int")
    before = lambda w: w.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.groupBy(block.alias("block")).agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower"))
    own = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("block"))), F.lit(0))
    return shards.withColumn("block", block).withColumn("base", own).join(sums, "block").select("shard", "name", (F.col("base") + F.col("lower")).alias("base"), "n_tokens", "n_docs")


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = 0, length: int = SEQUENCE, shards: int | None = None) -> DataFrame:
    """Writes the shards to path and returns the manifest, a table in the shared folder: shard, name (of its files), base (ids of all shards before it), n_tokens, n_docs.

    Rows go to shards by range of (doc_id, text hash, row number), so a doc_id with many rows is dealt over several. A task names its
    files by its attempt, and Spark's commit of the manifest says whose count; files of lost attempts are never read."""
    Store(path).at()  # a store that pyarrow doesn't know fails here, before any work
    spark = docs.sparkSession
    if shards is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    order = [F.asc_nulls_first("doc_id"), F.col("h_"), F.col("r_")]
    ranged = docs.select("doc_id", "text").withColumns({"h_": F.xxhash64("text"), "r_": F.monotonically_increasing_id()}).repartitionByRange(int(shards), *order).sortWithinPartitions(*order).drop("h_", "r_")
    store = Store(path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        tail = b"" if end is None else np.array([end], enc.dtype).tobytes()
        width, schema = enc.dtype.itemsize, sequences(enc.dtype, length)
        found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def rows(raw: bytes) -> pa.RecordBatch:
            n = len(raw) // width
            full = -(-n // length) * length
            ids = np.frombuffer(raw + bytes((full - n) * width), enc.dtype)
            return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(full) < n), length)], schema=schema)

        def ids(sink) -> None:
            at, rest = 0, bytearray()
            block = ROWS * length * width
            with pa.ipc.new_file(sink, schema) as out:
                for b in slices(batches, 4 << 20):
                    raw, sizes = enc.encode(b.column(1), tail)
                    found.append((at + np.cumsum(sizes) - sizes, sizes, b.column(0)))
                    at += int(sizes.sum())
                    rest += raw
                    cut = len(rest) // block * block
                    for i in range(0, cut, block):
                        out.write_batch(rows(bytes(rest[i : i + block])))
                    del rest[:cut]
                if rest:
                    out.write_batch(rows(bytes(rest)))

        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

        def index(sink) -> None:
            with pa.ipc.new_file(sink, kinds) as out:
                for first, sizes, own in found:
                    out.write_batch(pa.record_batch([own.cast(pa.int64()), pa.array(first), pa.array(sizes)], schema=kinds))

        name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        store.put(f"{name}.arrow", ids)
        store.put(f"{name}.docs.arrow", index)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name], pa.string()), pa.array([sum(int(s.sum()) for _, s, _ in found)], pa.int64()), pa.array([sum(len(s) for _, s, _ in found)], pa.int64())], names=["shard", "name", "n_tokens", "n_docs"])

    done = materialise(ranged.mapInArrow(put, "shard int, name string, n_tokens long, n_docs long"), "token-shards")
    return materialise(based(done), "token-manifest")


def read(manifest: DataFrame, path: str, rows: int = ROWS) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids of every document, taken from the files."""
    store = Store(path)
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in batches:
            for name, base in zip(m.column("name").to_pylist(), m.column("base").to_pylist()):
                ids, index = store.open(f"{name}.arrow"), store.open(f"{name}.docs.arrow")
                length = ids.schema.field("ids").type.list_size
                per = rows * length

                def between(a: int, b: int) -> bytes:
                    parts = []
                    while a < b:
                        k = a // per
                        flat = ids.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
                        part = flat[a - k * per : min(b, (k + 1) * per) - k * per]
                        parts.append(part.astype("<u4").tobytes())
                        a += len(part)
                    return b"".join(parts)

                for i in range(index.num_record_batches):
                    b = index.get_batch(i)
                    for j in range(0, b.num_rows, 256):
                        own = b.slice(j, 256)
                        starts, sizes = own.column("start").to_pylist(), own.column("n_tokens").to_pylist()
                        yield pa.record_batch([own.column("doc_id"), pa.array([base + s for s in starts], pa.int64()), own.column("n_tokens"), pa.array([between(s, s + n) for s, n in zip(starts, sizes)], pa.binary())], schema=kinds)

    # One row is a whole shard's work, which Spark can't see from a small table's size: dealt by name, not by bytes.
    n = max(1, manifest.agg(F.max("shard")).first()[0] or 0)
    return manifest.select("name", "base").repartition(min(n + 1, READERS), "name").mapInArrow(get, "doc_id long, start long, n_tokens long, ids binary")


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    manifest = write(docs, path, tokenizer or vocabulary("byte_bpe_50k.json"))
    return read(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
