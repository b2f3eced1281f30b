"""Operator 6: SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes a space mark, then itself with spaces as marks (the identity normaliser with a dummy prefix). Two characters that no
piece of the vocabulary holds side by side are never joined, so texts are cut between them and segments are encoded alone. In a
segment an agenda of adjacent symbol pairs, ordered by score and then by place, gives the next pair to join: a plain list for
short segments, a heap whose stale entries are skipped for long ones. Characters without a piece become their UTF-8 bytes' pieces.
Decoding joins the surfaces of ids, turns byte pieces back into text, marks into spaces, and drops the dummy prefix.

Segments are encoded once per worker while they stay among the recent ones, which are bounded by bytes. Every segment that enters is
also encoded by the sentencepiece library, in one call for each Arrow batch, and so is the first whole text of a batch. Where
the two differ the library's ids hold, and n_differ counts the segments; it is 0 for the public vocabulary.

Cases: a null or empty text has no ids and decodes to the empty text; a text's own mark characters decode to spaces, as in
the library; a very long text is one row's work, cut into segments as any other, and takes memory in proportion to its length; an empty table gives
an empty one; other columns and repeated rows stay as they are, but for ids, decoded and n_differ, which are replaced.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import Recent, characters, closed, distinct, slices, utf8, vocabulary

MARK = "▁"
#: Bytes of kept segments per worker, in each of two generations; symbols up to which an agenda is a plain list.
KEPT, SHORT = 16 << 20, 32
#: Bytes of text that are cut at once: places and classes of their characters take some fifty times as much for a moment.
SLICE = 1 << 20
#: Characters from this one on count as one in the table of pairs; the mark has a place of its own after it.
TOP = 1 << 11
NEVER = float("inf")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.surface = {i: p for p, i in self.id.items()}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        self.recent = Recent(KEPT)
        self.pairs = np.zeros((TOP + 2, TOP + 2), bool)
        self.pairs[TOP, TOP:], self.pairs[TOP:, TOP] = True, True
        for p in self.id:
            at = self.places(p)
            self.pairs[at[:-1], at[1:]] = True
        if self.pairs[10].any() or self.pairs[:, 10].any():
            raise ValueError("a piece has a line feed beside another character: segments can't be checked one by one")
        self.before = self.library.encode("\n")  # what a line feed leaves before a segment

    @staticmethod
    def places(text: str) -> np.ndarray:
        """Each character's place in the table of pairs."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(c == ord(MARK), TOP + 1, np.minimum(c, TOP))

    def encode_segment(self, segment: str) -> list[int]:
        """The agenda: scores of the pairs of neighbours that form a piece, best first, then leftmost."""
        symbols, score = list(segment), self.score.get
        if len(symbols) <= SHORT:
            agenda = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                symbols[i] += symbols.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = score(symbols[i] + symbols[i + 1], NEVER)
                if i:
                    agenda[i - 1] = score(symbols[i - 1] + symbols[i], NEVER)
        else:
            symbols = self.long_agenda(symbols)
        own = self.id.get
        out: list[int] = []
        for x in symbols:
            if (i := own(x)) is not None:
                out.append(i)
            else:
                out += [self.byte[b] for b in x.encode()] if self.byte else [self.unknown]
        return out

    def long_agenda(self, symbols: list[str]) -> list[str]:
        """The same with a heap and a linked list, where entries of pairs that are gone are skipped: n log n steps."""
        score, end = self.score.get, len(symbols)
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        agenda = [(s, i, p) for i in range(end - 1) if (s := score(p := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= end or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (s := score(p := piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (s, i, p))
            if (h := before[i]) >= 0 and (s := score(p := symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (s, h, p))
        return [x for x in symbols if x]

    def decode_segment(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.surface.__getitem__, ids)).replace(MARK, " ")
        except KeyError:  # bytes, or no piece at all
            raw = [self.raw[i] if i in self.raw else self.surface.get(i, " ⁇ ").encode() for i in ids]
            return b"".join(raw).decode("utf-8", "replace").replace(MARK, " ")

    def learn(self, segments: list[str]) -> None:
        """Segments go to the library after a line feed, whose ids come first in what it returns."""
        found, skip = {}, len(self.before)
        for x, theirs in zip(segments, self.library.encode(["\n" + x.replace(MARK, " ") for x in segments], num_threads=1)):
            own = self.encode_segment(x.replace(" ", MARK))
            differ = 0
            if theirs[skip:] != own:
                own, differ = theirs[skip:], 1
            found[x] = (array("i", own).tobytes(), self.decode_segment(own), differ)
        self.recent.add(found, sum(len(v[0]) + len(v[1]) for v in found.values()))

    def cut(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of all segments in UTF-8 bytes, with an empty one at the end of each text; a space is a mark."""
        starts, lead, wide, code = characters(data)
        at = lead.astype(np.intp)
        at[wide] = np.minimum(code, TOP)
        at[wide[code == ord(MARK)]] = TOP + 1
        at[lead == ord(" ")] = TOP + 1
        cuts = np.r_[True, ~self.pairs.ravel()[at[:-1] * (TOP + 2) + at[1:]]][: len(at)]
        cuts[np.searchsorted(starts, ends[:-1][np.diff(ends) > 0])] = True
        return closed(starts[cuts], ends)

    def encode(self, column: pa.Array) -> tuple[pa.ListArray, pa.StringArray, np.ndarray]:
        """Ids, decoded text, and segments for which the library had other ids."""
        data, ends = utf8(column)
        full = np.diff(ends) > 0
        shift = np.r_[0, np.cumsum(full)]
        data, ends = np.insert(data, ends[:-1][full], ord(" ")), ends + shift  # the dummy prefix
        at = self.cut(data, ends)
        heads = np.r_[0, np.flatnonzero(np.diff(at) == 0) + 1]  # the first segment of each text
        words, which = distinct(data, at)
        if new := self.recent.look({x for x in words if x}):
            self.learn(new)
        young = self.recent.young
        found = [young[x] if x else (b"", "", 0) for x in words]
        self.recent.settle()
        _, places, raw = pa.array([x[0] for x in found], pa.binary()).take(which).buffers()
        places = np.frombuffer(places, "<i4")[heads] // 4
        ids = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(raw or b"", "<i4", places[-1])))
        _, places, raw = pa.array([x[1] for x in found], pa.string()).take(which).buffers()
        places = np.frombuffer(places, "<i4")[heads]
        raw = np.delete(np.frombuffer(raw or b"", np.uint8, places[-1]), places[:-1][full])  # without what the prefix decodes to
        decoded = pa.StringArray.from_buffers(len(full), pa.py_buffer((places - shift).astype(np.int32)), pa.py_buffer(raw))
        differ = np.r_[0, np.cumsum(np.array([x[2] for x in found], np.int64)[which.to_numpy()])]
        differ = np.diff(differ[heads])
        if len(full) and (theirs := self.library.encode(data[1 : ends[1]].tobytes().decode())) != ids[0].as_py():
            ids = pa.concat_arrays([pa.array([theirs], ids.type), ids[1:]])
            decoded = pa.concat_arrays([pa.array([self.library.decode(theirs)], pa.string()), decoded[1:]])
            differ[0] += 1
        return ids, decoded, differ


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One for each worker process, kept between tasks."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids array<int>, decoded string and n_differ long; nothing is shuffled."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "decoded", "n_differ")])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType()), T.StructField("n_differ", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches, SLICE):
            ids, decoded, differ = m.encode(b.column(at))
            yield pa.record_batch([*b.columns, ids, decoded, pa.array(differ)], names=[*b.schema.names, "ids", "decoded", "n_differ"])

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of what encode() gives."""
    return [F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", encoded["ids"].cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    out = encode(docs.select("doc_id", "text"), path or vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", *digests(out), "n_differ")
