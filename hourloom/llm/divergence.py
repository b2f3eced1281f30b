"""Operator 11: how the sources of a language differ in their words.

Partitions count terms in radix tries of bytes, a trie per language, whose leaves hold counters by source; tries that grow past LEAVES are
written out, in UTF-8 order, and new ones begin, so memory stays bounded. The written leaves meet by ranges of (language, term), that is of
prefixes, where equal terms' counters are merged and rare terms go. The merged leaves are walked in that order, block by block: the walk adds up
what each pair of sources differs in at the terms that both have, and keeps the first candidates of each source, by value and then by term.

The smoothed share of a term in a group is a whole number p of billionths, and f(p, q) = (p - q)^2 / q, rounded down, in whole
numbers. A pair's sum runs over all kept terms, but most terms are missing from most sources, and a missing term has one p in all of a source (zero).
So the sum is that of V missing terms, corrected by counts of equal p for terms of one source, and by the walk for terms of both; nothing is
dense in sources and terms.

Sums stay below 2^63 up to some ten million kept terms in a language, as all p of a group add up to a billion and their number.

Cases: null lang, source and text count as empty; a group without terms has pairs, of value 0 where its language keeps no term; a language with one source
has no pair; ties go by UTF-8 order; repeated rows are documents each; a very long text is counted in pieces; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import materialise, slices, utf8

LEAST_DOCS, TOP, UNITS = 3, 200, 1_000_000_000
#: Leaves of the tries of a task at once, pairs of sources that a walk holds, terms of a block, pairs of one numpy step, and bytes of a piece of text.
LEAVES, PAIRS, BLOCK, STEP, PIECE = 400_000, 1_000_000, 1 << 14, 1 << 20, 8 << 20
#: Bytes of an edge of a trie, and edges on a way.
EDGE, DEPTH = 8, 4
#: Letters in lower case and all bytes of other characters stay; everything else is a border.
TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Trie:
    """A radix trie in arrays: an edge is eight bytes, filled up with zeros where a term ends (terms hold none), and DEPTH of them lie on a way; what
    is left of a longer term is one edge more. A level has the parent and the edge of each of its nodes, and the number of its leaf where a term ends."""

    def __init__(self):
        self.parent, self.edge = [np.zeros(0, np.int64)] * DEPTH, [np.zeros(0, np.uint64)] * DEPTH
        self.ends = [np.zeros(0, np.int64)] * DEPTH
        self.rest: dict[tuple[int, bytes], int] = {}
        #: Levels and nodes of leaves in the order of their numbers; a leaf with a rest stands below the last level, at its parent.
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        #: Counters of leaves: leaf, source, occurrences and documents, in parts that settle() adds up.
        self.parts: list[np.ndarray] = []

    def down(self, level: int, parent: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to, new ones where need be."""
        old = len(self.parent[level])
        edges = pa.array(np.r_[self.edge[level], edge]).dictionary_encode()  # numbers go by first appearance, so old nodes keep theirs
        most = max(1, len(edges.dictionary))
        ways = pa.array(np.r_[self.parent[level], parent] * most + edges.indices.to_numpy()).dictionary_encode()
        new = ways.dictionary.to_numpy()[old:]
        self.parent[level] = np.r_[self.parent[level], new // most]
        self.edge[level] = np.r_[self.edge[level], edges.dictionary.to_numpy()[new % most]]
        self.ends[level] = np.r_[self.ends[level], np.full(len(new), -1)]
        return ways.indices.to_numpy()[old:].astype(np.int64)

    def place(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Numbers of new leaves."""
        self.leaves.append((np.full(len(nodes), level), nodes))
        self.size += len(nodes)
        return np.arange(self.size - len(nodes), self.size)

    def leaf(self, terms: list[bytes] | pa.Array) -> np.ndarray:
        """The leaves of terms, new ones where need be."""
        terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.binary())
        _, at, data = terms.buffers()
        at = np.frombuffer(at, "<i4")[terms.offset : terms.offset + len(terms) + 1].astype(np.int64) if len(terms) else np.zeros(1, np.int64)
        data = np.r_[np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(EDGE * DEPTH, np.uint8)]
        at -= at[0]
        eight = np.lib.stride_tricks.sliding_window_view(data, EDGE)
        out, own, node = np.empty(len(terms), np.int64), np.arange(len(terms)), np.zeros(len(terms), np.int64)
        for level in range(DEPTH):
            begin, left = at[own] + EDGE * level, at[own + 1] - at[own] - EDGE * level
            spare = (8 * (EDGE - np.minimum(left, EDGE))).astype(np.uint64)
            edge = np.where(left > 0, eight[begin].view(">u8")[:, 0].astype(np.uint64) >> spare << spare, np.uint64(0))
            node = self.down(level, node, edge)
            here = left <= EDGE
            ends, stop = self.ends[level], node[here]
            new = np.unique(stop[ends[stop] < 0])
            ends[new] = self.place(level, new)
            out[own[here]] = ends[stop]
            own, node = own[~here], node[~here]
            if not len(own):
                return out
        for i, parent in zip(own.tolist(), node.tolist()):
            key = parent, data[at[i] + EDGE * DEPTH : at[i + 1]].tobytes()
            if key not in self.rest:
                self.rest[key] = int(self.place(DEPTH, np.array([parent]))[0])
            out[i] = self.rest[key]
        return out

    def add(self, leaf: np.ndarray, source: np.ndarray | int, n: np.ndarray, docs: np.ndarray | int) -> None:
        """Occurrences of terms in sources, and of documents, by the terms' leaves."""
        part = np.empty((4, len(leaf)), np.int64)
        part[0], part[1], part[2], part[3] = leaf, source, n, docs
        self.parts.append(part)
        if sum(p.shape[1] for p in self.parts) > 4 * LEAVES:
            self.settle()

    def settle(self) -> np.ndarray:
        """One counter for each leaf and source."""
        every = np.concatenate(self.parts, 1)
        every = every[:, np.lexsort((every[1], every[0]))]
        first = np.flatnonzero(np.r_[True, (np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)])
        self.parts = [np.concatenate([every[:2, first], np.add.reduceat(every[2:], first, 1)])] if every.shape[1] else [every]
        return self.parts[0]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        terms, leaf = self.ordered()
        return zip(terms.to_pylist(), leaf.tolist())

    def ordered(self) -> tuple[pa.Array, np.ndarray]:
        """Terms and their leaves in the order of bytes, which is that of UTF-8: the edges on the way to each leaf, in order."""
        level, node = (np.concatenate([x[i] for x in self.leaves] or [np.zeros(0, np.int64)]) for i in (0, 1))
        edges = np.zeros((self.size, int(min(level.max(initial=0) + 1, DEPTH))), np.uint64)
        for i in reversed(range(edges.shape[1])):
            own = np.flatnonzero(level >= i)
            edges[own, i] = self.edge[i][node[own]]
            node[own] = self.parent[i][node[own]]
        rest = [b""] * (self.size if self.rest else 0)
        for (_, x), leaf in self.rest.items():
            rest[leaf] = x
        places = {x: i for i, x in enumerate(sorted(set(rest)))}
        order = np.lexsort(([np.array([places[x] for x in rest])] if rest else []) + list(edges.T[::-1]))
        found = edges[order].astype(">u8").view(np.uint8)
        inside = found != 0
        ends = np.r_[0, np.cumsum(inside.sum(1))].astype(np.int32)
        terms = pa.Array.from_buffers(pa.binary(), self.size, [None, pa.py_buffer(ends), pa.py_buffer(found[inside])])
        return pc.binary_join_element_wise(terms, pa.array([rest[i] for i in order.tolist()], pa.binary()), b"") if rest else terms, order


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in parts of bounded size."""
    text = text.translate(TERM_BYTES)
    at = 0
    while len(text) - at > PIECE and (end := text.rfind(b" ", at, at + PIECE)) > at:
        yield text[at:end].split()
        at = end
    yield text[at:].split() if at else text.split()


def cut(data: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts that lie one after another, and the text that each comes from."""
    data = np.frombuffer(data.tobytes().translate(TERM_BYTES), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 32, out=inside[1:-1])
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    between = np.unique(ends)
    between = np.repeat(between[inside[between] & inside[between + 1]], 2)  # a term ends with its text
    borders = np.insert(borders, np.searchsorted(borders, between), between)
    begin, stop = borders[::2], borders[1::2]
    places = np.r_[0, np.cumsum(stop - begin)].astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(data[inside[1:-1]])])
    return terms.dictionary_encode(), np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(begin, ends)))


def counted(terms: np.ndarray, doc: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """group, term, occurrences and documents of each group's different terms; size: how many different terms there are."""
    each, n = np.unique(doc * size + terms, return_counts=True)
    key = group[each // size] * size + each % size
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    if not len(key):
        return first, first, first, first
    return key[first] // size, key[first] % size, np.add.reduceat(n[order], first), np.diff(np.r_[first, len(key)])


def leaves(docs: DataFrame) -> DataFrame:
    """lang, term, source, n and docs: leaves of all tries; each group also has a leaf of the empty term, of which it holds none."""

    def rows(tries: dict[str, Trie], names: list[str]) -> Iterator[pa.RecordBatch]:
        for lang, trie in tries.items():
            terms, order = trie.ordered()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            leaf, source, n, docs = trie.settle()
            leaf = place[leaf]
            by = np.argsort(leaf, kind="stable")
            terms, every = terms.cast(pa.string()), pa.array(names, pa.string())
            for i in range(0, len(by), 50_000):
                own = by[i : i + 50_000]
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(own), np.int32))), terms.take(pa.array(leaf[own])), every.take(pa.array(source[own])), pa.array(n[own]), pa.array(docs[own])]
                yield pa.record_batch(columns, names=["lang", "term", "source", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        tries: dict[str, Trie] = defaultdict(Trie)
        for b in slices(batches):
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            numbers = [number.setdefault(x, len(number)) for x in sources]
            groups = {x: i for i, x in enumerate(dict.fromkeys(zip(langs, numbers)))}
            for lang in dict.fromkeys(langs):  # the group is there, whatever its texts hold
                if not tries[lang].size:
                    tries[lang].leaf([b""])
                own = np.array([x for y, x in groups if y == lang])
                tries[lang].add(np.zeros(len(own), np.int64), own, 0, 0)
            data, ends = utf8(b.column(2))
            long = np.flatnonzero(np.diff(ends) > PIECE)
            for i in long.tolist():
                counts: Counter = Counter()
                for words in pieces(data[ends[i] : ends[i + 1]].tobytes()):
                    counts.update(words)
                tries[langs[i]].add(tries[langs[i]].leaf(list(counts)), numbers[i], np.fromiter(counts.values(), np.int64, len(counts)), 1)
            if len(long):
                keep = np.ones(len(langs), bool)
                keep[long] = False
                data = data[np.repeat(keep, np.diff(ends))]
                ends = np.r_[0, np.cumsum(np.where(keep, np.diff(ends), 0))]
            terms, doc = cut(data, ends)
            found = terms.dictionary
            group, term, n, in_docs = counted(terms.indices.to_numpy().astype(np.int64), doc, np.fromiter(map(groups.__getitem__, zip(langs, numbers)), np.int64, len(langs)), max(1, len(found)))
            every = list(groups)
            for lang in dict.fromkeys(langs):
                own = np.flatnonzero(np.array([x == lang for x, _ in every], bool)[group])
                used = np.unique(term[own])
                leaf = np.zeros(len(found) + 1, np.int64)
                leaf[used] = tries[lang].leaf(found.take(pa.array(used)))
                tries[lang].add(leaf[term[own]], np.array([x for _, x in every], np.int64)[group[own]], n[own], in_docs[own])
            if sum(t.size for t in tries.values()) > LEAVES:
                yield from rows(tries, list(number))
                tries, number = defaultdict(Trie), {}
        yield from rows(tries, list(number))

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(run, "lang string, term string, source string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + UNITS (n + 1) / (total + kept), rounded down, for counts of any size."""
    units = F.lit(UNITS).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", units, (total + kept).cast("decimal(20,0)"))


def away(p: Column, q: Column) -> Column:
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Walk:
    """Adds up pairs and candidates of entries that come in the order of (lang, term)."""

    def __init__(self):
        self.number: dict[tuple[str, str], int] = {}
        self.pairs: dict[tuple[int, int], int] = defaultdict(int)
        self.best: list[pa.Table] = []
        #: The least value by group that a further candidate needs; -1 while there are fewer than TOP.
        self.least = np.zeros(0, np.int64)

    def add(self, t: pa.RecordBatch) -> None:
        """Terms of lang, term, q and entries (source, p and zero)."""
        entries = t.column("entries")
        each = entries.flatten()
        sizes = np.diff(entries.offsets.to_numpy())
        if not len(each):
            return
        row = np.repeat(np.arange(len(sizes)), sizes)
        langs, sources = t.column("lang").dictionary_encode(), each.field("source").dictionary_encode()
        most = len(sources.dictionary)
        met = pa.array(langs.indices.to_numpy()[row].astype(np.int64) * most + sources.indices.to_numpy()).dictionary_encode()
        lang, source = (pa.array(x) for x in np.divmod(met.dictionary.to_numpy(), most))
        names = zip(langs.dictionary.take(lang).to_pylist(), sources.dictionary.take(source).to_pylist())
        own = np.array([self.number.setdefault(x, len(self.number)) for x in names])[met.indices.to_numpy()]
        p, zero, q = each.field("p").to_numpy(), each.field("zero").to_numpy(), t.column("q").to_numpy()[row]
        # Few of a source's shares differ, so pairs are counted by kind, a source and one of its shares.
        kinds = pa.array(own << 31 | p).dictionary_encode()
        kind = kinds.indices.to_numpy().astype(np.int64)
        of = np.empty((3, len(kinds.dictionary)), np.int64)
        of[:, kind] = own, p, zero
        starts, many = np.cumsum(sizes) - sizes, sizes > 1
        starts, sizes = starts[many], sizes[many]
        done = 0
        ends = np.cumsum(sizes.astype(np.int64) ** 2)
        while done < len(starts):  # terms whose pairs fill a step; one term at least
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + STEP, "right")))
            self.both(kind, of, starts[done:stop], sizes[done:stop])
            done = stop
        if len(self.least) < len(self.number):
            self.least = np.r_[self.least, np.full(len(self.number), -1)]
        high = np.flatnonzero(p > q)
        value = far(p[high], q[high])
        good = value >= self.least[own[high]]
        high, value = high[good], value[good]
        if len(high):
            self.keep(pa.table({"group": own[high], "value": value, "term": t.column("term").take(pa.array(row[high]))}))

    def both(self, kind: np.ndarray, of: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Of all pairs of entries of a term: what the sum for terms of one source each gets wrong. Blocks of one entry's row, so a term of very many sources fits too."""
        first = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # each entry
        width, start, kinds = np.repeat(sizes, sizes), np.repeat(starts, sizes), of.shape[1]
        for i in range(0, len(first), max(1, STEP // int(sizes.max()))):
            rows = slice(i, i + max(1, STEP // int(sizes.max())))
            n = width[rows]
            key = np.repeat(kind[first[rows]] * kinds, n) + kind[np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            if kinds * kinds <= 4 * STEP:
                times = np.bincount(key)
                key = np.flatnonzero(times)
                times = times[key]
            else:
                key, times = np.unique(key, return_counts=True)
            (own, p, zero), (item, q, none) = of[:, key // kinds], of[:, key % kinds]
            value = (far(p, q) - far(p, none) - far(zero, q) + far(zero, none)) * times
            key = np.where(own != item, own * len(self.number) + item, -1)  # -1: an entry with itself
            order = np.argsort(key, kind="stable")
            keys, at = np.unique(key[order], return_index=True)
            for k, v in zip(keys.tolist(), np.add.reduceat(value[order], at).tolist()):
                if k >= 0:
                    self.pairs[divmod(k, len(self.number))] += v

    def keep(self, found: pa.Table) -> None:
        self.best.append(found)
        if sum(x.num_rows for x in self.best) > STEP // 4:
            self.settle()

    def settle(self) -> None:
        """The first TOP candidates of each group, by value and then by term."""
        if self.best:
            t = pa.concat_tables(self.best).sort_by([("group", "ascending"), ("value", "descending"), ("term", "ascending")])
            group = t.column("group").to_numpy()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            last = np.flatnonzero(rank == TOP - 1)
            self.least[group[last]] = t.column("value").to_numpy()[last]
            self.best = [t.take(pa.array(np.flatnonzero(rank < TOP)))]

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = list(self.number)

        def batch(part: str, groups: list[int], items: pa.Array, values: list[int]) -> pa.RecordBatch:
            own = [names[g] for g in groups]
            return pa.record_batch([pa.array([part] * len(own), pa.string()), pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.string()), items, pa.array(values, pa.int64())], names=["part", "lang", "source", "item", "value"])

        if self.pairs:
            yield batch("pair", [a for a, _ in self.pairs], pa.array([names[b][1] for _, b in self.pairs], pa.string()), list(self.pairs.values()))
        self.settle()
        for t in self.best:
            for b in t.to_batches(50_000):
                yield batch("term", b.column(0).to_pylist(), b.column(2), b.column(1).to_pylist())


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Walk()
    for b in batches:
        own.add(b)
        if len(own.pairs) > PAIRS or len(own.number) > PAIRS // TOP:
            yield from own.rows()
            own = Walk()
    yield from own.rows()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank."""
    counted = materialise(leaves(docs), "leaves")
    # Ranges of (lang, term) hold all leaves of a term; both groupings run within them.
    merged = counted.filter("term <> ''").repartitionByRange("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    merged = merged.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries")).filter(F.col("docs") >= LEAST_DOCS).sortWithinPartitions("lang", "term")
    block = F.concat_ws(":", F.spark_partition_id(), F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK))
    kept = materialise(merged.select("lang", "term", "total", "entries", block.alias("block")), "terms")
    entries = kept.select("lang", "block", "term", "total", F.explode("entries").alias("e")).select("lang", "block", "term", "total", "e.source", "e.n")
    # A row per language, and one per group.
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    alike = materialise(entries.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")), "counts")
    totals = alike.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("own"))
    groups = counted.filter("term = ''").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["v", "all", "own"])
    zero = F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("own"), F.col("v")))
    groups = materialise(groups.withColumn("zero", zero), "groups")

    shared = entries.join(groups, ["lang", "source"]).select("lang", "block", "term", share(F.col("total"), F.col("all"), F.col("v")).alias("q"), "source", share(F.col("n"), F.col("own"), F.col("v")).alias("p"), "zero")
    # Blocks are prefix ranges; a file holds some of them in order, so a walk over files is one in UTF-8 order, and small files share a walk.
    terms = shared.repartition("lang", "block").groupBy("lang", "block", "term", "q").agg(F.collect_list(F.struct("source", "p", "zero")).alias("entries"))
    terms = materialise(terms.sortWithinPartitions("lang", "term").select("lang", "term", "q", "entries"), "shares")
    walked = materialise(terms.mapInArrow(walk, "part string, lang string, source string, item string, value long"), "walked")

    # Terms of one source of a pair: a row per source and count, so as many as a source has different counts.
    alike = alike.join(groups, ["lang", "source"]).select("lang", "source", share(F.col("n"), F.col("own"), F.col("v")).alias("p"), "zero", "times")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("none"))
    met = alike.join(other, "lang").filter("source <> item")
    exact = lambda x: F.col("times").cast("decimal(18,0)") * x.cast("decimal(19,0)")
    p, own, none = F.col("p"), F.col("zero"), F.col("none")
    forth = exact(away(p, none) - away(own, none))
    back = exact(away(none, p) - away(none, own))
    one = met.select("lang", F.explode(F.array(F.struct("source", "item", forth.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value")))).alias("x")).select("lang", "x.*")
    both = walked.filter("part = 'pair'").select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    sums = one.withColumn("value", F.col("value").cast("decimal(38,0)")).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("sum"))
    pairs = groups.select("lang", "source", "v", "zero").join(other, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    missing = F.when(F.col("v") > 0, F.col("v").cast("decimal(18,0)") * away(own, none).cast("decimal(19,0)")).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (missing + F.coalesce("sum", F.lit(0).cast("decimal(38,0)"))).cast("bigint").alias("value"))
    found = pairs.union(walked.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


def query(docs: DataFrame) -> DataFrame:
    return audit(docs)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = f"1 + ({UNITS}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY {{0}}) + v)"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, term, n, {SHARE.format("lang, source")} AS p FROM (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term) JOIN v USING (lang)),
l AS (SELECT lang, term, {SHARE.format("lang")} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x) WHERE part = 'pair' OR rank <= {TOP}"""
