"""Operator 7: near duplicates by ProbMinHash over weighted word shingles.

A text's elements are its shingles of five words (a shorter text is one shingle), weighted by their number. Each
element sends the arrivals of a Poisson process with its weight as rate to random positions of the signature; a position keeps
the earliest, and an element stops once its next arrival is later than all positions hold. Two texts agree in a position
with the probability Jaccard similarity of their weighted shingles. A text with repeated shingles has a second signature, in which every
shingle counts once and positions agree with the plain Jaccard similarity of the sets; without repeats both would be the
same. Equal bands, of either signature, make candidates, and those that agree enough in one of the two are compared exactly: texts link if their probability Jaccard, or the plain Jaccard of their shingle sets, is at least threshold.

Texts with the same words (by 128 bits) are one class, and one of them stands for all. Classes that share
buckets, directly or through others, are a family. A task takes a family and compares two members of a bucket unless links connect
them already, so near copies need about one comparison each. A family above GROUP is dealt into blocks, twice in different
ways; members of its buckets that are still apart from the bucket's main component are then compared with the members of all others, block
against block or, where they are few, as pairs. So every two members of a bucket are compared or connected. The class is the connected component of the links.

Cases: a text without words, or null, is a class of its own; a null doc_id counts as the smallest id; rows with one doc_id are
judged by their own texts, repeated rows alike; of several texts of the smallest doc_id in a class the first row read stands for it;
a very long text is one element array in one task and takes some fifty times its size; an empty table gives an empty one; other columns stay in keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise, slices, texts, unused
from hourloom.llm.components import components

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
POSITIONS = BANDS * ROWS
#: Bytes of text that a task turns into signatures at once: their elements take some fifty times as much for a moment.
SLICE = 1 << 20
#: Most texts of a family that one task compares among each other.
GROUP = 512
#: Pairs whose signatures agree in less than this share are not compared: five standard deviations below the threshold.
AGREE = 0.8 - 5 * (0.8 * 0.2 / POSITIONS) ** 0.5
NULL_ID = -(1 << 63)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


class Shingler:
    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        of = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
        return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """Distinct shingles in order, their numbers, and 128 bits of the words."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64), (0, 0)
        h = self.hashes(words)
        raw = h.tobytes()
        whole = (xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63))
        n = max(1, len(h) - WORDS + 1)
        s = np.zeros(n, np.uint64)
        for i in range(min(WORDS, len(h))):
            s = mix(s * P1 + h[i : i + n])
        own, count = np.unique(s, return_counts=True)
        return own, count, whole


def signatures(each: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash: for each text with elements, the element that each position holds."""
    sizes = [len(s) for s, _ in each]
    doc = np.repeat(np.arange(len(each)), sizes)
    s = np.concatenate([s for s, _ in each]) if each else np.empty(0, np.uint64)
    w = np.concatenate([c for _, c in each]).astype(float) if each else np.empty(0)
    best, owner = np.full(len(each) * POSITIONS, np.inf), np.zeros(len(each) * POSITIONS, np.uint64)
    t = np.zeros(len(s))
    arrival = 0
    while len(s):
        arrival += 1
        r = mix(s + np.uint64(arrival * int(P1) % (1 << 64)))
        t = t - np.log(((r >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)) / w
        at = doc * POSITIONS + (mix(r ^ P3) % np.uint64(POSITIONS)).astype(np.int64)
        np.minimum.at(best, at, t)
        won = best[at] == t
        owner[at[won]] = s[won]
        docs, inverse = np.unique(doc, return_inverse=True)
        go = t < best.reshape(-1, POSITIONS)[docs].max(1)[inverse]
        s, w, t, doc = s[go], w[go], t[go], doc[go]
    return owner.reshape(-1, POSITIONS)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of elements a, b (sorted, distinct) with weights x, y."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    if (x == 1).all() and (y == 1).all():
        return plain, plain
    x, y = x.astype(float), y.astype(float)
    # For a shared element of ratio q = x / y, the sum over all of max(x_u, y_u q) is that of x where x_u / y_u >= q and of q y elsewhere.
    q = x[i] / y[j]
    order = np.argsort(q)
    q, xs, ys = q[order], x[i][order], y[j][order]
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    first = np.searchsorted(q, q, "left")
    high = np.r_[np.cumsum(xs[::-1])[::-1], 0.0][first]
    low = np.r_[0.0, np.cumsum(ys)][first]
    return float((xs / (only_x + high + q * (only_y + low))).sum()), plain


def plain_signatures(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have repeated shingles, and the signatures of these with every shingle counted once."""
    which = np.flatnonzero([bool((c > 1).any()) for _, c in each])
    return which, signatures([(each[i][0], np.ones_like(each[i][1])) for i in which])


def short(sig: np.ndarray) -> np.ndarray:
    return (sig >> np.uint64(32)).astype("<u4")


def banded(sig: np.ndarray) -> np.ndarray:
    """A hash of each band's positions, and of which band it is."""
    bands = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        bands = mix(bands * P1 + sig[:, r::ROWS])
    return bands.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc (the id, null: NULL_ID), raw (a hash of the text), h1 and h2 (128 bits of the words), n shingles and bands (of both signatures), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in slices(batches, SLICE):
            found = [shingler.shingles(t) for t in texts(b.column(2))]
            n = np.array([len(s) for s, _, _ in found], np.int64)
            each = [(s, c) for s, c, _ in found]
            bands = np.zeros((len(found), BANDS), np.int64)
            bands[n > 0] = banded(signatures([x for x in each if len(x[0])]))
            bands = list(bands)
            which, second = plain_signatures(each)
            for i, more in zip(which, banded(second)):
                bands[i] = np.r_[bands[i], more]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([h[0] for _, _, h in found], pa.int64()), pa.array([h[1] for _, _, h in found], pa.int64()), pa.array(n), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "raw", "h1", "h2", "n", "bands"])

    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("raw"), "text")
    return ids.mapInArrow(run, "doc long, raw long, h1 long, h2 long, n long, bands array<long>")


def profiles(docs: DataFrame, family: DataFrame) -> DataFrame:
    """node, family, signature, bands, shingles and counts (8 and 4 bytes each) and the plain signature and its bands (counts and these empty if all counts are 1) of the nodes in family(doc, h1, h2, node, family), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in slices(batches, SLICE):
            rows = [(n, f, *shingler.shingles(t), (h, k)) for n, f, h, k, t in zip(*[b.column(i).to_pylist() for i in range(4)], texts(b.column(4)))]
            rows = [r for r in rows if r[4] == r[5]]  # a doc_id's other texts aren't of the node
            each = [(r[2], r[3]) for r in rows]
            sig = signatures(each)
            plain, plain_bands = [b""] * len(rows), [[]] * len(rows)
            which, second = plain_signatures(each)
            for i, x, k in zip(which, short(second), banded(second)):
                plain[i], plain_bands[i] = x.tobytes(), k
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([x.tobytes() for x in short(sig)], pa.binary()),
                    pa.array(list(banded(sig)), pa.list_(pa.int64())),
                    pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    pa.array([b"" if (r[3] == 1).all() else r[3].astype("<u4").tobytes() for r in rows], pa.binary()),
                    pa.array(plain, pa.binary()),
                    pa.array(plain_bands, pa.list_(pa.int64())),
                ],
                names=["node", "family", "sig", "bands", "shingles", "counts", "plain_sig", "plain_bands"],
            )

    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("doc"), "text")
    # Both sides grow with the corpus: the same plan at every size.
    joined = ids.join(family.hint("merge"), "doc").select("node", "family", "h1", "h2", "text")
    every = joined.mapInArrow(run, "node long, family long, sig binary, bands array<long>, shingles binary, counts binary, plain_sig binary, plain_bands array<long>")
    return every.dropDuplicates(["node"])  # repeated rows of a document are one member


def profile(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(shingles, np.uint64)
    return own, np.frombuffer(counts, "<u4") if counts else np.ones(len(own), np.uint32)


def similar(x: tuple, y: tuple, threshold: float) -> bool:
    return max(probability_jaccard(*profile(*x), *profile(*y))) >= threshold


def agreement(x: tuple[bytes, bytes], y: tuple[bytes, bytes]) -> float:
    """The larger agreement of signatures and of plain signatures (empty: the same as the signature)."""
    equal = lambda p, q: float((np.frombuffer(p, "<u4") == np.frombuffer(q, "<u4")).mean())
    first = equal(x[0], y[0])
    return max(first, equal(x[1] or x[0], y[1] or y[0])) if x[1] or y[1] else first


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def connect(t: pa.Table, threshold: float, agree: float) -> pa.Table:
    """Links that connect the rows of one group: every two rows that share a band are compared unless links connect them already.

    Rows of side 0 and 1 are compared across only. A row meets all candidates of a bucket at once: the shingles of the row are marked,
    and the marks are summed over the candidates' shingles; pairs with repeated shingles get the weighted measure too."""
    node, label, side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
    held = list(zip(t.column("shingles").to_pylist(), t.column("counts").to_pylist()))
    sizes = np.array([len(s) // 8 for s, _ in held])
    weighted = np.array([bool(c) for _, c in held])
    dense = np.unique(np.frombuffer(b"".join([s for s, _ in held]), np.uint64), return_inverse=True)[1]
    repeats = np.flatnonzero(weighted)
    plain_sig = sig.copy()
    plain_sig[repeats] = np.frombuffer(b"".join(t.column("plain_sig").to_pylist()), "<u4").reshape(-1, POSITIONS)
    own = np.split(dense, np.cumsum(sizes)[:-1])
    marks = np.zeros(len(dense) + 1, np.int32)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    # The bands of both signatures, and the rows that they are of.
    bands = np.concatenate([bands, t.column("plain_bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)])
    of = np.r_[np.arange(len(node)), repeats]
    root = np.unique(label, return_inverse=True)[1]
    across = bool((side != side[0]).any())
    met = np.zeros((len(node), len(node)), bool)  # a group holds two blocks at most
    a, b = [], []
    for k in range(BANDS):
        order = np.argsort(bands[:, k], kind="stable")
        keys = bands[order, k]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        for i, j in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            bucket = of[order[i:j]]
            if len(repeats):
                bucket = np.unique(bucket)
            for place in range(1, len(bucket)):
                x, before = int(bucket[place]), bucket[:place]
                others = before[(root[before] != root[x]) & ~met[x, before] & ((side[before] != side[x]) if across else True)]
                if not len(others):
                    continue
                met[x, others] = met[others, x] = True
                near = (sig[others] == sig[x]).mean(1)
                if weighted[x] or weighted[others].any():
                    near = np.maximum(near, (plain_sig[others] == plain_sig[x]).mean(1))
                others = others[near >= agree]
                if not len(others):
                    continue
                marks[own[x]] = 1
                both = np.add.reduceat(marks[np.concatenate([own[y] for y in others])], np.cumsum(sizes[others]) - sizes[others])
                marks[own[x]] = 0
                plain = both >= threshold * (sizes[x] + sizes[others] - both)
                for y, ok in zip(others.tolist(), plain.tolist()):
                    if root[x] == root[y]:
                        continue
                    if not ok and (weighted[x] or weighted[y]):
                        ok = similar(held[x], held[y], threshold)
                    if ok:
                        a.append(int(node[x]))
                        b.append(int(node[y]))
                        root[root == root[y]] = root[x]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)


def compared(pairs: DataFrame, held: DataFrame, threshold: float, agree: float) -> DataFrame:
    """The pairs a, b that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            rows = zip(*[c.column(i).to_pylist() for i in range(2, 10)])
            ok = [agreement((p, u), (q, v)) >= agree and similar((s, x), (t, y), threshold) for p, s, x, u, q, t, y, v in rows]
            yield c.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    names = ("sig", "shingles", "counts", "plain_sig")
    side = lambda x: held.select(F.col("node").alias(x), *[F.col(n).alias(f"{n}_{x}") for n in names]).dropDuplicates([x])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{n}_{x}" for x in "ab" for n in names])
    return both.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, firsts: DataFrame, threshold: float, agree: float, group: int = GROUP) -> DataFrame:
    """node and component of the texts in firsts (node, doc, h1, h2, bands: one row per text with words) that link with others."""
    rows = firsts.select("node", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last")
    total = firsts.count()
    buckets = materialise(buckets.select("key", "leader"), "buckets", 2 * BANDS * total)
    members = materialise(rows.join(buckets, "key").distinct(), "members", 2 * BANDS * total)
    few = members.count()
    # Candidates: what shares buckets, directly or through others, is a family.
    tree = materialise(components(members.select(F.col("node").alias("a"), F.col("leader").alias("b")), few), "tree", few)
    family = tree.select("node", F.col("component").alias("family")).union(tree.select(F.col("component").alias("node"), F.col("component").alias("family")).distinct())
    held = materialise(profiles(docs, materialise(firsts.drop("bands").join(family, "node"), "families", total)), "profiles")
    sizes = materialise(held.groupBy("family").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > group), "large-families", total)

    def blocks(frame: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(seed), "node"), F.coalesce(F.ceil(F.col("m") / group), F.lit(1)))
        grouped = frame.withColumns({"block": block, "side": F.lit(0)}).groupBy("family", "block")
        return materialise(grouped.applyInArrow(lambda t: connect(t, threshold, agree), "a long, b long"), "found")

    found = blocks(held.join(sizes, "family", "left").withColumn("label", F.col("node")), 1)
    if not sizes.limit(1).count():
        return materialise(components(found, total), "components", total)
    # Families above the size of a group were compared within blocks: again in other blocks, which joins most, and then the rest.
    large = materialise(held.join(sizes, "family"), "large")
    found = found.union(blocks(large.withColumn("label", F.col("node")), 2))
    known = materialise(components(found, 2 * total), "components", total)
    label = lambda frame: frame.join(known.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = members.join(large.select("node", "family", "m").distinct(), "node").select("key", "node", "family", "m")
    own = materialise(label(own), "labelled", few)
    most = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("x"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    most = materialise(most.select("key", F.col("x.label").alias("main"), "size"), "main", few)
    apart = materialise(own.join(most, "key"), "apart", few)
    # Families with more pairs left than block pairs have rows are compared block against block, the others pair by pair.
    left = apart.filter("label <> main").groupBy("family").agg(F.sum("size").alias("pairs"), F.max("m").alias("m"))
    left = materialise(left.withColumns({"n": F.ceil(F.col("m") / group).cast("int"), "dense": 2 * F.col("pairs") > F.col("m") * F.ceil(F.col("m") / group)}), "left", total)
    block = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("n")).cast("int")
    dealt = label(large.drop("m").join(left.filter("dense").select("family", "n"), "family")).withColumn("own", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter("own <> other")
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    rest = materialise(dealt.groupBy("family", "low", "high").applyInArrow(lambda t: connect(t, threshold, agree), "a long, b long"), "found")
    sparse = apart.join(left.filter("NOT dense").select("family"), "family", "left_semi")
    outer = sparse.filter("label <> main").select("key", F.col("node").alias("x"), F.col("label").alias("label_x"))
    pairs = sparse.join(outer, "key").filter("label <> label_x").select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
    rest = rest.union(materialise(compared(materialise(pairs, "pairs"), large, threshold, agree), "found"))
    return materialise(components(found.union(rest), 3 * total), "components", total)


def judged(docs: DataFrame, threshold: float = THRESHOLD, agree: float = AGREE, group: int = GROUP) -> DataFrame:
    """One row per row of docs: doc_id, raw (xxhash64 of its text), class_id (the smallest doc_id of its class), n_shingles, and
    first, which is true for one row of each class: of the rows of class_id with the class's first text."""
    sketches = materialise(sketch(docs).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    total = sketches.count()
    # One row per text with words, by all 128 bits; the least row number names it.
    least = F.min(F.struct("doc", "rid"))
    firsts = sketches.filter("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("node"), least.alias("least"), F.first("bands").alias("bands"))
    firsts = materialise(firsts.select("h1", "h2", "node", F.col("least.doc").alias("doc"), F.col("least.rid").alias("rid"), "bands"), "texts")
    known = link(docs, firsts.drop("rid"), threshold, agree, group)
    named = materialise(firsts.drop("bands").join(known, "node", "left").select("h1", "h2", "doc", "rid", F.coalesce("component", "node").alias("root")), "named", total)
    classes = materialise(named.groupBy("root").agg(F.min(F.struct("doc", "rid")).alias("least")), "class-firsts", total)
    named = materialise(named.join(classes, "root").select("h1", "h2", F.col("least.doc").alias("class"), F.col("least.rid").alias("kept")), "named-classes", total)
    out = sketches.drop("bands").join(named, ["h1", "h2"], "left")
    out = out.withColumns({"class": F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc")), "first": F.when(F.col("n") > 0, F.col("rid") == F.col("kept")).otherwise(F.lit(True))})
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), "raw", real("class").alias("class_id"), F.col("n").alias("n_shingles"), "first")


def classes(docs: DataFrame, threshold: float = THRESHOLD, agree: float = AGREE, group: int = GROUP) -> DataFrame:
    """One row per row of docs: doc_id, class_id and n_shingles."""
    return judged(docs, threshold, agree, group).drop("raw", "first")


def is_kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class: of its smallest doc_id, and of that document's rows with the class's first text; rows without words stay, one for each doc_id and text.

    Texts aren't shuffled but where rows repeat doc_id and text and one of them stays; there the least hash of all columns decides."""
    marks = judged(docs, threshold).groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first"))
    marks = materialise(marks.filter("NOT first OR n > 1"), "marks")
    same = lambda m: docs["doc_id"].eqNullSafe(m["doc_id"]) & (F.xxhash64(docs["text"]) == m["raw"])
    alone = docs.join(marks, same(marks), "left_anti")
    again = marks.filter("first")
    if not again.limit(1).count():
        return alone
    raw, row = unused(docs.columns, "raw", "row")
    some = docs.join(again, same(again), "left_semi").withColumn(raw, F.xxhash64("text"))
    return alone.union(some.groupBy("doc_id", raw).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)).select(f"{row}.*"))


def query(docs: DataFrame) -> DataFrame:
    return classes(docs).withColumn("kept", is_kept())
