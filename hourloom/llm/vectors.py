"""Operator 2: near-duplicate embeddings by product quantisation.

Vectors with equal components are one class with a count. A bounded sample fits coarse centroids and, in SUBSPACES parts of the
residuals, codebooks; every class is then in the list of its nearest centroid, with its codes and the length of what
the codes miss. A partner at cosine least lies within the radius sqrt(2 - 2 least). Where it is in another list, the distances of both
to the border of the two lists add up to at most that, so one of them lies within half the radius: as a query a class probes the lists
whose border is that near, whatever directions the vectors span, and a link that one side alone probes counts for both. In a list,
distances to codes come from a table per subspace and query; a code farther than the radius plus what it misses can't be a link, so
this filter loses none either. The rest is compared by exact cosine in doubles.

Lists and their queries are dealt in blocks of bounded size, each pair of blocks a group, so a list with a third of all vectors
covers many tasks. A group returns for each vector the number of links that it counts there, weighted by the classes' counts, and the root of its
links inside the group; no pair leaves it.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths have
no cosine, so each length has an index and lists of its own; a null vec_id counts as the smallest id and comes back null; repeated
rows are vectors of their own and link with each other; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise
from hourloom.llm.components import components

LEAST, SAMPLE, PER_LIST, LISTS, SUBSPACES, CODES = 0.95, 20_000, 512, 4096, 8, 64
BLOCK, QUERIES, CHUNK = 2048, 4096, 256
NULL_ID = -(1 << 63)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


@dataclass
class Index:
    centroids: np.ndarray
    cuts: list[int]  # of the subspaces
    books: list[np.ndarray]
    between: np.ndarray  # distances of centroids

    @staticmethod
    def fit(sample: np.ndarray, lists: int, seed: int = 2) -> Index:
        rng = np.random.default_rng(seed)
        c = kmeans(sample, lists, 10, rng)
        rest = sample - c[nearest(sample, c)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
        books = [kmeans(rest[:, a:b], CODES, 8, rng) for a, b in zip(cuts, cuts[1:])]
        return Index(c, cuts, books, np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(2), 0)) if len(c) <= 512 else np.stack([np.sqrt(((c - y) ** 2).sum(1)) for y in c]))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of what the codes miss."""
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.stack([nearest(rest[:, a:b], k) for a, b, k in zip(self.cuts, self.cuts[1:], self.books)], 1)
        back = np.concatenate([k[codes[:, i]] for i, k in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Whether a list's border to the own list lies within half the radius; rounding errors only add lists."""
        d = (self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T
        share = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * self.between[own], 1e-6)
        near = share <= radius / 2 + 1e-6
        near[np.arange(len(x)), own] = True
        return near

    def table(self, q: np.ndarray, which: int) -> list[np.ndarray]:
        """Squared distances of queries' residuals to each subspace's codes."""
        rest = q - self.centroids[which]
        return [((rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ k.T + (k * k).sum(1)).astype(np.float32) for a, b, k in zip(self.cuts, self.cuts[1:], self.books)]


def unit(raw: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = (raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a, b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def compare(table: pa.Table, index: Index, least: float, width: int) -> pa.Table:
    """One group: list rows (side 0) and queries (side 1) of a list. Gives node, n and root of those with links."""
    which = table.column("list")[0].as_py()
    side = table.column("side").to_numpy()
    rows, queries = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    empty = pa.table({k: pa.array([], pa.int64()) for k in ("node", "n", "root")})
    if not len(rows) or not len(queries):
        return empty
    x, q = unit(rows.column("embedding"), width), unit(queries.column("embedding"), width)
    xi, qi = rows.column("node").to_numpy(), queries.column("node").to_numpy()
    weight, asked = rows.column("m").to_numpy(), queries.column("m").to_numpy()
    home = queries.column("home").to_numpy()
    probed = np.unpackbits(np.frombuffer(b"".join(rows.column("probed").to_pylist()), np.uint8).reshape(len(x), -1), 1)
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
    reach = ((2 - 2 * least) ** 0.5 + rows.column("missed").to_numpy() + 1e-3).astype(np.float32) ** 2
    counted, back, links = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64), []
    nodes, inverse = np.unique(np.r_[xi, qi], return_inverse=True)
    root = np.arange(len(nodes))
    for i in range(0, len(q), CHUNK):
        part = q[i : i + CHUNK]
        d = np.zeros((len(part), len(x)), np.float32)
        for j, t in enumerate(index.table(part, which)):
            d += t[:, codes[:, j]]
        a, b = np.nonzero(d <= reach)
        # The same sum for a pair whatever the group.
        cosine = np.concatenate([np.einsum("ij,ij->i", part[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)]) if len(a) else np.empty(0)
        ok = (cosine >= least) & (qi[i + a] != xi[b])
        a, b = a[ok], b[ok]
        counted[i : i + CHUNK] = np.bincount(a, weight[b], len(part)).astype(np.int64)
        alone = probed[b, home[i + a]] == 0  # the row doesn't ask for the query's list, so its link counts here
        back += np.bincount(b[alone], asked[i + a[alone]], len(x)).astype(np.int64)
        # Only links that connect something new stay for the roots.
        u, v = inverse[len(x) + i + a], inverse[b]
        new = root[u] != root[v]
        if new.any():
            links.append((u[new], v[new]))
            root = roots(len(nodes), np.concatenate([l[0] for l in links]), np.concatenate([l[1] for l in links]))
            links = [(np.arange(len(nodes)), root)]
    n = np.zeros(len(nodes), np.int64)
    n[inverse[len(x) :]] = counted
    n[inverse[: len(x)]] += back
    some = (n > 0) | (root != np.arange(len(nodes)))
    return pa.table({"node": pa.array(nodes[some]), "n": pa.array(n[some]), "root": pa.array(nodes[root[some]])})


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col("vec_id"), F.lit(NULL_ID)).alias("id"), F.col("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    keyed = materialise(rows.select("id", good.alias("good"), F.when(good, F.xxhash64("embedding")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "embedding")).alias("h2"), F.when(good, F.col("embedding")).alias("embedding")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # Equal vectors by 128 bits; the least row number names them.
    distinct = keyed.filter("good").groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding"))
    distinct = materialise(distinct.withColumn("width", F.size("embedding")), "distinct-vectors")
    widths = sorted(distinct.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each length of vectors
    if widths:
        linked = reduce(DataFrame.union, [link(own := distinct.filter(F.col("width") == w), fit(own, n, w), least, w) for w, n in widths])
        known = materialise(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-components")
        sums = materialise(linked.groupBy("node").agg(F.sum("n").alias("n")), "vector-links")
        both = distinct.select("node", "h1", "h2", "rep", "m").join(sums, "node", "left").join(known, "node", "left")
        both = materialise(both.select("h1", "h2", "rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")), "classes")
        least_id = materialise(both.groupBy("root").agg(F.min("rep").alias("component_id")), "least-ids")
        done = materialise(both.join(least_id, "root").select("h1", "h2", "n_links", "component_id"), "class-results")
    else:
        done = spark.createDataFrame([], "h1 long, h2 long, n_links long, component_id long")
    real = lambda c: F.when(c != NULL_ID, c)
    out = keyed.select("id", "h1", "h2").join(done, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(real(F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), real(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def fit(distinct: DataFrame, total: int, width: int) -> Index:
    """The index of distinct vectors of one length, from a sample of some SAMPLE of them."""
    share = min(1.0, SAMPLE / total)
    sample = distinct.filter(F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.lit(1 << 30)) < share * (1 << 30)).select("node", "embedding").toArrow().sort_by("node")
    if len(sample):
        return Index.fit(unit(sample.column("embedding"), width), max(1, min(LISTS, total // PER_LIST)))
    return Index.fit(unit(distinct.select("embedding").limit(100).toArrow().column("embedding"), width), 1)  # a hash that takes no row of a tiny table


def link(distinct: DataFrame, index: Index, least: float, width: int) -> DataFrame:
    """node, n and root, from every group in which a node has links."""
    held = distinct.sparkSession.sparkContext.broadcast(index)  # bounded by LISTS and CODES
    radius = (2 - 2 * least) ** 0.5

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                x = unit(b.column("embedding"), width)
                own, codes, missed = held.value.assign(x)
                probes = held.value.probes(x, own, radius)
                yield pa.record_batch(
                    [b.column("node"), b.column("m"), b.column("embedding"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed, pa.float64()), pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32())), pa.array([p.tobytes() for p in np.packbits(probes, 1)], pa.binary())],
                    names=["node", "m", "embedding", "list", "codes", "missed", "probes", "probed"],
                )

    kind = dict(distinct.dtypes)["embedding"]
    placed = materialise(distinct.select("node", "m", "embedding").mapInArrow(place, f"node long, m long, embedding {kind}, list int, codes binary, missed double, probes array<int>, probed binary"), "placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
    plan = F.broadcast(materialise(sizes.join(asked, "list"), "blocks"))  # at most LISTS rows
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    stored = placed.join(plan, "list").withColumn("block", block("blocks")).withColumn("part", every("parts")).withColumns({"side": F.lit(0), "home": F.col("list")})
    asking = placed.select("node", "m", "embedding", F.col("list").alias("home"), F.explode("probes").alias("list")).join(plan, "list").withColumn("part", block("parts")).withColumn("block", every("blocks"))
    asking = asking.withColumns({"side": F.lit(1), "codes": F.lit(None).cast("binary"), "missed": F.lit(None).cast("double"), "probed": F.lit(None).cast("binary")})
    names = ["list", "block", "part", "side", "node", "m", "home", "codes", "missed", "probed", "embedding"]
    groups = stored.select(names).union(asking.select(names)).groupBy("list", "block", "part")
    return materialise(groups.applyInArrow(lambda t: compare(t, held.value, least, width), "node long, n long, root long"), "vector-roots")


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
