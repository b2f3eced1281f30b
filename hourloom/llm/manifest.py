"""Operator 12: a Merkle manifest of a dataset, with coordinate lookup proofs.

Each row's fields become a leaf. The leaves of a language, in the order of doc_id, are an own tree: WIDTH consecutive nodes become their
hash until one node, the subroot, remains; subroots, in the order of languages, make the tree of the root. Trees are built in tiers of DEPTH
levels: a block of WIDTH ** DEPTH neighbours is one group, which gives all nodes that lie above it in the tier, so each tier is one shuffle of
its own lowest level and the next one has so many times fewer rows. Places of leaves come from range partitions and their counts,
so no language is sorted in one task.

A proof needs no walk: from a leaf's place and its language's size follow the coordinates (level, place) of all siblings. Leaves explode them, join the
written table of nodes, gather what was found in order, and continue with the proof of their block, which the tier above made the same
way. A sibling is asked for by a block's leaves at most, so no node is a hot key, whatever the size of a language. Folding a leaf with its
siblings gives the root again, unless the leaf was tampered with.

Cases: null fields are part of the leaf (-), a null text isn't an empty one; a null lang is a language of its own, the first; rows with one doc_id are in
the order of their leaves, null doc_ids come first, equal rows are leaves each; a language of one row has its leaf as subroot; a proof without
siblings is the hash of nothing; n_chars at the largest number becomes null when tampered with; a very long text is hashed by one
task; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import materialise

WIDTH, DEPTH = 2, 8
#: Levels of the tree of subroots follow all those of a language's tree.
ABOVE = 1000


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_of(node: Column) -> Column:
    """Tables hold digests as bytes; they are concatenated as lowercase hex."""
    return F.lower(F.hex(node))


def leaf_of(**changed: Column) -> Column:
    """Digest of a document's fields, each as its length in bytes and its value."""
    fields = [changed.get(c, F.col(c)).cast("string") for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in fields]))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, the place from 0 within the group by order, and n, the group's rows.

    A range partition knows its own order; what lies before it in its group is a sum over one row per partition and group."""
    apart = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    apart = materialise(apart.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    each = apart.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy(group)
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    each = materialise(each.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n")), "offsets")
    return apart.join(each, [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


@dataclass
class Tree:
    """tiers: the members of each, g, idx, n and hash (and more columns in the lowest), and its nodes, g, level, idx, n and hash. width and depth are those of a tier."""

    tiers: list[tuple[DataFrame, DataFrame]]
    width: int
    depth: int

    def tops(self) -> DataFrame:
        """g, hash and the tier that ends with it: the last node of each group."""
        out = None
        for t, (_, nodes) in enumerate(self.tiers):
            own = nodes.filter("n = 1").select("g", "hash", F.lit(t).alias("tier"))
            out = own if out is None else out.union(own)
        return out


def div(a: str, b: int) -> Column:
    return F.expr(f"{a} div {b}")


def at_level(width: int, level: int) -> Column:
    """How many nodes a group of n members has on a level."""
    return div(f"(n + {width**level - 1})", width**level)


def by_level(depth: int, value) -> Column:
    """value(k) on level k."""
    return F.coalesce(*[F.when(F.col("level") == k, value(k)) for k in range(depth + 1)])


def build(members: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> Tree:
    """From the groups' members (g, idx, n, hash) all nodes above them, tier by tier."""
    tiers = []
    while True:
        powers = F.array(*[F.lit(width**k).cast("bigint") for k in range(depth + 1)])
        block = members.select("g", "n", div("idx", width**depth).alias("block"), F.struct("idx", "hash").alias("member")).groupBy("g", "n", "block").agg(F.sort_array(F.collect_list("member")).alias("members"))
        joined = lambda row, i: digest(F.concat_ws("", F.slice(row, i + 1, width)))
        up = lambda row: F.transform(F.sequence(F.lit(0), F.size(row) - 1, F.lit(width)), lambda i: joined(row, i))
        more = lambda k: F.expr("n") > F.element_at(powers, k)  # noqa: E731  level k - 1 holds several nodes
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.transform("members", lambda m: text_of(m["hash"]))), lambda done, k: F.when(more(k), F.concat(done, F.array(up(F.element_at(done, -1))))).otherwise(done))
        rows = block.select("g", "n", "block", F.posexplode(levels).alias("level", "row")).select("g", "n", "block", "level", F.posexplode("row").alias("at", "hash"))
        place = by_level(depth, lambda k: F.col("block") * width ** (depth - k) + F.col("at"))
        nodes = rows.select("g", "level", place.alias("idx"), by_level(depth, lambda k: at_level(width, k)).alias("n"), F.unhex("hash").alias("hash"))
        nodes = materialise(nodes, "nodes")
        tiers.append((members, nodes))
        members = nodes.filter((F.col("level") == depth) & (F.col("n") > 1)).select("g", "idx", "n", "hash")
        if not members.limit(1).count():
            return Tree(tiers, width, depth)


def prove(tree: Tree, above: DataFrame, offset: int, carried: list[str]) -> DataFrame:
    """The lowest members' carried columns, with steps and what above holds of their group.

    above: g, tier, steps and more for each group, the proof of its last node. steps are level, idx and hash of all siblings and, without a hash,
    of the nodes on the way, in order."""
    width, depth = tree.width, tree.depth
    others = [c for c in above.columns if c not in ("g", "tier", "steps")]
    known: DataFrame | None = None  # proofs of the tier above, as g, parent, steps and others
    for t in range(len(tree.tiers) - 1, -1, -1):
        members, nodes = tree.tiers[t]
        payload = carried if t == 0 else []
        ends = above.filter(F.col("tier") == t).select("g", F.lit(0).cast("bigint").alias("parent"), F.col("steps").alias("rest"), *others)
        known = ends if known is None else ends.unionByName(known)
        coordinates = [F.struct(F.lit(-1).alias("level"), F.col("idx").alias("node"), *payload)]
        for level in range(depth):
            own, count = div("idx", width**level), at_level(width, level)
            for k in range(width):
                node = div("idx", width ** (level + 1)) * width + k
                coordinates.append(F.when((node != own) & (node < count), F.struct(F.lit(level).alias("level"), node.alias("node"), *[F.lit(None).cast(members.schema[c].dataType).alias(c) for c in payload])))
        wanted = members.select("g", "n", "idx", F.explode(F.array_compact(F.array(*coordinates))).alias("c")).select("g", "n", "idx", "c.*")
        found = nodes.filter(F.col("level") < depth).select("g", "level", F.col("idx").alias("node"), F.col("hash").alias("sibling"))
        met = wanted.join(found, ["g", "level", "node"], "left").withColumn("parent", div("idx", width**depth)).repartition("g", "parent")
        sibling = F.when(F.col("level") >= 0, F.struct("level", "node", F.col("sibling").alias("hash")))
        own = met.groupBy("g", "parent", "idx", "n").agg(F.collect_list(sibling).alias("found"), *[F.max(c).alias(c) for c in payload])
        way = [F.when(at_level(width, k) > 1, F.struct(F.lit(k).alias("level"), div("idx", width**k).alias("node"), F.lit(None).cast("binary").alias("hash"))) for k in range(depth)]
        steps = F.transform(F.sort_array(F.concat("found", F.array_compact(F.array(*way)))), lambda s: F.struct((s["level"] + t * depth + offset).alias("level"), s["node"].alias("node"), s["hash"].alias("hash")))
        own = own.withColumn("steps", steps).join(known, ["g", "parent"]).select("g", "idx", *payload, F.concat("steps", "rest").alias("steps"), *others)
        known = own if t == 0 else materialise(own.select("g", F.col("idx").alias("parent"), F.col("steps").alias("rest"), *others), "proofs")
    return known


def fold(start: Column, steps: Column) -> Column:
    """What a leaf's text and its steps give: on each level the hash so far takes its place among the siblings."""

    def step(done: Column, s: Column) -> Column:
        new = s["level"] != done["level"]
        before = F.when(new, done["run"]).otherwise(done["before"])  # the run of the level below, whose digest is the node on the way
        node = F.coalesce(text_of(s["hash"]), digest(before), start)
        return F.struct(s["level"].cast("int").alias("level"), before.alias("before"), F.concat(F.when(new, F.lit("")).otherwise(done["run"]), node).alias("run"))

    nothing = F.lit(None).cast("string")
    return F.aggregate(steps, F.struct(F.lit(-1).alias("level"), nothing.alias("before"), nothing.alias("run")), step, lambda done: F.coalesce(digest(done["run"]), start))


def manifest(docs: DataFrame, tampered: Column, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, the siblings in order, and folded: the root that a row gives whose leaf is tampered in place of its own (null: its own)."""
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("g"), F.unhex(leaf_of()).alias("hash"), F.unhex(tampered).alias("changed"))
    tree = build(placed(materialise(leaves, "leaves"), "g", ["doc_id", "hash"]), width, depth)
    subroots = materialise(tree.tops().select(F.lit("").alias("g"), F.col("g").alias("of"), "tier", "hash"), "subroots")
    high = build(placed(subroots, "g", ["of"]), width, depth)
    steps = F.array().cast("array<struct<level: int, node: bigint, hash: binary>>")
    root = high.tops().select("g", "tier", steps.alias("steps"), F.col("hash").alias("root"))
    above = materialise(prove(high, root, ABOVE, ["of", "tier", "hash"]).select(F.col("of").alias("g"), "tier", "steps", F.col("hash").alias("subroot"), "root"), "subroot-proofs")
    rows = prove(tree, above, 0, ["doc_id", "hash", "changed"])
    siblings = F.transform(F.filter("steps", lambda s: s["hash"].isNotNull()), lambda s: text_of(s["hash"]))
    hashes = {c: text_of(F.col(c)) for c in ("subroot", "root")}
    return rows.select("doc_id", text_of(F.col("hash")).alias("leaf"), *[x.alias(c) for c, x in hashes.items()], siblings.alias("siblings"), fold(text_of(F.coalesce("changed", "hash")), F.col("steps")).alias("folded"))


def query(docs: DataFrame) -> DataFrame:
    """Where 7 divides the crc32 of doc_id, the leaf has one character more than the document."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.try_add(F.col("n_chars"), F.lit(1).cast(docs.schema["n_chars"].dataType))
    rows = manifest(docs, F.when(chosen, leaf_of(n_chars=more)))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(F.concat_ws("", "siblings")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def sql_tree(name: str, first: str) -> str:
    """Levels of trees of two, from rows of g, level, idx, n and h."""
    return f"{name} AS ({first} UNION ALL SELECT g, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 2, n)"


def sql_proof(name: str, first: str, tree: str) -> str:
    """Walks from rows of r, g, level, idx, n, s (siblings) and f (folded) up a tree."""
    return f"""{name} AS ({first} UNION ALL
SELECT p.r, p.g, p.level + 1, p.idx // 2, (p.n + 1) // 2, p.s || coalesce(x.h, ''), sha256(CASE WHEN p.idx % 2 = 1 THEN x.h || p.f ELSE p.f || coalesce(x.h, '') END)
FROM {name} p LEFT JOIN {tree} x ON x.g = p.g AND x.level = p.level AND x.idx = p.idx + 1 - 2 * (p.idx % 2) WHERE p.n > 1)"""


def sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, {sql_leaf("n_chars")} AS leaf, CASE WHEN {CRC} % 7 = 0 THEN {sql_leaf("n_chars + 1")} END AS changed, coalesce('+' || lang, '') AS g FROM documents),
l AS (SELECT r, g, doc_id, leaf, coalesce(changed, leaf) AS changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
{sql_tree("tree", "SELECT g, 0 AS level, idx, n, leaf AS h FROM l")},
sub AS (SELECT g AS lang, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, h FROM tree WHERE n = 1),
{sql_tree("high", "SELECT '' AS g, 0 AS level, idx, n, h FROM sub")},
{sql_proof("own", "SELECT r, g, 0 AS level, idx, n, '' AS s, changed AS f FROM l", "tree")},
{sql_proof("above", "SELECT o.r, '' AS g, 0 AS level, sub.idx, sub.n, o.s, o.f FROM own o JOIN sub ON sub.lang = o.g WHERE o.n = 1", "high")}
SELECT l.doc_id, l.leaf, sub.h AS subroot, high.h AS root, sha256(a.s) AS proof_sha256, a.f AS folded_root, a.f = high.h AS verified
FROM l JOIN sub ON sub.lang = l.g JOIN above a ON a.r = l.r AND a.n = 1 JOIN high ON high.n = 1"""
