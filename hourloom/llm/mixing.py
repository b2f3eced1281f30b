"""Operator 8: mix sources to target weights by Poisson replication, native.

A source with target share w of the corpus' characters and c characters of its own has the mean repetition
rate total * w / c. Each document's number of copies is the inverse Poisson distribution function at uniform
numbers hashed from the seed and its id, so a run repeats exactly and needs no state. A rate above PART is
the sum of several independent parts of at most PART each, which keeps exp(-rate) and the tables in range.

Cases: a null source is a source of its own; null or empty texts count as one character, so no rate divides
by zero; a null doc_id hashes as the empty string; repeated rows get the same count each; a source whose
target weight is missing or not above 0 gets no copies; a very long text moves with its copies, which are rows of their own; an
empty table gives an empty one; other columns stay, whatever their names, but for mix_copy, mix_copies and mix_key, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise, unused

PART = 64.0


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float = 1.0) -> DataFrame:
    """One row per source: mix_source, chars, rate.

    weights: target share by source (need not add up to 1). None: each source's characters to the power alpha.
    total: characters wanted, as a multiple of those there are."""
    chars = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).cast("bigint").alias("chars"))
    if weights is None:
        weighted = chars.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        weighted = chars.join(given, F.col("mix_source").eqNullSafe(F.col("s")), "left").select("mix_source", "chars", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    sums = weighted.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.coalesce(F.lit(float(total)) * F.col("all_chars") * F.try_divide("weight", "all_weight") / F.col("chars"), F.lit(0.0))
    return weighted.crossJoin(F.broadcast(sums)).select("mix_source", "chars", rate.alias("rate"))  # sums is one row


def with_tables(rates: DataFrame) -> DataFrame:
    """Adds parts, and cdf: the distribution function of Poisson(rate / parts) at 0, 1, ... until it is 1 in doubles."""
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART)), F.lit(1)).cast("int")
    return (
        rates.withColumn("parts", parts)
        .withColumn("m", F.col("rate") / F.col("parts"))
        .withColumn(
            "cdf",
            F.expr(
                "aggregate(sequence(1, cast(ceil(m + 12 * sqrt(m) + 40) as int)), "
                "named_struct('p', exp(-m), 's', exp(-m), 'c', array(exp(-m))), "
                "(a, k) -> named_struct('p', a.p * m / k, 's', a.s + a.p * m / k, 'c', array_append(a.c, a.s + a.p * m / k)), a -> a.c)"
            ),
        )
        .drop("m")
    )


def copies(seed: int, doc_id: Column, cdf: Column, part: Column) -> Column:
    """Copies of a document in one of its source's parts."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), part.cast("string"))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    return F.size(F.filter(cdf, lambda c: c <= u))


def poisson_mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 8) -> DataFrame:
    """Every column of docs, once per copy, with mix_copy (from 0), mix_copies and mix_key, the random order of the whole result.

    Rows leave in hashed partitions, sorted by mix_key in each. The table of rates has one short row per source; it is
    written first, so the planner sees its size and broadcasts it only below spark.sql.autoBroadcastJoinThreshold. Where a source's
    rate has several parts, its rows are exploded by part and dealt anew before the copies are made, so a task makes few of them for each row."""
    rates = materialise(with_tables(source_rates(docs, weights, alpha, total)), "mix-rates")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_copy", "mix_copies", "mix_key")])
    source, parts, cdf, sizes, part = unused(docs.columns, "source", "parts", "cdf", "sizes", "part")
    joined = docs.join(rates.select(F.col("mix_source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf)), F.col("source").eqNullSafe(F.col(source)))
    each = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: copies(seed, F.col("doc_id"), F.col(cdf), j))
    counted = joined.withColumn(sizes, each).withColumn("mix_copies", F.aggregate(sizes, F.lit(0), lambda n, x: n + x)).filter("mix_copies > 0")
    own = [F.col(f"`{c}`") for c in docs.columns]
    upto = F.sequence(F.lit(0), F.col("mix_copies") - 1)
    exploded = counted.filter(F.col(parts) == 1).select(*own, F.explode(upto).alias("mix_copy"), "mix_copies")
    if rates.filter("parts > 1").limit(1).count():
        several = counted.filter(F.col(parts) > 1).select(*own, "mix_copies", F.col(sizes), F.posexplode(sizes).alias(part, f"{part}_n")).filter(F.col(f"{part}_n") > 0)
        first = F.aggregate(F.slice(sizes, F.lit(1), F.col(part)), F.lit(0), lambda n, x: n + x)
        several = several.withColumn(sizes, first).repartition(F.xxhash64("doc_id", part), F.col(part))
        exploded = exploded.union(several.select(*own, F.explode(F.sequence(F.col(sizes), F.col(sizes) + F.col(f"{part}_n") - 1)).alias("mix_copy"), "mix_copies"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("doc_id").cast("string"), F.col("mix_copy").cast("string")).cast("binary"))
    return exploded.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")


def query(docs: DataFrame) -> DataFrame:
    return poisson_mix(docs).select("doc_id", "source", F.col("mix_copy").cast("bigint").alias("copy"), F.col("mix_copies").cast("bigint").alias("n_copies"), "mix_key")


SQL = """
WITH c AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1))::BIGINT AS chars FROM documents GROUP BY source),
w AS (SELECT *, pow(chars::DOUBLE, 0.5) AS weight FROM c),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(chars) FROM w) * (weight / (SELECT sum(weight) FROM w)) / chars AS rate FROM w),
p AS (SELECT source, greatest(ceil(rate / 64.0), 1)::INT AS parts, rate / greatest(ceil(rate / 64.0), 1)::INT AS m FROM r),
t AS (SELECT source, parts, u.k, m, ceil(m + 12 * sqrt(m) + 40)::INT AS top FROM p, LATERAL (SELECT unnest(range(0, ceil(m + 12 * sqrt(m) + 40)::INT + 1)) AS k) u),
d AS (SELECT source, k, exp(-m) * exp(sum(CASE WHEN k = 0 THEN 0 ELSE ln(m / k) END) OVER (PARTITION BY source ORDER BY k)) AS mass FROM t),
f AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS cdf FROM d),
x AS (SELECT row_number() OVER () AS rid, doc_id, source FROM documents),
u AS (SELECT rid, doc_id, x.source, (('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, parts + 1)) AS j) y),
n AS (SELECT rid, doc_id, u.source, count(*) AS n FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source AND f.cdf <= u.u GROUP BY rid, doc_id, u.source)
SELECT doc_id, source, copy::BIGINT AS copy, n::BIGINT AS n_copies, md5(concat_ws(':', '8:order', doc_id, copy)) AS mix_key
FROM n, LATERAL (SELECT unnest(range(0, n)) AS copy) z
"""
