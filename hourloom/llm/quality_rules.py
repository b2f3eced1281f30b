"""Operator 5: quality rules of documents with host-level verdicts, native.

Rules read each whole text. Base rules fail short or repetitive texts. Two further rules, on symbols and on
repeated lines, have a mild and a severe limit. For each host (the column source) and rule the share of failing
documents is shrunk towards a beta prior whose mean and strength come from all hosts (method of moments, weighted by documents and less the
spread that chance gives hosts of few documents), and a host whose shrunk share exceeds HOST_SHARE is bad at that rule. A document goes if it fails a base rule, passes a severe
limit, or passes a mild limit on a host that is bad at that rule. So a host's verdict tightens the limits but
never removes a document that meets all of them.

Cases: a null text has no words and fails; a null host is a host of its own; repeated rows are judged alike and count
each; with one host the prior is that host's own share; a very long text is sorted inside its row; other columns are ignored, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import SPACE, materialise

#: Symbols per 100 words and repeated lines per 100 lines with a word: mild limit, severe limit.
SYMBOLS, DUP_LINES = (10, 30), (30, 60)
HOST_SHARE, PRIOR_LEAST, PRIOR_MOST = 0.3, 2.0, 1000.0


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) to docs.

    Three-word windows are hashed to 64 bits with their position and sorted inside the row, so a text of n words takes
    n log n steps whatever repeats in it; the words that repeated windows cover are the union of intervals of three."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (
        docs.withColumn("words_", words)
        .withColumn("lines_", lines)
        .withColumn("grams_", F.expr("CASE WHEN size(words_) < 4 THEN array() ELSE array_sort(transform(slice(words_, 1, size(words_) - 2), (w, i) -> named_struct('h', xxhash64(w, words_[i + 1], words_[i + 2]), 'i', i))) END"))
        .withColumn("at_", F.expr("array_sort(transform(filter(grams_, (g, i) -> (i > 0 AND g.h = grams_[i - 1].h) OR (i < size(grams_) - 1 AND g.h = grams_[i + 1].h)), g -> g.i))"))
        .withColumn("n_words", F.expr("cast(size(words_) as bigint)"))
        .withColumn("word_chars", F.expr("aggregate(words_, 0L, (n, w) -> n + length(w))"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"))
        .withColumn("n_lines", F.expr("cast(size(lines_) as bigint)"))
        .withColumn("n_dup_lines", F.expr("cast(size(lines_) - size(array_distinct(lines_)) as bigint)"))
        .withColumn("n_repeat_words", F.expr("aggregate(transform(at_, (p, i) -> CASE WHEN i + 1 < size(at_) THEN least(3, at_[i + 1] - p) ELSE 3 END), 0L, (n, x) -> n + x)"))
        .drop("words_", "lines_", "grams_", "at_")
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: share of documents past each mild limit, shrunk by the prior of all hosts."""
    hosts = measured.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"mild_{r}").cast("bigint")).alias(f"f_{r}") for r in ("symbols", "lines")])
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("all_n"), F.sum(n * n).alias("all_n2"), F.count(F.lit(1)).alias("hosts")]
    prior = hosts.agg(*sums, *[x for r in ("symbols", "lines") for x in (F.sum(f"f_{r}").alias(f"all_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"sq_{r}"))])
    out = hosts.crossJoin(F.broadcast(prior))  # prior is one row
    for r in ("symbols", "lines"):
        m = F.col(f"all_{r}") / F.col("all_n")
        # What the shares differ by, weighted by documents, less what chance alone gives hosts of that size; over the most it could be.
        rest = F.col(f"sq_{r}") - m * F.col(f"all_{r}") - m * (1 - m) * (F.col("hosts") - 1)
        rho = F.try_divide(rest, m * (1 - m) * (F.col("all_n") - F.col("all_n2") / F.col("all_n") - (F.col("hosts") - 1)))
        strength = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(PRIOR_LEAST)), F.lit(PRIOR_MOST))).otherwise(F.lit(PRIOR_MOST))
        out = out.withColumn(f"share_{r}", (F.col(f"f_{r}") + m * strength) / (F.col("n") + strength))
    return out.select("host", "n", "share_symbols", "share_lines")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures, base_failed, share_symbols, share_lines (of the host) and kept.

    The measures are narrow; they are written once, aggregated by host and joined back, so no text is shuffled."""
    measured = measures(docs.select("doc_id", "source", "text")).drop("text")
    limit = lambda n, per, most: 100 * F.col(n) > most * F.col(per)
    measured = measured.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mild_symbols": limit("n_symbols", "n_words", SYMBOLS[0]),
            "mild_lines": limit("n_dup_lines", "n_lines", DUP_LINES[0]),
            "severe": limit("n_symbols", "n_words", SYMBOLS[1]) | limit("n_dup_lines", "n_lines", DUP_LINES[1]),
        }
    )
    measured = materialise(measured, "rules")
    rates = materialise(host_rates(measured), "host-rates")
    joined = measured.join(rates.drop("n"), measured["source"].eqNullSafe(rates["host"]))
    bad = (F.col("mild_symbols") & (F.col("share_symbols") > HOST_SHARE)) | (F.col("mild_lines") & (F.col("share_lines") > HOST_SHARE))
    return joined.withColumn("kept", ~(F.col("base_failed") | F.col("severe") | bad)).drop("host", "mild_symbols", "mild_lines", "severe")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, (ws[i], ws[i + 1], ws[i + 2]) AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i) r),
a AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM a, LATERAL (SELECT unnest([i, i + 1, i + 2]) AS p) x GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(DISTINCT x) AS u FROM d, LATERAL (SELECT unnest(string_split(t, chr(10))) AS x) y WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines - u, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS ms, 100 * n_dup_lines > 30 * n_lines AS ml,
             100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 60 * n_lines AS severe FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (ms) AS fs, count(*) FILTER (ml) AS fl FROM v GROUP BY source),
p AS (SELECT sum(n)::DOUBLE AS m, sum(n::DOUBLE * n) AS m2, count(*) AS hosts, sum(fs) / sum(n) AS a, sum(fs::DOUBLE * fs / n) - sum(fs) / sum(n) * sum(fs) AS b,
             sum(fl) / sum(n) AS c, sum(fl::DOUBLE * fl / n) - sum(fl) / sum(n) * sum(fl) AS e FROM h),
o AS (SELECT a, c, (b - a * (1 - a) * (hosts - 1)) / nullif(a * (1 - a) * (m - m2 / m - (hosts - 1)), 0) AS x, (e - c * (1 - c) * (hosts - 1)) / nullif(c * (1 - c) * (m - m2 / m - (hosts - 1)), 0) AS y FROM p),
q AS (SELECT a, c, CASE WHEN x > 0 THEN least(greatest(1 / x - 1, 2), 1000) ELSE 1000 END AS s, CASE WHEN y > 0 THEN least(greatest(1 / y - 1, 2), 1000) ELSE 1000 END AS z FROM o),
k AS (SELECT source, (fs + a * s) / (n + s) > 0.3 AS bs, (fl + c * z) / (n + z) > 0.3 AS bl FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR severe OR (ms AND bs) OR (ml AND bl)) AS kept
FROM v JOIN k ON v.source IS NOT DISTINCT FROM k.source
"""
