"""The corpus pipeline: junk goes, repeated lines go, one document of each group of near copies stays, sources are mixed, texts become pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; the last returns one row per copy of a document that the mix holds, with its ids.

Cases: a text that is null or has no word is rejected by the first stage, so later ones meet none from it, though the second may empty a text, which has no
shingles, is no near copy of any other and encodes to no ids; rows with one doc_id are documents each, and of equal ones the third stage keeps
one; null sources are a source of their own in the mix; a very long text is a row as any other; ties are settled by text; an empty table gives an empty one, with the
same columns; columns of the input that have a stage's own names are set aside and come back; further ones stay until the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import line_dedup, mixing, near_dup, pieces, quality
from hourloom.llm.common import materialise, set_aside, ship, table, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    docs, own = set_aside(docs, ("quality_score", "quality_kept"))
    return quality.classify(docs).filter("quality_kept").select(own)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them repeat; n_chars is that of the new text."""
    ship(spark)
    kept = "n_chars" in docs.columns
    docs, own = set_aside(docs, ("n_lines", "n_dropped"))
    out = line_dedup.dedup_lines(docs)
    return (out.withColumn("n_chars", F.length("text").cast("bigint")) if kept else out).select(own)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    ship(spark)
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in random order."""
    ship(spark)
    docs, own = set_aside(docs, ("mix_copy", "mix_copies", "mix_key"))
    return mixing.poisson_mix(docs).select(own)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and the digests of ids and decoded text."""
    ship(spark)
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "ids", *pieces.digests(out))


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_copies", keep_one_copy), ("mix", mix_sources), ("pieces", encode_pieces)]

#: Training and random signatures can't be told in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
