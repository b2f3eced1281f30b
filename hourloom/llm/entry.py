"""Queries and oracle SQL of the corpus operators, for __spark_entry__.py."""

from __future__ import annotations

from hourloom.llm import divergence, language, line_dedup, manifest, mixing, near_dup, pieces, quality, quality_rules, secrets, token_files, toxicity, vectors
from hourloom.llm.common import table


def queries() -> dict:
    docs = lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))
    return {
        "op1_quality_classifier": docs(quality.query),
        "op2_embedding_dedup": lambda spark, sf_dir: vectors.query(table(spark, sf_dir, "embeddings")),
        "op3_secrets": docs(secrets.query),
        "op4_line_dedup": docs(line_dedup.query),
        "op5_quality_rules": docs(quality_rules.query),
        "op6_sentencepiece": docs(pieces.query),
        "op7_minhash": docs(near_dup.query),
        "op8_mixing": docs(mixing.query),
        "op9_token_files": docs(token_files.query),
        "op10_language": docs(language.query),
        "op11_divergence": docs(divergence.query),
        "op12_merkle_manifest": docs(manifest.query),
        "op13_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


def oracle_sql() -> dict:
    return {"op4_line_dedup": line_dedup.SQL, "op5_quality_rules": quality_rules.SQL, "op8_mixing": mixing.SQL, "op11_divergence": divergence.SQL, "op12_merkle_manifest": manifest.SQL}
