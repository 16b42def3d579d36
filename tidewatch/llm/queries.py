"""Queries of this subpackage and their DuckDB SQL, for __spark_entry__."""

from __future__ import annotations

from tidewatch.llm import chat, decontaminate, embeddings, jaccard, langid, lines, mixing, tokens, toxicity, warc


def op1_mix_sources(spark, sf_dir: str):
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_embedding_near_dups": embeddings.op2_embedding_near_dups,
        "op3_chat_format": chat.op3_chat_format,
        "op4_benchmark_leaks": decontaminate.op4_benchmark_leaks,
        "op5_language_id": langid.op5_language_id,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_token_ids": tokens.op7_token_ids,
        "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """Language ID, toxicity (trained models) and token ids (a tokenizer library) have no SQL; tests hold them against brute force."""
    return {
        "op1_mix_sources": mixing.SQL,
        "op2_embedding_near_dups": embeddings.SQL,
        "op3_chat_format": chat.SQL,
        "op4_benchmark_leaks": decontaminate.SQL,
        "op8_ngram_jaccard": jaccard.SQL,
        "op9_line_dedup": lines.SQL,
        "op10_warc": warc.SQL,
    }
