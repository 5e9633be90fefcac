"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from meridian.llm import bpe, decontaminate, ngram_join, quality_rules, secrets, substring_dedup, token_store, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_secrets": secrets.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_bpe": bpe.op5,
    "op6_ngram_join": ngram_join.op6,
    "op7_substring_dedup": substring_dedup.op7,
    "op8_warc": warc.op8,
    "op9_toxicity": toxicity.op9,
    "op10_token_store": token_store.op10,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op8_warc": warc.ORACLE,
}
