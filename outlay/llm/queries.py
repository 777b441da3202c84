"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from outlay.llm import conversations, decontaminate, extract, jaccard, packing, repeats, runs, sharding, token_counts, topk, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_main_text": extract.op2_main_text,
    "op3_suffix_decontamination": decontaminate.op3_suffix_decontamination,
    "op4_suffix_repeats": repeats.op4_suffix_repeats,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_hypergeometric_sharding": sharding.op6_hypergeometric_sharding,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_packing": packing.op8_packing,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_bitsliced_topk": topk.op10_bitsliced_topk,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op3_suffix_decontamination": decontaminate.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op9_ngram_jaccard": jaccard.ORACLE,
    "op10_bitsliced_topk": topk.ORACLE,
}
