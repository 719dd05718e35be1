"""The operators' queries and the SQL that expresses them."""

from __future__ import annotations

from . import collocations, decontaminate, exact_dedup, html_extract, langid, lexical_search, lm_score, reshard, secrets, sentence_pieces, simhash, token_files, tool_calls
from .common import table

QUERIES = {
    "op2_tool_call_links": lambda spark, sf: tool_calls.query(spark, table(spark, sf, "conversations")),
    "op6_gumbel_top_k_pieces": lambda spark, sf: sentence_pieces.query(spark, table(spark, sf, "documents")),
    "op3_crf_main_text": lambda spark, sf: html_extract.query(spark, table(spark, sf, "pages")),
    "op7_minhash_containment": decontaminate.query,
    "op8_secret_links": lambda spark, sf: secrets.query(spark, table(spark, sf, "documents")),
    "op9_cross_entropy_difference": lm_score.query,
    "op10_min_cost_reshard": lambda spark, sf: reshard.query(spark, table(spark, sf, "documents")),
    "op1_language_mixture": lambda spark, sf: langid.query(spark, table(spark, sf, "documents")),
    "op4_simhash_near_dedup": lambda spark, sf: simhash.query(spark, table(spark, sf, "documents")),
    "op5_exact_dedup": lambda spark, sf: exact_dedup.query(spark, table(spark, sf, "documents")),
    "op11_suffix_automaton_phrases": lambda spark, sf: collocations.query(spark, table(spark, sf, "documents")),
    "op12_bit_sliced_search": lexical_search.query,
    "op13_zstd_token_files": lambda spark, sf: token_files.query(spark, table(spark, sf, "documents")),
}

ORACLES = {
    "op2_tool_call_links": tool_calls.ORACLE,
    "op7_minhash_containment": decontaminate.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op11_suffix_automaton_phrases": collocations.ORACLE,
    "op12_bit_sliced_search": lexical_search.ORACLE,
}
