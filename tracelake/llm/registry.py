"""Names of the queries of this subpackage, and of their oracles."""

from tracelake.llm import oracles, queries

QUERIES = {
    "op1_chat_format": queries.op1_chat_format,
    "op2_token_ids": queries.op2_token_ids,
    "op3_warc": queries.op3_warc,
    "op4_decontaminate": queries.op4_decontaminate,
    "op5_quality": queries.op5_quality,
    "op6_licenses": queries.op6_licenses,
    "op7_toxicity": queries.op7_toxicity,
    "op8_exact_dedup": queries.op8_exact_dedup,
    "op9_mixing": queries.op9_mixing,
    "op10_ngram_join": queries.op10_ngram_join,
    "op11_ranked_search": queries.op11_ranked_search,
    "op12_bpe": queries.op12_bpe,
    "op13_conversation_repair": queries.op13_conversation_repair,
}
ORACLES = {
    "op1_chat_format": oracles.CHAT_FORMAT,
    "op3_warc": oracles.WARC,
    "op6_licenses": oracles.LICENSES,
    "op8_exact_dedup": oracles.EXACT_DEDUP,
    "op9_mixing": oracles.MIXING,
    "op10_ngram_join": oracles.NGRAM_JOIN,
    "op11_ranked_search": oracles.RANKED_SEARCH,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
}
