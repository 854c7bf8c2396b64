"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from sievework.llm import decontam, jaccard_join, langid, line_dedup, mixing, negatives, pieces, sharding, spelling, tokens, toxicity, warc, webp

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_ngram_jaccard": jaccard_join.op5_ngram_jaccard,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_warc": warc.op7_warc,
    "op8_media": webp.op8_media,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_counts": tokens.op10_token_counts,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_spelling": spelling.op12_spelling,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLES = {
    "op2_sharding": sharding.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
