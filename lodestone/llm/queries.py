"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from lodestone.llm import chat, collocations, decontamination, jaccard, langid, lm, merkle, mixing, piecebpe, quality, sharding, tokenfiles, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_outliers": quality.op5_quality_outliers,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_token_orc": tokenfiles.op7_token_orc,
    "op8_chat_format": chat.op8_chat_format,
    "op9_language_id": langid.op9_language_id,
    "op10_lm_score": lm.op10_lm_score,
    "op11_merkle": merkle.op11_merkle,
    "op12_collocations": collocations.op12_collocations,
    "op13_piece_bpe": piecebpe.op13_piece_bpe,
}

SQL = {
    "op2_sharding": sharding.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
