"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidegrid.llm import ann, bpe, chat, codes, decontam, line_dedup, lm_score, quality, repair, rules, sharding, simhash, token_files

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_neighbours": ann.op4_neighbours,
    "op5_token_files": token_files.op5_token_files,
    "op6_bpe": bpe.op6_bpe,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_chat": chat.op9_chat,
    "op10_sharding": sharding.op10_sharding,
    "op11_repair": repair.op11_repair,
    "op12_rules": rules.op12_rules,
    "op13_vector_codes": codes.op13_vector_codes,
}
SQL = {
    "op1_lm_score": lm_score.SQL_OP1, "op7_decontamination": decontam.SQL_OP7, "op9_chat": chat.SQL_OP9,
    "op11_repair": repair.SQL_OP11, "op12_rules": rules.SQL_OP12, "op13_vector_codes": codes.SQL_OP13,
}
