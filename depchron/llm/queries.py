"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from depchron.llm import chat, decontamination, extract, language, merkle, mixing, neardup, quality, scoring, search, secrets, sharding, tokens

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality": quality.op3_quality,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_scoring": scoring.op5_scoring,
    "op6_neardup": neardup.op6_neardup,
    "op7_tokens": tokens.op7_tokens,
    "op8_language": language.op8_language,
    "op9_sharding": sharding.op9_sharding,
    "op10_chat": chat.op10_chat,
    "op11_search": search.op11_search,
    "op12_merkle": merkle.op12_merkle,
    "op13_extract": extract.op13_extract,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_quality": quality.OP3_SQL,
    "op4_decontamination": decontamination.OP4_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
    "op11_search": search.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
