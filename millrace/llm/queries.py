"""The subpackage's queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import bytes_dedup, decontaminate, jaccard, langid, language_model, maxscore, mixing, pii, substring, warc

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_language_id": langid.op3_language_id,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_personal_data": pii.op6_personal_data,
    "op7_max_score": maxscore.op7_max_score,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_suffix_array_dedup": bytes_dedup.op9_suffix_array_dedup,
    "op10_language_model": language_model.op10_language_model,
}

SQL = {
    "op1_substring_dedup": substring.OP1_SQL,
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_max_score": maxscore.OP7_SQL,
    "op9_suffix_array_dedup": bytes_dedup.OP9_SQL,
}
