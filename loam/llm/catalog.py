"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from loam.llm.bpe import op9_bpe
from loam.llm.chat import OP6_SQL, op6_chat
from loam.llm.collocations import OP12_SQL, op12_collocations
from loam.llm.decontaminate import OP7_SQL, op7_decontaminate
from loam.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from loam.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from loam.llm.jaccard import op8_jaccard
from loam.llm.language_id import op10_language_id
from loam.llm.lm_score import op5_lm_score
from loam.llm.quality import op13_quality
from loam.llm.secrets import op3_secrets
from loam.llm.substring_dedup import op2_substring_dedup
from loam.llm.suffix_dedup import op1_suffix_dedup


def queries() -> dict:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_substring_dedup": op2_substring_dedup, "op3_secrets": op3_secrets, "op4_exact_dedup": op4_exact_dedup, "op5_lm_score": op5_lm_score, "op6_chat": op6_chat, "op7_decontaminate": op7_decontaminate, "op8_jaccard": op8_jaccard, "op9_bpe": op9_bpe, "op10_language_id": op10_language_id, "op11_fill_in_middle": op11_fill_in_middle, "op12_collocations": op12_collocations, "op13_quality": op13_quality, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op4_exact_dedup": OP4_SQL, "op6_chat": OP6_SQL, "op7_decontaminate": OP7_SQL, "op11_fill_in_middle": OP11_SQL, "op12_collocations": OP12_SQL}
