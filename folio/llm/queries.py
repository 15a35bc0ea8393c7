"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import corpus_pipeline
from folio.llm import decontaminate, exact_dedup, html, language, licenses, line_dedup, mixing, near_dedup, tokens, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op4_passage_dedup": line_dedup.op4_passage_dedup,
    "op5_tokens": tokens.op5_tokens,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_language": language.op8_language,
    "op9_html": html.op9_html,
    "op10_licenses": licenses.op10_licenses,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
}
