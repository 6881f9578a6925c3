"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import collocations, mixing, treaps
from .chat import chat_layouts, op7_chat
from .decontaminate import op9_decontamination
from .html_text import op8_html_text
from .licenses import op1_licenses
from .minhash import op5_near_duplicates
from .oracles import CHAT, LAYOUTS, NEAR, licenses, quality
from .packing import op4_packing
from .quality_classifier import op10_quality_classifier
from .quality_rules import op3_quality_rules
from .tokens import op6_token_files
from .toxicity import op2_toxicity

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_files": op6_token_files,
    "op7_chat": op7_chat,
    "chat_layouts": chat_layouts,
    "op8_html_text": op8_html_text,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": treaps.op11_ranked_search,
    "op12_collocations": collocations.op12_collocations,
    "op13_mixing": mixing.op13_mixing,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses(),
    "op3_quality_rules": quality(),
    "op5_near_duplicates": NEAR,
    "op7_chat": CHAT,
    "chat_layouts": LAYOUTS,
    "op11_ranked_search": treaps.SQL,
    "op12_collocations": collocations.SQL,
}
