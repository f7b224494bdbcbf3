"""The operators' queries and their comparison SQL."""

from __future__ import annotations

from bookstrata.llm import op1_quality, op2_mixing, op3_vectors, op4_language, op5_pieces, op6_secrets, op7_lines, op8_near, op9_lm, op10_binary
from bookstrata.llm import op11_whitening, op12_negatives, op13_urls

_MODULES = (op1_quality, op2_mixing, op3_vectors, op4_language, op5_pieces, op6_secrets, op7_lines, op8_near, op9_lm, op10_binary, op11_whitening, op12_negatives, op13_urls)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
