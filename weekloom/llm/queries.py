"""Queries of this package, and their SQL."""

from __future__ import annotations

from weekloom.llm.chat import OP8_SQL, op8_chat
from weekloom.llm.decontaminate import op3_decontaminate
from weekloom.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from weekloom.llm.html_main import op6_main_text
from weekloom.llm.licenses import op10_licenses
from weekloom.llm.near_dup import op2_near_dup
from weekloom.llm.packing import op7_packing
from weekloom.llm.source_audit import OP12_SQL, op12_source_audit
from weekloom.llm.token_files import op5_token_files
from weekloom.llm.toxicity import op4_toxicity
from weekloom.llm.topk import OP1_SQL, op1_top_k
from weekloom.llm.url_filter import OP9_SQL, op9_url_filter
from weekloom.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_near_dup": op2_near_dup,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_main_text": op6_main_text,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_url_filter": op9_url_filter,
    "op10_licenses": op10_licenses,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_audit": op12_source_audit,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES = {
    "op1_top_k": OP1_SQL,
    "op8_chat": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_source_audit": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
