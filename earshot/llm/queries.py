"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from earshot.llm.chat import OP3_SQL, op3_chat
from earshot.llm.codes import OP11_SQL, op11_codes
from earshot.llm.flac import op9_flac
from earshot.llm.language import op8_language
from earshot.llm.mixing import op1_mixing
from earshot.llm.neardup import op5_neardup
from earshot.llm.negatives import OP12_SQL, op12_negatives
from earshot.llm.packing import op10_packing
from earshot.llm.quality import op6_quality
from earshot.llm.secrets import OP2_SQL, op2_secrets
from earshot.llm.topk import OP4_SQL, op4_topk
from earshot.llm.toxicity import op7_toxicity
from earshot.llm.urls import OP13_SQL, op13_urls

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_chat": op3_chat,
    "op4_topk": op4_topk,
    "op5_neardup": op5_neardup,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_flac": op9_flac,
    "op10_packing": op10_packing,
    "op11_codes": op11_codes,
    "op12_negatives": op12_negatives,
    "op13_urls": op13_urls,
}

SQL = {"op2_secrets": OP2_SQL, "op3_chat": OP3_SQL, "op4_topk": OP4_SQL, "op11_codes": OP11_SQL, "op12_negatives": OP12_SQL, "op13_urls": OP13_SQL}
