"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from srcgraph.llm.audio import op8_audio
from srcgraph.llm.decontaminate import op1_decontamination
from srcgraph.llm.language import op6_language
from srcgraph.llm.lm import op2_lm_score
from srcgraph.llm.mixing import OP10_SQL, op10_mixing
from srcgraph.llm.near_dedup import op9_near_dedup
from srcgraph.llm.quality import op7_quality
from srcgraph.llm.tokens import op5_token_ids
from srcgraph.llm.urls import op3_url_filter
from srcgraph.llm.warc import op4_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_score": op2_lm_score,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_token_ids": op5_token_ids,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_audio": op8_audio,
    "op9_near_dedup": op9_near_dedup,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op10_mixing": OP10_SQL}
