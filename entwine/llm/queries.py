"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from entwine.llm.ann import op7_ann
from entwine.llm.chat import OP10_SQL, op10_chat_format
from entwine.llm.decontamination import OP4_SQL, op4_decontamination
from entwine.llm.line_dedup import OP3_SQL, op3_line_dedup
from entwine.llm.mixing import OP6_SQL, op6_mixing
from entwine.llm.near_dedup import op8_near_dedup
from entwine.llm.quality import op5_quality
from entwine.llm.sharding import op1_sharding, op1_sql
from entwine.llm.suffix_dedup import op9_suffix_dedup
from entwine.llm.token_counts import op2_token_counts


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_line_dedup, op4_decontamination, op5_quality, op6_mixing, op7_ann, op8_near_dedup, op9_suffix_dedup, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1_sql(), "op3_line_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op6_mixing": OP6_SQL, "op10_chat_format": OP10_SQL}
