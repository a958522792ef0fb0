"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontamination, near_duplicates, topk_search
from tidemark.llm.chat import op10_chat
from tidemark.llm.decontamination import op8_decontamination
from tidemark.llm.html_text import op4_html_text
from tidemark.llm.language import op3_language
from tidemark.llm.near_duplicates import op5_near_duplicates
from tidemark.llm.secrets import op7_secrets
from tidemark.llm.sentencepiece_codec import op1_sentencepiece
from tidemark.llm.sharding import op6_sharding
from tidemark.llm.topk_search import op2_topk
from tidemark.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_topk, op3_language, op4_html_text, op5_near_duplicates, op6_sharding, op7_secrets, op8_decontamination, op9_toxicity, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk_search.SQL, "op5_near_duplicates": near_duplicates.SQL, "op8_decontamination": decontamination.SQL, "op10_chat": chat.SQL}
