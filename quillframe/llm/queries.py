"""The ten queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import mixing
from .chat import OP3_SQL, op3_query
from .decontaminate import op8_query
from .embeddings import op9_query
from .jaccard import op6_query
from .language import op1_query
from .quality import op10_query
from .sharding import op7_query
from .substring import op5_query
from .toxicity import op2_query

QUERIES = {
    "op1_language_id": op1_query,
    "op2_toxicity": op2_query,
    "op3_chat_format": op3_query,
    "op4_mixing": mixing.op4_query,
    "op5_substring_dedup": op5_query,
    "op6_ngram_jaccard": op6_query,
    "op7_sharding": op7_query,
    "op8_decontaminate": op8_query,
    "op9_embedding_dedup": op9_query,
    "op10_quality": op10_query,
}
ORACLES: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_mixing": mixing.sql()}
