"""Queries of the training-data operators and the DuckDB SQL that checks them."""

from __future__ import annotations

from .decontaminate import OP1_SQL, op1_decontaminate
from .embeddings import OP10_SQL, op10_embeddings
from .language import op4_language
from .neardup import OP2_SQL, op2_neardup
from .packing import op7_packing
from .pii import op3_pii
from .quotes import OP8_SQL, op8_quotes
from .substrings import OP5_SQL, op5_substrings
from .toxicity import op6_toxicity
from .urlfilter import OP9_SQL, op9_urlfilter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_neardup": op2_neardup,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_substrings": op5_substrings,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_quotes": op8_quotes,
    "op9_urlfilter": op9_urlfilter,
    "op10_embeddings": op10_embeddings,
}
ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op2_neardup": OP2_SQL,
    "op5_substrings": OP5_SQL,
    "op8_quotes": OP8_SQL,
    "op9_urlfilter": OP9_SQL,
    "op10_embeddings": OP10_SQL,
}
