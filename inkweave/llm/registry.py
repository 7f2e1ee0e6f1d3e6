"""The queries of this subpackage and their SQL."""

from .mixing import OP5_SQL, op5_mixing
from .neardup import op8_neardup
from .neighbours import op3_neighbours
from .packing import op9_packing
from .quality import op4_quality
from .secrets import op2_secrets
from .substrings import op1_repeats
from .tokenbin import op6_token_binary
from .toxicity import op10_toxicity
from .urls import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_secrets": op2_secrets,
    "op3_neighbours": op3_neighbours,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_token_binary": op6_token_binary,
    "op7_url_filter": op7_url_filter,
    "op8_neardup": op8_neardup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

#: The others have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = {
    "op5_mixing": OP5_SQL,
    "op7_url_filter": OP7_SQL,
}
