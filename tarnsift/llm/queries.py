"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .decontaminate import op3_decontaminate
from .graph_index import op5_nearest
from .language_model import op10_language_model
from .mixing import OP7_SQL, op7_mixing
from .ngram_join import op2_ngram_join
from .repeats import op1_repeats
from .revisits import OP4_SQL, op4_revisits
from .sharding import op8_sharding
from .toxicity import op6_toxicity

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_ngram_join": op2_ngram_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_revisits": op4_revisits,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_language_model": op10_language_model,
}
ORACLES = {
    "op4_revisits": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op9_chat": OP9_SQL,
}
