"""The text operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .collocation import OP13_SQL, op13_collocations
from .decontam import OP10_SQL, op10_decontamination
from .jaccard import OP9_SQL, op9_jaccard_join
from .langid import op8_language_id
from .linededup import op1_line_dedup
from .mixing import op5_mixing
from .neardup import OP12_SQL, op12_near_embeddings
from .quality import op2_quality
from .sharding import op4_sharding
from .substring import op7_substring_dedup
from .suffix import OP3_SQL, op3_suffix_dedup
from .topk import OP6_SQL, op6_topk
from .trie import OP11_SQL, op11_prefix_trie

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_near_embeddings": op12_near_embeddings,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op3_suffix_dedup": OP3_SQL,
    "op6_topk": OP6_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_near_embeddings": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
