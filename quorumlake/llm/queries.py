"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, lexical
from .alignment import op11_token_alignment
from .byte_bpe import op9_byte_bpe
from .exact_dedup import op12_exact_index
from .gif_media import op10_gif_media
from .language_id import op8_language_spans
from .lexical import op13_bag_search
from .line_dedup import op6_fuzzy_lines
from .near_dedup import op4_lsh_forest
from .packing import op7_best_fit_packing
from .pii import op1_weak_supervision_pii
from .sharding import op3_balanced_shards
from .token_counts import op2_token_counts
from .vector_dedup import op5_sorted_projections

QUERIES = {
    f.__name__: f
    for f in (
        op1_weak_supervision_pii,
        op2_token_counts,
        op3_balanced_shards,
        op4_lsh_forest,
        op5_sorted_projections,
        op6_fuzzy_lines,
        op7_best_fit_packing,
        op8_language_spans,
        op9_byte_bpe,
        op10_gif_media,
        op11_token_alignment,
        op12_exact_index,
        op13_bag_search,
    )
}
#: The others are not written in SQL (tokenizers, hashes, iteration); tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op12_exact_index": exact_dedup.SQL, "op13_bag_search": lexical.SQL}
