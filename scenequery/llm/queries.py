"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from . import chat
from .bpe import op4_byte_bpe
from .chat import op7_reply_trees
from .counts import op13_transducer_counts
from .dac import op3_dac_tokens
from .language import op10_viterbi_language
from .mixing import op9_sainte_lague
from .jaccard import op1_signature_trees
from .negatives import op12_hilbert_negatives
from .ring import op8_bounded_ring
from .search import op5_block_max_bm25
from .toxicity import op6_ordinal_toxicity
from .webp import op2_lossless_webp
from .whitening import op11_cholesky_jacobi

QUERIES = {
    "op1_signature_trees": op1_signature_trees,
    "op2_lossless_webp": op2_lossless_webp,
    "op3_dac_tokens": op3_dac_tokens,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_block_max_bm25": op5_block_max_bm25,
    "op6_ordinal_toxicity": op6_ordinal_toxicity,
    "op7_reply_trees": op7_reply_trees,
    "op8_bounded_ring": op8_bounded_ring,
    "op9_sainte_lague": op9_sainte_lague,
    "op10_viterbi_language": op10_viterbi_language,
    "op11_cholesky_jacobi": op11_cholesky_jacobi,
    "op12_hilbert_negatives": op12_hilbert_negatives,
    "op13_transducer_counts": op13_transducer_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op7_reply_trees": chat.ORACLE,
}
