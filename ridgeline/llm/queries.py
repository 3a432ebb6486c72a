"""Registered queries of this package and their SQL."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .fingerprint import op2_fingerprint
from .langid import op10_language_id
from .mixing import OP8_SQL, op8_mixing
from .ngram_join import OP4_SQL, op4_ngram_join
from .pii import op9_pii
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .recompression import OP5_SQL, op5_recompression
from .repair import OP11_SQL, op11_repair
from .sharding import OP12_SQL, op12_sharding
from .suffix_dedup import op6_suffix_dedup
from .tokenstore import op7_token_store
from .topk import OP3_SQL, op3_topk

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_fingerprint, op3_topk, op4_ngram_join, op5_recompression, op6_suffix_dedup, op7_token_store, op8_mixing, op9_pii, op10_language_id, op11_repair, op12_sharding, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op4_ngram_join": OP4_SQL, "op5_recompression": OP5_SQL, "op8_mixing": OP8_SQL, "op11_repair": OP11_SQL, "op12_sharding": OP12_SQL, "op13_prefix_trie": OP13_SQL}
