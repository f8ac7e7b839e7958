"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .code_compression import OP13_SQL, op13_vector_codes
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality_classifier import op10_quality
from .quality_rules import op7_quality_rules
from .substring_dedup import OP11_SQL, op11_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op2_toxicity
from .jaccard_join import op8_jaccard_join
from .packing import op4_packing
from .token_files import op5_token_files
from .tree_bpe import op6_bpe
from .warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_suffix_dedup, op4_packing, op5_token_files, op6_bpe, op7_quality_rules, op8_jaccard_join, op9_warc, op10_quality, op11_substring_dedup, op12_prefix_trie, op13_vector_codes)}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op9_warc": OP9_SQL, "op11_substring_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
