"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from catalume.llm.binary_tokens import op9_binary_tokens
from catalume.llm.divergence import OP12_SQL, op12_source_divergence
from catalume.llm.fingerprints import op2_weighted_fingerprints
from catalume.llm.line_dedup import OP5_SQL, op5_line_dedup
from catalume.llm.mixing import op10_source_mixing
from catalume.llm.ngram_join import op1_ngram_jaccard_join
from catalume.llm.packing import op6_packing
from catalume.llm.quality import OP8_SQL, op8_quality_rules
from catalume.llm.sharding import op7_stratified_sharding
from catalume.llm.substrings import op13_substring_dedup
from catalume.llm.toxicity import op4_toxicity
from catalume.llm.tree_scoring import op3_context_tree_scoring
from catalume.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_weighted_fingerprints,
        op3_context_tree_scoring,
        op4_toxicity,
        op5_line_dedup,
        op6_packing,
        op7_stratified_sharding,
        op8_quality_rules,
        op9_binary_tokens,
        op10_source_mixing,
        op11_vector_codes,
        op12_source_divergence,
        op13_substring_dedup,
    )
}

SQL = {"op5_line_dedup": OP5_SQL, "op8_quality_rules": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_source_divergence": OP12_SQL}
