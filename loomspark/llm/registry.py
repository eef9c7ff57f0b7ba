"""Queries of the corpus operators and, where SQL can state them, the same in DuckDB SQL."""

from __future__ import annotations

from .ann_forest import op1_ann_forest
from .bestfit_packing import op5_bestfit_packing
from .chat_format import OP8_SQL, op8_chat_format
from .embedding_whitening import op12_embedding_whitening
from .ngram_join import OP7_SQL, op7_ngram_join
from .quality_classifier import op6_quality_classifier
from .quality_rules import op9_quality_rules
from .sale_enrichment import OP11_SQL, op11_sale_enrichment
from .secret_scan import op13_secret_scan
from .source_mixing import op4_source_mixing
from .substring_dedup import op2_substring_dedup
from .token_counts import op10_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    "op1_ann_forest": op1_ann_forest,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_bestfit_packing": op5_bestfit_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_join": op7_ngram_join,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_sale_enrichment": op11_sale_enrichment,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES = {"op7_ngram_join": OP7_SQL, "op8_chat_format": OP8_SQL, "op11_sale_enrichment": OP11_SQL}
