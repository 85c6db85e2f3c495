"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import benchmark_decontamination, chat_format, exact_topk, filter_audit, ngram_jaccard_join
from .benchmark_decontamination import op4_benchmark_decontamination
from .bpe import op8_bpe_encoding
from .chat_format import op10_chat_format
from .edit_fingerprint import op12_edit_fingerprint
from .exact_topk import op7_exact_topk
from .filter_audit import op11_filter_audit
from .importance_resampling import op13_importance_resampling
from .language_id import op2_language_id
from .ngram_jaccard_join import op1_ngram_jaccard_join
from .quality_crf import op3_quality_crf
from .suffix_array_dedup import op9_suffix_array_dedup
from .token_counts import op5_token_counts
from .toxicity_chain import op6_toxicity_chain

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_language_id,
        op3_quality_crf,
        op4_benchmark_decontamination,
        op5_token_counts,
        op6_toxicity_chain,
        op7_exact_topk,
        op8_bpe_encoding,
        op9_suffix_array_dedup,
        op10_chat_format,
        op11_filter_audit,
        op12_edit_fingerprint,
        op13_importance_resampling,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join.ORACLE_SQL,
    "op4_benchmark_decontamination": benchmark_decontamination.ORACLE_SQL,
    "op7_exact_topk": exact_topk.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}
