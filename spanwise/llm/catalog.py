"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_phrase_collocations
from .decontaminate import op3_benchmark_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard_join import op5_ngram_jaccard_join
from .language_id import op8_language_id
from .language_model import op10_lm_scoring
from .license_scan import OP9_SQL, op9_license_scan
from .packing import op2_best_fit_packing
from .pii_surrogates import op1_pii_surrogates
from .quality_rules import OP12_SQL, op12_quality_rules
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .url_filter import op4_url_filter
from .whitening import op11_embedding_whitening

QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_quality_rules": op12_quality_rules,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES = {"op6_exact_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op9_license_scan": OP9_SQL, "op12_quality_rules": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
