"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from . import url_filter, warc_revisit
from .centroids import op12_centroid_clustering
from .chat import op13_chat_formatting
from .ctw import op5_lm_scoring
from .decontaminate import op4_benchmark_decontamination
from .language_id import op1_language_id
from .packing import op10_best_fit_packing
from .quality import op9_quality_rules
from .secret_scan import op2_secret_scan
from .simhash import op3_simhash_near_dedup
from .token_files import op6_token_output
from .whitening import op11_embedding_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_output": op6_token_output,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_warc_revisit": warc_revisit.op8_warc_revisit,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_chat_formatting": op13_chat_formatting,
}
ORACLE: dict[str, str] = {
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op8_warc_revisit": warc_revisit.ORACLE_SQL,
}
