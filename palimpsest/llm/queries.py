"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from palimpsest.llm import line_dedup
from palimpsest.llm.embeddings import op6_embedding_dedup
from palimpsest.llm.html_text import op10_html_text
from palimpsest.llm.language_id import op7_language_id
from palimpsest.llm.license_scan import op2_license_scan
from palimpsest.llm.line_dedup import op1_line_dedup
from palimpsest.llm.lm_score import op9_lm_score
from palimpsest.llm.packing import op8_best_fit_packing
from palimpsest.llm.quality import op4_quality_rules
from palimpsest.llm.sentence_piece import op3_sentencepiece
from palimpsest.llm.simhash import op5_simhash_dedup

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_sentencepiece, op4_quality_rules, op5_simhash_dedup, op6_embedding_dedup, op7_language_id, op8_best_fit_packing, op9_lm_score, op10_html_text)}

ORACLE_SQL = {"op1_line_dedup": line_dedup.SQL}
