"""The operators of this subpackage as registered queries, and the DuckDB SQL of those SQL can
express."""

from __future__ import annotations

import corpus_pipeline
from voucherlens.llm.decontamination import op6_decontamination
from voucherlens.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from voucherlens.llm.html_extraction import op10_html_extraction
from voucherlens.llm.language_id import op12_language_id
from voucherlens.llm.line_dedup import OP3_SQL, op3_line_dedup
from voucherlens.llm.lm_scoring import op1_lm_scoring
from voucherlens.llm.minhash_dedup import op5_minhash_dedup
from voucherlens.llm.quality_classifier import op9_quality_classifier
from voucherlens.llm.quality_rules import OP8_SQL, op8_quality_rules
from voucherlens.llm.secret_scan import op2_secret_scan
from voucherlens.llm.sentencepiece_codec import op7_sentencepiece
from voucherlens.llm.source_divergence import OP11_SQL, op11_source_divergence
from voucherlens.llm.suffix_dedup import op4_suffix_dedup

QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_secret_scan, op3_line_dedup, op4_suffix_dedup, op5_minhash_dedup,
    op6_decontamination, op7_sentencepiece, op8_quality_rules, op9_quality_classifier,
    op10_html_extraction, op11_source_divergence, op12_language_id,
    op13_hard_negatives,
)} | {"pipeline": corpus_pipeline.run}
ORACLE = {"op3_line_dedup": OP3_SQL, "op8_quality_rules": OP8_SQL,
          "op11_source_divergence": OP11_SQL, "op13_hard_negatives": OP13_SQL}
