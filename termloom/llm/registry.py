"""The corpus operators' queries by name, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from termloom.llm.byte_bpe import op2_byte_bpe
from termloom.llm.hmm_lm import op4_hmm_lm
from termloom.llm.license_scan import OP6_SQL, op6_license_scan
from termloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from termloom.llm.mixing import op5_mix_sources
from termloom.llm.quality_ordinal import op7_quality_classifier
from termloom.llm.quality_rules import OP9_SQL, op9_quality_rules
from termloom.llm.simhash import op8_simhash_dedup
from termloom.llm.toxicity import op10_toxicity
from termloom.llm.vector_graph import op3_vector_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_hmm_lm": op4_hmm_lm,
    "op5_mix_sources": op5_mix_sources,
    "op6_license_scan": op6_license_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op6_license_scan": OP6_SQL, "op9_quality_rules": OP9_SQL}
