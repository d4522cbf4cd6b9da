"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from vertexloom.llm.ann import op9_projection_forest
from vertexloom.llm.byte_bpe import op12_byte_bpe
from vertexloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from vertexloom.llm.fill_in_middle import op13_fill_in_middle
from vertexloom.llm.line_dedup import OP7_SQL, op7_deletion_line_dedup
from vertexloom.llm.lm_scoring import op4_log_bloom_scoring
from vertexloom.llm.mixing import OP6_SQL, op6_pfair_mixing
from vertexloom.llm.packing import op2_best_fit_packing
from vertexloom.llm.pii import op3_offset_pii
from vertexloom.llm.runs import op11_periodic_runs
from vertexloom.llm.simhash import op10_simhash
from vertexloom.llm.toxicity import op5_clause_toxicity
from vertexloom.llm.warc_revisits import OP1_SQL, op1_warc_revisits

QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_offset_pii": op3_offset_pii,
    "op4_log_bloom_scoring": op4_log_bloom_scoring,
    "op5_clause_toxicity": op5_clause_toxicity,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_deletion_line_dedup": op7_deletion_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_projection_forest": op9_projection_forest,
    "op10_simhash": op10_simhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op1_warc_revisits": OP1_SQL,
    "op6_pfair_mixing": OP6_SQL,
    "op7_deletion_line_dedup": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
}
