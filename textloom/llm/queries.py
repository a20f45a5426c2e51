"""The registered queries of this subpackage and the oracles of those that SQL can express."""

from __future__ import annotations

from textloom.llm.bpe import op8_bpe
from textloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from textloom.llm.fingerprint import op1_fingerprint
from textloom.llm.licenses import op6_licenses
from textloom.llm.line_dedup import op9_line_dedup
from textloom.llm.lm_score import op3_lm_score
from textloom.llm.mixing import OP7_SQL, op7_mixing
from textloom.llm.near_dup import op2_near_dup
from textloom.llm.quality import op10_quality
from textloom.llm.runs import op12_periodic_runs
from textloom.llm.secrets import op4_secrets
from textloom.llm.sentencepiece_bpe import op11_sentencepiece
from textloom.llm.whitening import op13_whitening

QUERIES = {f.__name__: f for f in (
    op1_fingerprint, op2_near_dup, op3_lm_score, op4_secrets, op5_exact_dedup, op6_licenses, op7_mixing, op8_bpe, op9_line_dedup, op10_quality,
    op11_sentencepiece, op12_periodic_runs, op13_whitening)}

ORACLE = {"op5_exact_dedup": OP5_SQL, "op7_mixing": OP7_SQL}
