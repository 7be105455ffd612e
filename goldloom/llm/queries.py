"""The text operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from goldloom.llm import op1_quality, op3_exact, op6_mixing, op8_chat, op11_lines, op13_phrases
from goldloom.llm.op2_sst import op2_token_shards
from goldloom.llm.op4_bpe import op4_bpe
from goldloom.llm.op5_toxicity import op5_toxicity
from goldloom.llm.op7_licenses import op7_licenses
from goldloom.llm.op9_pii import op9_pii
from goldloom.llm.op10_join import op10_ngram_join
from goldloom.llm.op12_align import op12_alignment

QUERIES = {
    "op1_quality": op1_quality.op1_quality,
    "op2_token_shards": op2_token_shards,
    "op3_exact_dedup": op3_exact.op3_exact_dedup,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing.op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_chat": op8_chat.op8_chat,
    "op9_pii": op9_pii,
    "op10_ngram_join": op10_ngram_join,
    "op11_line_dedup": op11_lines.op11_line_dedup,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_phrases.op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality": op1_quality.SQL,
    "op3_exact_dedup": op3_exact.SQL,
    "op6_mixing": op6_mixing.SQL,
    "op8_chat": op8_chat.SQL,
    "op11_line_dedup": op11_lines.SQL,
    "op13_collocations": op13_phrases.SQL,
}
