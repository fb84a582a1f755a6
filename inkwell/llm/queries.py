"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from inkwell.llm.ann import op7_nearest
from inkwell.llm.bpe import op5_bpe
from inkwell.llm.embdedup import op9_embedding_dedup
from inkwell.llm.fim import OP13_SQL, op13_fill_in_middle
from inkwell.llm.langid import op3_language_id
from inkwell.llm.linededup import OP6_SQL, op6_line_dedup
from inkwell.llm.mixing import OP1_SQL, op1_mixing
from inkwell.llm.quality import op8_quality
from inkwell.llm.resample import OP11_SQL, op11_resampling
from inkwell.llm.sentencepieces import op12_sentencepiece
from inkwell.llm.simhash import op4_simhash
from inkwell.llm.tokencount import op10_token_counts
from inkwell.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest": op7_nearest,
    "op8_quality": op8_quality,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_resampling": op11_resampling,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_resampling": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
