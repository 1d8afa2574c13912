"""The registered queries of the subpackage and their SQL."""
from __future__ import annotations

import corpus_pipeline
from calibra.llm.align import op12_token_alignment
from calibra.llm.codes import op11_vector_codes
from calibra.llm.decontaminate import op7_decontaminate
from calibra.llm.language_id import op2_language_id
from calibra.llm.line_dedup import op10_line_dedup
from calibra.llm.lm_score import op9_lm_score
from calibra.llm.mixing import OP1_SQL, op1_source_mix
from calibra.llm.near_dedup import op4_near_dedup
from calibra.llm.packing import op13_sequence_packing
from calibra.llm.pii import op5_personal_data
from calibra.llm.secrets import op6_secret_scan
from calibra.llm.token_store import op3_token_store
from calibra.llm.vector_join import op8_vector_join

LLM_QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_source_mix": op1_source_mix,
    "op2_language_id": op2_language_id,
    "op3_token_store": op3_token_store,
    "op4_near_dedup": op4_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_vector_join": op8_vector_join,
    "op9_lm_score": op9_lm_score,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_sequence_packing": op13_sequence_packing,
}

LLM_ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": OP1_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
