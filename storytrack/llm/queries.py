"""Registered queries of the numbered operators and their DuckDB oracles."""

from __future__ import annotations

from storytrack.llm.decontaminate import OP9_SQL, op9_decontaminate
from storytrack.llm.divergence import OP13_SQL, op13_source_divergence
from storytrack.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from storytrack.llm.langid import op10_language_id
from storytrack.llm.license_scan import OP1_SQL, op1_license_scan
from storytrack.llm.line_dedup import OP8_SQL, op8_site_lines
from storytrack.llm.near_dedup import op4_near_dedup
from storytrack.llm.pieces import op3_sentencepiece
from storytrack.llm.quality import op2_quality
from storytrack.llm.sharding import op12_sharding
from storytrack.llm.token_store import op5_token_store
from storytrack.llm.toxicity import op6_toxicity
from storytrack.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_site_lines": op8_site_lines,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharding": op12_sharding,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE = {
    "op1_license_scan": OP1_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_site_lines": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
