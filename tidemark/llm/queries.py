"""The queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from tidemark.llm import queries_chat, queries_exact, queries_fim, queries_quality, queries_repair, queries_warc
from tidemark.llm.queries_chat import op2_prefix_target_chat
from tidemark.llm.queries_decontaminate import op10_seeded_alignment
from tidemark.llm.queries_exact import op8_block_naming
from tidemark.llm.queries_fim import op12_streaming_matcher
from tidemark.llm.queries_license import op3_patience_license
from tidemark.llm.queries_packing import op5_minimum_bin_slack
from tidemark.llm.queries_pii import op9_candidate_boosting
from tidemark.llm.queries_quality import op11_short_circuit_cascade
from tidemark.llm.queries_repair import op13_edit_lattice
from tidemark.llm.queries_simhash import op7_gray_order_simhash
from tidemark.llm.queries_store import op1_content_store
from tidemark.llm.queries_toxicity import op6_maximum_scoring_segments
from tidemark.llm.queries_warc import op4_seekable_warc

QUERIES = {
    "op1_content_store": op1_content_store,
    "op2_prefix_target_chat": op2_prefix_target_chat,
    "op3_patience_license": op3_patience_license,
    "op4_seekable_warc": op4_seekable_warc,
    "op5_minimum_bin_slack": op5_minimum_bin_slack,
    "op6_maximum_scoring_segments": op6_maximum_scoring_segments,
    "op7_gray_order_simhash": op7_gray_order_simhash,
    "op8_block_naming": op8_block_naming,
    "op9_candidate_boosting": op9_candidate_boosting,
    "op10_seeded_alignment": op10_seeded_alignment,
    "op11_short_circuit_cascade": op11_short_circuit_cascade,
    "op12_streaming_matcher": op12_streaming_matcher,
    "op13_edit_lattice": op13_edit_lattice,
}
SQL = {
    "op2_prefix_target_chat": queries_chat.SQL,
    "op4_seekable_warc": queries_warc.SQL,
    "op8_block_naming": queries_exact.SQL,
    "op11_short_circuit_cascade": queries_quality.SQL,
    "op12_streaming_matcher": queries_fim.SQL,
    "op13_edit_lattice": queries_repair.SQL,
}
