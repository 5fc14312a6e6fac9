"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from ledgerline.llm.conversation_repair import op11_conversation_repair
from ledgerline.llm.curriculum import OP6_SQL, op6_curriculum
from ledgerline.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from ledgerline.llm.html_text import op8_html_text
from ledgerline.llm.language_id import op3_language_mixture
from ledgerline.llm.nnls_packing import op13_least_squares_packing
from ledgerline.llm.order_minhash import op4_order_minhash
from ledgerline.llm.packing import op2_best_fit_packing
from ledgerline.llm.substring_dedup import op7_substring_dedup
from ledgerline.llm.token_counts import op9_token_counts
from ledgerline.llm.url_filter import OP5_SQL, op5_url_filter
from ledgerline.llm.vantage_tree import op1_vantage_tree
from ledgerline.llm.whitening import op12_whitening

QUERIES = {
    "op1_vantage_tree": op1_vantage_tree,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_mixture": op3_language_mixture,
    "op4_order_minhash": op4_order_minhash,
    "op5_url_filter": op5_url_filter,
    "op6_curriculum": op6_curriculum,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_text": op8_html_text,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_least_squares_packing": op13_least_squares_packing,
}
ORACLE = {
    "op5_url_filter": OP5_SQL,
    "op6_curriculum": OP6_SQL,
    "op10_exact_dedup": OP10_SQL,
}
