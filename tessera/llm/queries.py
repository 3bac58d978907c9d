"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .packing import op9_best_fit_packing
from .pieces import op10_sentencepiece
from .rules import op8_quality_rules
from .secrets import OP7_SQL, op7_secret_scan
from .simhash import op2_simhash
from .store import op6_token_store
from .substring import OP5_SQL, op5_substring
from .topk import OP4_SQL, op4_top_k
from .toxicity import op1_toxicity
from .urls import OP3_SQL, op3_url_reputation

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_url_reputation": op3_url_reputation,
    "op4_top_k": op4_top_k,
    "op5_substring": op5_substring,
    "op6_token_store": op6_token_store,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {"op3_url_reputation": OP3_SQL, "op4_top_k": OP4_SQL, "op5_substring": OP5_SQL, "op7_secret_scan": OP7_SQL}
