"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat_format import op7_chat_format
from .decontamination import op5_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .line_dedup import OP12_SQL, op12_line_dedup
from .packing import op2_packing
from .periodic_runs import op11_periodic_runs
from .resampling import op13_resampling
from .sharding import op10_feistel_shards
from .simhash import op1_simhash
from .substring_index import op9_substring_index
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op3_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_substring_index": op9_substring_index,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op12_line_dedup": OP12_SQL}
