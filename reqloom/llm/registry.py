"""The training-data queries and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from reqloom.llm.decontaminate import OP2_SQL, op2_decontamination
from reqloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from reqloom.llm.katz import op10_katz
from reqloom.llm.packing import op3_packing
from reqloom.llm.quality import op7_quality
from reqloom.llm.secrets_scan import op5_secrets
from reqloom.llm.simhash import op1_simhash
from reqloom.llm.tokens import op8_token_counts
from reqloom.llm.url_filter import OP6_SQL, op6_url_filter
from reqloom.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secrets": op5_secrets,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_katz": op10_katz,
}
ORACLE_SQL = {
    "op2_decontamination": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op9_warc": OP9_SQL,
}
