"""Queries of the document operators, and SQL for those that SQL can express."""

from .decontaminate import op8_decontamination
from .filter_audit import SQL as FILTER_AUDIT_SQL
from .filter_audit import op11_filter_audit
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import op2_line_dedup
from .mixing import op1_context_mixing
from .packing import op7_packing
from .private_data import op12_private_data
from .quality import op5_quality
from .repeats import op9_suffix_arrays
from .simhash import op10_simhash
from .token_counts import op6_token_counts
from .token_files import op4_token_files
from .toxicity import op3_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_arrays": op9_suffix_arrays,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_private_data": op12_private_data,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {"op2_line_dedup": LINE_DEDUP_SQL, "op11_filter_audit": FILTER_AUDIT_SQL}
