"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.binary_output import op8_token_files
from quarry.llm.decontaminate import op2_decontamination
from quarry.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from quarry.llm.exact_search import OP11_SQL, op11_exact_search
from quarry.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from quarry.llm.html_extract import op3_html_text
from quarry.llm.lexical_search import OP13_SQL, op13_lexical_search
from quarry.llm.license_scan import op5_license_scan
from quarry.llm.near_dedup import op7_near_duplicates
from quarry.llm.packing import op9_best_fit_packing
from quarry.llm.quality import op10_quality
from quarry.llm.token_counts import op1_token_counts
from quarry.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_files": op8_token_files,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality": op10_quality,
    "op11_exact_search": op11_exact_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op11_exact_search": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_lexical_search": OP13_SQL}
