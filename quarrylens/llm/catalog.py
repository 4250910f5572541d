"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_ann
from .fingerprint import op9_fingerprint
from .html_main import op3_html_text
from .langid import op2_language_id
from .lm import OP5_SQL, op5_lm_score
from .mixing import OP10_SQL, op10_mixing
from .neardup import op1_near_dedup
from .packing import op7_packing
from .quality import op8_quality
from .tokencount import op6_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_language_id": op2_language_id,
        "op3_html_text": op3_html_text,
        "op4_ann": op4_ann,
        "op5_lm_score": op5_lm_score,
        "op6_token_counts": op6_token_counts,
        "op7_packing": op7_packing,
        "op8_quality": op8_quality,
        "op9_fingerprint": op9_fingerprint,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_score": OP5_SQL, "op10_mixing": OP10_SQL}
