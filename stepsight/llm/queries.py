"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op1_embedding_near_dedup
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language import op8_language
from .licenses import op10_license_scans
from .mixing import op4_mixing
from .packing import op6_packing
from .periodic_runs import op13_periodic_runs
from .quality import op9_quality_rules
from .secret_scan import op5_secret_scans
from .simhash import op2_simhash
from .suffix_dedup import op3_suffix_dedup
from .token_files import op7_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_simhash,
        op3_suffix_dedup,
        op4_mixing,
        op5_secret_scans,
        op6_packing,
        op7_token_files,
        op8_language,
        op9_quality_rules,
        op10_license_scans,
        op11_hard_negatives,
        op12_exact_dedup,
        op13_periodic_runs,
    )
}
SQL: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_exact_dedup": OP12_SQL}
