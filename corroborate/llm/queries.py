"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corroborate.llm import decontamination, mixing, spelling_variants, url_filters
from corroborate.llm.decontamination import op12_decontamination
from corroborate.llm.hilbert import op4_hilbert_sharding
from corroborate.llm.mixing import op3_mixing
from corroborate.llm.ngram_jaccard import op8_ngram_jaccard
from corroborate.llm.onebit_search import op6_onebit_search
from corroborate.llm.packing import op7_best_fit_packing
from corroborate.llm.passages import op1_passages
from corroborate.llm.periodic_runs import op13_periodic_runs
from corroborate.llm.quality_rules import op2_quality_rules
from corroborate.llm.spelling_variants import op11_spelling_variants
from corroborate.llm.token_counts import op9_token_counts
from corroborate.llm.toxicity import op5_toxicity
from corroborate.llm.url_filters import op10_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_passages, op2_quality_rules, op3_mixing, op4_hilbert_sharding, op5_toxicity, op6_onebit_search, op7_best_fit_packing, op8_ngram_jaccard, op9_token_counts, op10_url_filters,
        op11_spelling_variants, op12_decontamination, op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_SQL, "op10_url_filters": url_filters.ORACLE_SQL, "op11_spelling_variants": spelling_variants.ORACLE_SQL, "op12_decontamination": decontamination.ORACLE_SQL,
}
