"""Registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op7_chat_formatting
from .decontamination import op9_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .impact_index import OP12_SQL, op12_ranked_search
from .language_id import op1_language_id
from .license_scan import op10_license_scan
from .lm_scoring import op2_lm_scoring
from .mixing import op6_mixing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .repeated_strings import OP13_SQL, op13_repeated_strings
from .secret_scan import op8_secret_scan
from .simhash import op5_simhash
from .token_counts import op3_token_counts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    each = (
        op1_language_id,
        op2_lm_scoring,
        op3_token_counts,
        op4_exact_dedup,
        op5_simhash,
        op6_mixing,
        op7_chat_formatting,
        op8_secret_scan,
        op9_decontamination,
        op10_license_scan,
        op11_prefix_trie,
        op12_ranked_search,
        op13_repeated_strings,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_repeated_strings": OP13_SQL}
