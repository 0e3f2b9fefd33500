"""Queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from .digest import op4_quartile_digest
from .language_model import op2_bloom_language_model
from .mixing import op8_source_mixing
from .neardup_vectors import SQL as _VECTOR_SQL
from .neardup_vectors import op5_kmeans_neardup
from .packing import op7_vector_packing
from .pii import op3_bootstrapped_pii
from .preferences import SQL as _PREFERENCE_SQL
from .preferences import op6_preference_format
from .secrets import op9_secret_ledger
from .simhash import op10_simhash_pigeonring
from .toxicity import op1_string_kernel_svm

QUERIES = {
    "op1_string_kernel_svm": op1_string_kernel_svm,
    "op2_bloom_language_model": op2_bloom_language_model,
    "op3_bootstrapped_pii": op3_bootstrapped_pii,
    "op4_quartile_digest": op4_quartile_digest,
    "op5_kmeans_neardup": op5_kmeans_neardup,
    "op6_preference_format": op6_preference_format,
    "op7_vector_packing": op7_vector_packing,
    "op8_source_mixing": op8_source_mixing,
    "op9_secret_ledger": op9_secret_ledger,
    "op10_simhash_pigeonring": op10_simhash_pigeonring,
}

SQL: dict[str, str] = {
    "op5_kmeans_neardup": _VECTOR_SQL,
    "op6_preference_format": _PREFERENCE_SQL,
}
