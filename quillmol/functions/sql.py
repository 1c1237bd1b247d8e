"""Pair similarities as SQL functions, for spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillmol.operators import pair_kernels as P

#: Arrow functions by name; edit distance is the built-in levenshtein.
FUNCTIONS = {"lcs_length": ("int", P._lcs), "common_substring_length": ("int", P._run), "damerau_levenshtein": ("int", P._damerau), "jaro": ("double", P._jaro), "jaro_winkler": ("double", P._winkler), "compression_similarity": ("double", P._ncd)}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions (a, b) with the session and returns their names."""
    for name, (kind, f) in FUNCTIONS.items():
        spark.udf.register(name, P._arrow(kind, f))
    return list(FUNCTIONS)
