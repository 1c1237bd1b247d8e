"""Tokenisers: Column -> array<string>."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmol.functions.normalize import REPLACEMENTS, preprocess, ring_numbers

#: The two-letter elements of the replacements are also tokens; @-marks other than @@ are not.
CHEMICAL = sorted((k for k in REPLACEMENTS if len(k) == 2), key=lambda k: k != "@@")
CHEMICAL_PATTERN = "|".join(re.escape(k) for k in CHEMICAL) + "|."
# Fixed value: the atom-level pattern of Schwaller et al., ACS Central Science 2019.
ATOM_PATTERN = r"\[[^\]]+\]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9]|."
SELFIES_PATTERN = r"\[[^\[\]]*\]|."


def _all(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"(?d){pattern}"), F.lit(0))  # (?d): a dot leaves out line feeds only


def chemical(s: Column) -> Column:
    return _all(s, CHEMICAL_PATTERN)


def atoms(s: Column) -> Column:
    return _all(s, ATOM_PATTERN)


def selfies_tokens(s: Column) -> Column:
    return _all(s, SELFIES_PATTERN)


def kmers(s: Column, k: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(s.isNotNull(), F.when(F.length(s) >= k, grams).otherwise(F.array().cast("array<string>")))


def lingos(s: Column, q: int = 4, rings: bool = True, pre: bool = True) -> Column:
    s = preprocess(s) if pre else s
    return kmers(ring_numbers(s) if rings else s, q)


def lingo_words(s: Column, q: int = 4) -> Column:
    """LINGOs as a word vectoriser reads them: lower-cased, cut at white space."""
    return F.regexp_extract_all(F.lower(F.array_join(lingos(s, q), " ")), F.lit(r"(?U)[^\s]+"), F.lit(0))


def substrings(s: Column, least: int = 2) -> Column:
    n = F.length(s)
    every = F.flatten(F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda w: F.substring(s, i, w))))
    return F.when(s.isNotNull(), F.when(n >= least, every).otherwise(F.array().cast("array<string>")))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Word n-grams of low .. high tokens, joined by spaces."""

    def of(k):
        grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
        return F.when(F.size(tokens) >= k, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(k) for k in range(low, high + 1)])


TOKENISERS = {"smiles": chemical, "schwaller": atoms, "selfies": selfies_tokens}
