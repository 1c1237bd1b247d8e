"""Byte-pair merges over atom-level tokens, from a vocabulary file, and fingerprints of merged tokens."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmol.functions.tokens import atoms

#: Merges sent with the function at most, or an error; a vocabulary is a few thousand pairs.
MAX_MERGES = 100_000


def read_merges(spark: SparkSession, path: str, first: int | None = None) -> list[tuple[str, str]]:
    """The first merges of {"merges": [[a, b], ...]}; none if the key is missing."""
    table = spark.read.json(path, multiLine=True)
    if "merges" not in table.columns:
        return []
    ranked = table.select(F.posexplode("merges").alias("rank", "m"))
    rows = (ranked if first is None else ranked.where(F.col("rank") < first)).orderBy("rank").limit(MAX_MERGES + 1).collect()
    if len(rows) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges in {path}")
    return [(r["m"][0], r["m"][1]) for r in rows]


def merge_all(tokens: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """One left-to-right pass for each merge, in rank order. A heap holds the places of adjacent pairs by rank; a pair that a pass makes is of that pass only if
    its rank is later, so what was left behind stays."""
    n = len(tokens)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    parts: list = list(tokens)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or ranks.get((parts[i], parts[j])) != rank:
            continue  # merged meanwhile
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (r := ranks.get((parts[k], parts[after[k]]), -1)) > rank:
                heapq.heappush(heap, (r, k))
    return [p for p in parts if p is not None]


def bpe(s: Column, merges: list[tuple[str, str]]) -> Column:
    ranks = {m: i for i, m in reversed(list(enumerate(merges)))}

    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else merge_all(list(x), ranks))

    return run(atoms(s))


def bpe_fingerprint(s: Column, merges: list[tuple[str, str]], binary: bool = False) -> Column:
    """How often each merge's token is in the final tokens, in rank order."""
    words = [a + b for a, b in merges]

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        def one(x):
            own = pd.Series(list(x)).value_counts() if len(x) else {}
            return [float(min(own.get(w, 0), 1) if binary else own.get(w, 0)) for w in words]

        return t.map(one)

    return run(bpe(s, merges))


def bpe_vocabulary(spark: SparkSession, merges: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, a string, b string")
