"""Similarity and fingerprint queries over molecule tables (pos, name, s)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmol.functions import normalize as Z
from quillmol.operators import bpe as B
from quillmol.operators import pair_kernels as P
from quillmol.plans import registry


def cross_similarity(lib: DataFrame, tmpl: DataFrame, method: str = "lingo", **kw) -> DataFrame:
    """lib_name, tmpl_name, method, score of every pair; the library's string is the first argument."""
    out = registry.method(method)(lib.select("name", "s"), tmpl.select("name", "s"), **kw)
    return out.select(F.col("l_name").alias("lib_name"), F.col("t_name").alias("tmpl_name"), F.lit(method).alias("method"), "score")


def self_similarity(mols: DataFrame, method: str = "lingo", **kw) -> DataFrame:
    """Every ordered pair of one table: computed for pos < pos, mirrored, and 1 on the diagonal. Kernels that join pairs take the order in their join."""
    scored = registry.method(method)(mols.select("name", "s", "pos"), mols.select("name", "s", "pos"), **kw).where("l_pos < t_pos")
    upper = scored.select(F.col("l_name").alias("lib_name"), F.col("t_name").alias("tmpl_name"), F.lit(method).alias("method"), "score")
    lower = upper.select(F.col("tmpl_name").alias("lib_name"), F.col("lib_name").alias("tmpl_name"), "method", "score")
    own = mols.select(F.col("name").alias("lib_name"), F.col("name").alias("tmpl_name"), F.lit(method).alias("method"), F.lit(1.0).alias("score"))
    return upper.unionByName(lower).unionByName(own)


def fingerprints(mols: DataFrame, kind: str = "smifp34", pre: bool = True, vocab_path: str | None = None, merges=None) -> DataFrame:
    """name and fp, an array of doubles."""
    what, binary = registry.fingerprint(kind)
    s = F.col("s")
    if isinstance(what, list):
        return mols.withColumn("fp", P.smifp(Z.preprocess(s) if pre else s, what, binary))
    if merges is None:
        if vocab_path is None:
            raise FileNotFoundError("this fingerprint needs a BPE vocabulary: vocab_path")
        merges = B.read_merges(mols.sparkSession, vocab_path, what)
    return mols.withColumn("fp", B.bpe_fingerprint(s, merges[:what] if what else merges, binary))


def wide_scores(scores: DataFrame, lib: DataFrame, templates: list[str]) -> DataFrame:
    """One row per library molecule in its order, one column Similarity_<template> per template, %.5f."""
    table = scores.groupBy("lib_name").pivot("tmpl_name", templates).agg(F.first("score"))
    shown = [F.format_string("%.5f", F.col(f"`{t}`")).alias(f"Similarity_{t}") for t in templates]
    return lib.select("pos", F.col("name").alias("lib_name")).join(table, "lib_name").select("pos", F.col("lib_name").alias("Name"), *shown)


def wide_fingerprints(fps: DataFrame, bits: int) -> DataFrame:
    return fps.select("pos", F.col("name").alias("Name"), *[F.format_string("%.0f", F.element_at("fp", i + 1)).alias(f"bit_{i}") for i in range(bits)])


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each template, ties by name; Spark keeps k rows a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("tmpl_name").orderBy(F.desc("score"), "lib_name"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
