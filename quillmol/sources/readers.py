"""Molecule files as tables (pos, name, s)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: File names that part a directory's files into runs, each numbered in a task.
SPLITS = 255


def column(arg: str | int | None):
    """"2" is a place, "ID" a header name."""
    return int(arg) if isinstance(arg, str) and arg.isdigit() else arg


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _numbered(rows: DataFrame, bucket: str, order: str, name: str) -> DataFrame:
    """Adds name, the row's number from 0 in order of (bucket, order). bucket depends on the row alone, so no plan's partitions matter: ranks are made
    in each bucket and the counts of the buckets before, a row each, are added."""
    counts = rows.groupBy(F.col(bucket).alias("_b")).agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_b", F.coalesce(before, F.lit(0).cast("long")).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(order)) - 1
    return rows.withColumn("_r", rank.cast("long")).join(F.broadcast(offsets), F.col(bucket) == F.col("_b")).withColumn(name, F.col("_o") + F.col("_r")).drop("_b", "_o", "_r")  # offsets: a row for each split of the file


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and pos, the line's number, and the split of the file that it is in: a split's lines are read in order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_split"))
    return _numbered(text.withColumn("_at", F.monotonically_increasing_id()), "_split", "_at", "pos").drop("_at")


def read_first(spark: SparkSession, path: str) -> DataFrame:
    """name and s of one whole file: its first word is the string, its second the name, else the file's stem."""
    return _first_words(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))).select("name", "s")


def _first_words(files: DataFrame) -> DataFrame:
    words = F.split(_strip(F.col("value")), r"\s+")
    return files.select("file", words[0].alias("s"), F.coalesce(F.get(words, F.lit(1)), F.regexp_replace("file", r"\.[^.]*$", "")).alias("name"))


def read_file(spark: SparkSession, path: str, smiles_col: str | int | None = None, name_col: str | int | None = None, delimiter: str | None = None, header: bool = True, skip_errors: bool = True) -> DataFrame:
    """One file. Delimiter by extension (.csv comma, .tsv tab, else white space); .smi and .smiles have no header, all others
    do unless header is False. Blank and # lines are skipped, as are rows without a string; a row without a name column is mol_1, mol_2, ...;
    a repeated name gets the first free suffix _1, _2, ..."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    delimiter = delimiter or {"csv": ",", "tsv": "\t"}.get(ext)
    if ext in ("smi", "smiles"):
        header = False
    smiles_col, name_col = column(0 if smiles_col is None else smiles_col), column(1 if name_col is None else name_col)
    cut = (lambda c: F.split(c, re.escape(delimiter))) if delimiter else (lambda c: F.split(c, r"\s+"))
    lines = _lines(spark, path)
    if header:
        first = lines.where("pos = 0").select(cut(_strip(F.col("value"))).alias("v")).collect()
        names = first[0]["v"] if first else []
        for which in (smiles_col, name_col):
            if isinstance(which, str) and which not in names:
                raise ValueError(f"no column {which!r} in the header")
        smiles_col, name_col = [names.index(c) if isinstance(c, str) else c for c in (smiles_col, name_col)]
        lines = lines.where("pos > 0")
    elif isinstance(smiles_col, str) or isinstance(name_col, str):
        raise ValueError("a column name needs a header")
    rows = lines.withColumn("value", _strip(F.col("value"))).where("value <> '' and not startswith(value, '#')").withColumn("v", cut(F.col("value")))
    if not skip_errors and rows.where(F.size("v") <= smiles_col).limit(1).count():
        raise ValueError("a row has no string column")
    rows = rows.where(F.size("v") > smiles_col).select("pos", "_split", _strip(F.get("v", F.lit(smiles_col))).alias("s"), _strip(F.get("v", F.lit(name_col))).alias("name")).where("s <> ''")
    unnamed = _numbered(rows.where("name is null"), "_split", "pos", "_i").select("pos", "s", F.format_string("mol_%d", F.col("_i") + 1).alias("name"))
    return unique_names(rows.where("name is not null").select("pos", "s", "name").unionByName(unnamed))


def unique_names(mols: DataFrame) -> DataFrame:
    """Gives repeated names their first free suffix in order of pos. Only roots (names without trailing _digits) with a repeat are folded;
    a generated name always has the root of its own."""
    rooted = mols.withColumn("_root", F.regexp_replace("name", r"(_\d+)+$", ""))
    repeated = rooted.groupBy("_root", "name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_root").distinct()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken = rows.sort_values("pos"), set()
        out = []
        for name in rows["name"]:
            new, i = name, 0
            while new in taken:
                i += 1
                new = f"{name}_{i}"
            taken.add(new)
            out.append(new)
        return rows.assign(name=out)[["pos", "name", "s"]]

    fixed = rooted.join(repeated, "_root", "left_semi").select("pos", "name", "s", "_root").groupBy("_root").applyInPandas(fold, "pos long, name string, s string")
    return rooted.join(repeated, "_root", "left_anti").select("pos", "name", "s").unionByName(fixed)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The first molecule of every .smi file of a directory: its second word is its name, else the file's stem. Of one name the last file's string stays, at the first
    one's place."""
    files = spark.read.option("pathGlobFilter", "*.smi").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    kept = _first_words(files).where("s <> ''").groupBy("name").agg(F.max_by("s", "file").alias("s"), F.min("file").alias("file"))
    some = sorted(r["file"] for r in kept.select("file").orderBy(F.xxhash64("file"), "file").limit(SPLITS).collect())  # any names part the files into runs
    run = F.size(F.filter(F.array(*map(F.lit, some)).cast("array<string>"), lambda x: x <= F.col("file")))
    return _numbered(kept.withColumn("_run", run), "_run", "file", "pos").select("pos", "name", "s")


def read_molecules(spark: SparkSession, path: str, **options) -> DataFrame:
    """A directory, a file, or FileNotFoundError; options that are None are left out."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        return read_directory(spark, path)
    return read_file(spark, path, **{k: v for k, v in options.items() if v is not None})
