"""A corpus pipeline over documents: language, near copies, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmol.llm import langid, mixing, ngram_join, packing, pii
from quillmol.llm.common import discard_since, held, stash

#: Cosine with the nearest prototype below which a text is in none of the languages.
LEAST_SCORE = 0.15
#: Texts of fewer words and fewer letters than these have too few to tell. Of passages of 60 letters in known languages 1 % are under
#: LEAST_SCORE, as of those of 150; of passages of 20 letters 5 %.
FEW_WORDS, FEW_LETTERS = 20, 60
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the learned languages (und, or a cosine under LEAST_SCORE in texts of FEW_WORDS
    words or FEW_LETTERS letters or more; shorter ones have too few letters to tell), and sets lang where it is null. Each row is judged by its own
    text; other columns are left out; an empty table gives an empty table."""
    model = langid.fit(docs.where(~langid.held_out()))
    scored = langid.label(docs.select(*COLUMNS), model)
    short = (F.length(F.regexp_replace("text", r"\P{L}+", "")) < FEW_LETTERS) & (F.regexp_count("text", F.lit(mixing.WORDS)) < FEW_WORDS)
    kept = scored.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | short))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the least doc_id, and of rows that repeat a doc_id the one of the least
    checksum, which a lost task finds again. Documents without a doc_id are in no group and stay; other columns are left out; an
    empty table gives an empty table."""
    labelled = ngram_join.jaccard_classes(docs)
    named = docs.select(*COLUMNS).where("doc_id is not null")
    kept = labelled.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    found = named.join(kept, F.col("doc_id") == F.col("_id"))
    check = F.xxhash64(*COLUMNS)
    least = found.where("_rows > 1").groupBy("doc_id").agg(F.min(check).alias("_least")).select(F.col("doc_id").alias("_same"), "_least")
    several = found.where("_rows > 1").join(least, F.col("doc_id") == F.col("_same")).where(check == F.col("_least")).select(*COLUMNS).dropDuplicates(["doc_id"])
    alone = found.where("_rows = 1").select(*COLUMNS)
    return alone.unionByName(several).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, row by row. A null text stays null; other columns are left out; an empty table gives an
    empty table."""
    out = pii.redact_documents(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it: taken / size times, the fraction by a draw from its hash, so that
    documents stay whole and the expected words are those taken. Rows meet their share by doc_id, source and text, and equal ones draw by
    their place in the table too, so documents without a doc_id are no one group. A document without words stays once; other
    columns are left out; an empty table gives an empty table."""
    mixed = mixing.mix(docs).groupBy("doc_id", "source", "tie").agg(F.sum("taken").alias("_t"), F.sum("size").alias("_s"), F.count(F.lit(1)).alias("_n"))
    share = (F.col("_t") / F.when(F.col("_s") > 0, F.col("_s"))).alias("_r")
    taken = mixed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("tie").alias("_tie"), share, "_n")
    rows = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_hash") == F.col("_tie")))
    by = F.xxhash64("doc_id", "_hash", F.when(F.col("_n") > 1, F.col("_place")), F.lit("mixture"))
    draw = F.pmod(by, F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.coalesce(F.floor(F.col("_r") + draw), F.lit(1)).cast("int")
    return joined.withColumn("_k", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; one row per piece. A null or empty text is its end mark."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("private_data", private_data), ("mixture", mixture), ("packing", packing_stage)]

#: The stages learn, hash and tokenise: no SQL can say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = held()
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        discard_since(spark, before, docs)  # what the stage read and stashed
    return STAGES[-1][1](spark, docs, sf_dir)
