"""Quality rules as a ledger: each rule is evaluated once, its failure is a bit beside the measurements; policies are
masks over the bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmol.llm import textops as X

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
LEDGER = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(m, T.LongType()) for m in MEASURES]])

#: Bits of the ledger, by name: conditions on measurements, in whole numbers.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * word_chars"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "n_words >= 20 and word_chars < 2 * n_words"),
    ("long_words", "n_words >= 20 and word_chars > 20 * n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def measure_rows(raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The measurements of each row of a byte array."""
    m = len(offs) - 1
    starts, ends, rows = X.word_bounds(raw, offs)
    n_words = np.bincount(rows, minlength=m)
    at = np.repeat(np.arange(m), np.diff(offs))
    sep = X.is_separator(raw)
    chars = np.bincount(at[~sep & ((raw & 0xC0) != 0x80)], minlength=m)
    symbols = np.bincount(at[np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))], minlength=m)
    hashes, first = X.window_hashes(X.word_hashes(raw, starts, ends), rows, WINDOW)
    repeated = np.zeros(len(starts), np.int64)
    if len(hashes):
        row = rows[first].astype(np.uint64)
        order = np.lexsort((hashes, row))
        same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(starts) + 1, np.int64)
        edge[first[twice]] += 1
        np.subtract.at(edge, first[twice] + WINDOW, 1)
        repeated = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
    n_repeat = np.bincount(rows, repeated, minlength=m).astype(np.int64)
    dup, lines_n = np.zeros(m, np.int64), np.zeros(m, np.int64)
    data = raw.tobytes()
    space = b" \t\n\x0b\x0c\r"
    for i in range(m):
        lines = [x for x in data[offs[i] : offs[i + 1]].split(b"\n") if x.strip(space)]
        lines_n[i] = len(lines)
        if len(lines) > 1:
            dup[i] = len(lines) - len(set(lines))
    return [n_words, chars, symbols, dup, n_repeat, lines_n]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text; a null text has no words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, raw, offs in X.pieces(batch.column(1)):
                cols = measure_rows(raw, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c, pa.int64()) for c in cols]], names=LEDGER.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LEDGER)


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and failed: bit i is set if rule i fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measures(docs).withColumn("failed", total.cast("long"))


def judge(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Applies a policy: kept unless one of its bits is set."""
    return entries.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of the policy: failures, those that it alone rejects, and what is kept without it. One aggregation."""
    n, whole = F.count(F.lit(1)), mask(policy)
    failed = F.col("failed").bitwiseAND(F.lit(whole))
    count = lambda c: F.count(F.when(c, 1))
    rows = []
    for name in POLICIES[policy]:
        bit = 1 << BIT[name]
        rows.append(F.struct(F.lit(name).alias("rule"), count(failed.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"), count(failed == bit).alias("n_alone"), count(failed.bitwiseAND(F.lit(whole & ~bit)) == 0).alias("n_kept_without"), n.alias("n_documents")))
    return entries.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quality(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, the measurements, failed, base_failed and kept for every document.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. A null or empty text has no words and
    fails. Repeated rows are judged each; a null doc_id stays null; other columns are left out.
    """
    base = (1 << BIT["few_words"]) | (1 << BIT["repeated_windows"])
    out = judge(ledger(docs), policy).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(base)) != 0)
    return out.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
