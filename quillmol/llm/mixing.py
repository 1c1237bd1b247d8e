"""Mixing sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmol.llm.common import copied, counted, discard, gapless, stash
from quillmol.llm.textops import mix64, randoms

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 64
#: Output shards; with the sources they bound the table of counts.
SHARDS = 256
#: A mix is configured by source; beyond this many, sources have to be grouped first.
MAX_SOURCES = 4096
SEED = 20240611


def n_words(text: Column) -> Column:
    """The number of words without making them: places where a word ends."""
    body = F.coalesce(text, F.lit(""))
    return F.regexp_count(body, F.lit(WORDS)).cast("long")


def targets(sizes: list[int], weights: list[float], times: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words wanted of each source: times all sizes shared by weight, none above cap times its size; the
    excess is shared again by weight among the others until none is above."""
    left, out, free = times * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total for i in free}
        full = [i for i in free if share[i] > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = share[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def draw(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts of each source in each shard: multinomial draws given that each source's sum is its slots (so the last
    words wanted are met), made shard by shard without replacement."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for j in range(shards):
        want = int(left.sum()) // (shards - j)
        rest = int(left.sum())
        for i in range(len(slots)):  # the marginals of a multivariate hypergeometric draw
            others = rest - int(left[i])
            if want and left[i]:
                k = _hypergeometric(rng, int(left[i]), others, want)
                out[j, i] = k
                want -= k
            rest = others
        left -= out[j]
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p = good / (good + bad)  # numpy's limit; a binomial draw held to what is left
    return int(min(good, max(n - bad, rng.binomial(n, p))))


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 at x: Feistel rounds over a power of four, walked until inside."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = randoms(4, key)

    def once(v):
        left, right = v >> half, v & low
        for k in keys:
            left, right = right, left ^ (mix64(right * np.uint64(0x9E3779B97F4A7C15) + k) & low)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


SLOT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("src", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("take", T.LongType())])


def slots(spark, sizes: list[int], wanted: list[float], block: int, shards: int, seed: int, per_task: int = 1 << 20) -> DataFrame:
    """Every slot of the mix: its shard, place, source, block index and the words it takes from the block's start.

    A source's slots run through whole passes over its blocks, each pass in its own permuted order, and end
    with a slot that may take fewer words, so that the words wanted are met to within a block.
    """
    blocks = [-(-s // block) for s in sizes]
    passes = [int(w) // s if s else 0 for w, s in zip(wanted, sizes, strict=True)]
    rest = [int(w) - p * s for w, p, s in zip(wanted, passes, sizes, strict=True)]
    counts = [p * b + -(-r // block) for p, b, r in zip(passes, blocks, rest, strict=True)]
    drawn = draw(counts, shards, seed)
    ends = np.cumsum(drawn.ravel())
    base = (np.cumsum(drawn, axis=0) - drawn).ravel()
    shard_begins = np.concatenate(([0], np.cumsum(drawn.sum(axis=1))))[:-1]
    total, n = int(ends[-1]) if len(ends) else 0, len(sizes)

    def fill(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            run = np.searchsorted(ends, at, "right")
            src = run % n
            k = base[run] + at - (ends[run] - drawn.ravel()[run])
            index, take = np.zeros(len(at), np.int64), np.full(len(at), block, np.int64)
            for i in np.unique(src):
                mine = np.flatnonzero(src == i)
                for e in np.unique(k[mine] // blocks[i]):
                    sel = mine[k[mine] // blocks[i] == e]
                    index[sel] = permute(k[sel] % blocks[i], blocks[i], seed + 1009 * int(i) + 7919 * int(e))
                if rest[i] % block:
                    take[mine[k[mine] == counts[i] - 1]] = rest[i] % block
            yield pa.RecordBatch.from_arrays([pa.array(run // n, pa.int32()), pa.array(at - shard_begins[run // n]), pa.array(src, pa.int32()), pa.array(index), pa.array(take)], names=SLOT.names)

    return spark.range(0, total, 1, max(1, -(-total // per_task))).mapInArrow(fill, SLOT)


def sized(docs: DataFrame) -> DataFrame:
    """Distinct rows of doc_id, source, size and a hash of the text, and copies, how many documents are so."""
    return counted(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))


def placed(rows: DataFrame) -> DataFrame:
    """Adds to stashed rows of sized() the start, the words before each in its source, and the source's size. The one order of
    documents, of mix() and of mixed_blocks(): by doc_id and size, those alike in both by the hash of their text, copies in a run."""
    return gapless(rows, ["source"], ["doc_id", "size", "tie"], "start", F.col("size") * F.col("copies"), rows.count(), "source_size")


def plan(at: DataFrame, weights, times: float, cap: float) -> tuple[list, list[int], list[float]]:
    """Sources by code point, null last, their sizes and targets."""
    rows = at.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in rows]
    return [r["source"] for r in rows], sizes, targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], times, cap)


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights=(3.0, 1.0, 2.0), times: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, the words that the mix takes of every document, and tie, a hash of its text.

    Each source's documents, in hash order, are one run of words cut into blocks; slots() says which blocks the
    mix takes and how often; both are joined by block index. A null text has no words and gives nothing; a null source is a
    source of its own, the last. Repeated rows, with words or without, are documents of their own. Other columns are not read. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = stash(sized(docs))
    at = stash(placed(rows))
    discard(rows)
    sources, sizes, wanted = plan(at, weights, times, cap)
    config = [(i, s, float(t)) for i, (s, t) in enumerate(zip(sources, wanted, strict=True))]
    names = spark.createDataFrame(config, "src int, _source string, target double")
    at = at.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # at most MAX_SOURCES rows
    at = copied(at, "copies", "copy").withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    used = slots(spark, sizes, wanted, block, shards, seed).groupBy("src", "block").agg(
        F.sum(F.when(F.col("take") == block, 1).otherwise(0)).alias("_full"), F.max(F.when(F.col("take") < block, F.col("take")).otherwise(0)).alias("_part")
    )
    b = F.lit(block)
    last = F.floor((F.col("start") + F.col("size") - 1) / b)
    parts = at.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), last))))
    lo = F.greatest(F.col("start") - F.col("block") * b, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * b, b)
    parts = parts.withColumn("_lo", lo).withColumn("_hi", hi).join(used, ["src", "block"], "left")
    words = F.coalesce(F.col("_full"), F.lit(0)) * (F.col("_hi") - F.col("_lo")) + F.greatest(F.least(F.coalesce(F.col("_part"), F.lit(0)), F.col("_hi")) - F.col("_lo"), F.lit(0))
    keys = ["doc_id", "source", "size", "source_size", "target", "tie", "copy"]  # a document each
    return parts.groupBy(*keys).agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken")).drop("copy")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights=(3.0, 1.0, 2.0), times: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot, source number and the block's words, joined by a space. Its words of each document are those that
    mix() with the same arguments says are taken. Texts without words are in no block; repeated rows are in as many as they are, other
    columns are not read, and an empty table gives an empty table."""
    spark = docs.sparkSession
    rows = stash(sized(docs))
    at = stash(placed(rows))
    discard(rows)
    sources, sizes, wanted = plan(at, weights, times, cap)
    names = spark.createDataFrame(list(enumerate(sources)), "src int, _source string")
    b = F.lit(block)
    texts = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_s"), F.xxhash64("text").alias("_t"), "text")
    texts = texts.groupBy("_id", "_s", "_t").agg(F.first("text").alias("text"))
    whole = at.where("size > 0").join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("tie") == F.col("_t")))
    whole = copied(whole, "copies", "copy").withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    parts = whole.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_w", F.regexp_extract_all("text", F.lit(f"({WORDS})")))  # names: at most MAX_SOURCES rows
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    lo, hi = F.greatest(F.col("block") * b, F.col("start")), F.least((F.col("block") + 1) * b, F.col("start") + F.col("size"))
    parts = parts.select("src", "block", F.struct("start", F.slice("_w", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("w")).alias("p"))
    blocks = parts.groupBy("src", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"])).alias("w"))
    return slots(spark, sizes, wanted, block, shards, seed).join(blocks, ["src", "block"]).select("shard", "slot", "src", F.array_join(F.slice("w", F.lit(1), F.col("take").cast("int")), " ").alias("text"))
