"""Exact Jaccard self-join of documents on word shingles by prefixes of token combinations.

Texts with equal shingle sets are one class, which has one node. Then, of the nodes:

1. Windows. Tokens have one global random order, that of their hashes. A set's window is its first n - ceil(0.8 n) + k tokens, k
   = max(2, n / 20). Of two linked sets, the window that ends first misses no more than n - ceil(0.8 n) tokens of the other set, so
   the windows share the lesser k at least. A node whose window has fewer tokens that any other window has links with nothing.
2. Frequencies. Over the whole sets of the nodes left, the tokens are counted and each set is ordered anew, rare
   tokens first. A set with over n - ceil(0.8 n) tokens of its own links with nothing.
3. Prefixes. Frequent tokens fall into s subclasses by their hashes, s growing with the set's size (bands of sizes, so that partners
   agree on it). Two linked sets share s (K - 1) + 1 tokens in their prefixes of n - ceil(0.8 n) + s (K - 1) + 1 tokens in the new order: a
   rare one, indexed alone, or K frequent ones of one subclass, indexed as a combination. A subclass holds a few tokens of a
   prefix, so a set has no more keys than it has tokens, about, whatever its size.
4. Stars. A large group of near copies would give all its pairs. So each token's rows are first held against one of them, the one
   with the least share of tokens of its own: as many candidates as rows. Verified links make components; classes of tokens are counted
   in what components are left, combinations made, and only pairs across components are candidates then. A key of many rows is
   dealt in blocks.

Every candidate is verified on whole sets. No link between components is lost, and pairs within one change none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmol.llm import textops as X
from quillmol.llm.common import discard, free_shuffles, stash
from quillmol.llm.components import components

#: Frequent tokens are indexed in combinations of K.
K = 2
SHINGLE = 5
#: The border of the two classes of tokens: a token in the prefixes of more rows than this, of several components, is frequent.
FREQUENT = 24
#: Windows hold a further n / WINDOW tokens.
WINDOW = 20
#: Bands of set sizes: partners of sizes within 4 : 5 are in one band or in neighbouring ones.
BAND = 1.3
#: Sizes for each subclass of frequent tokens: a prefix has n / 5 tokens and one more for each subclass.
SUBCLASS = 10
#: Subclasses of the sets of each band; the last band begins beyond 10 ** 12 tokens.
SUBCLASSES = [max(1, int(BAND**b / SUBCLASS)) for b in range(107)]
#: Longs of a set's parity bits.
LONGS = 4
#: Rows of a key that meet in one task; a key of more is dealt in blocks.
BLOCK = 2048
#: Rows of a star that one task's stream holds against a centre before the centre's set is sent again.
STAR = 64
#: A token in more than 4 / HOT of all rows, so HOT / 4 tokens at most, is hot: its count is broadcast and its rows are not gathered.
HOT = 4096

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
SAME = ["n", "s1", "s2"]


def window_length(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + max(2, n // WINDOW))


def set_rows(docs: DataFrame, whole: bool) -> DataFrame:
    """doc_id, set size, two checksums of the set, and its sorted hashes: all, or its window."""

    def run(batches):
        import pyarrow as pa

        salt = np.uint64(0x5851F42D4C957F2D)
        for batch in batches:
            for i, j, raw, offs in X.pieces(batch.column(1)):
                sets = X.shingle_sets(raw, offs, SHINGLE)
                n = np.array([len(s) for s in sets], np.int64)
                s1 = np.array([s.sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                s2 = np.array([X.mix64(s + salt).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                cut = sets if whole else [s[: window_length(len(s))] for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int32)
                flat = np.concatenate(cut).view(np.int64) if len(cut) else np.empty(0, np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(s1), pa.array(s2), tokens], names=ROW.names)

    return docs.mapInArrow(run, ROW)


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard of 0.8 or more."""
    if not len(x) or not len(y) or 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link. Each pair brings the set of b to a stream sorted by a, which holds the set of one a at a time;
    an a of many pairs is split over salts."""
    salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / STAR) + 1).alias("_salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("_salts")))
    side = salted.join(sets.select(F.col("node").alias("b"), "tokens"), "b").select("a", "salt", F.lit(1).alias("side"), "b", "tokens")
    centre = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), "tokens"), "a").select("a", "salt", F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "tokens")

    def run(batches):
        import pyarrow as pa

        own, held = None, None
        for batch in batches:
            a, b = [], []
            for x, z, s, y, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                these = h.values.to_numpy()  # sorted as unsigned
                if s == 0:
                    own, held = (x, z), these
                    continue
                if own != (x, z):
                    raise RuntimeError("a pair came without its first set")
                if _links(held.view(np.uint64), these.view(np.uint64)):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=LINK.names)

    rows = side.unionByName(centre).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return rows.mapInArrow(run, LINK)


def _can_link(x: str, y: str, extra: str):
    """Sizes and places of a shared key allow a link: the tokens before it that others have, and those at and after it, must
    reach the overlap; and the key lies in the prefixes, longer by extra, that this pair's overlap takes."""
    return F.expr(
        f"5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n) and "
        f"9 * (least({x}.pos - {x}.own, {y}.pos - {y}.own) + least({x}.n - {x}.pos, {y}.n - {y}.pos)) >= 4 * ({x}.n + {y}.n) and "
        f"9 * (least({x}.n - {x}.last, {y}.n - {y}.last) + {extra}) >= 4 * ({x}.n + {y}.n)"
    )


def _parities():
    """Whether an even or odd number of a set's shared tokens (the array t) falls on each of 64 * LONGS bits."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"b{i}") for i in range(LONGS)])
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    at = lambda x: F.pmod(F.shiftright(x, 6), F.lit(LONGS))
    return F.aggregate("t", zero, lambda a, x: F.struct(*[F.when(at(x["token"]) == i, a[f"b{i}"].bitwiseXOR(bit(x["token"]))).otherwise(a[f"b{i}"]).alias(f"b{i}") for i in range(LONGS)]))


def _near_enough(x: str, y: str):
    """Tokens of their own and bits of another parity are no more than the tokens that only one of two linked sets has."""
    apart = " + ".join(f"bit_count({x}.bits.b{i} ^ {y}.bits.b{i})" for i in range(LONGS))
    return F.expr(f"{x}.own + {y}.own + {apart} <= {x}.n + {y}.n - 2 * ((4 * ({x}.n + {y}.n) + 8) div 9)")


def _band(n):
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(BAND)))).cast("int")


def _subclasses(band):
    return F.element_at(F.array(*map(F.lit, SUBCLASSES)), band + 1)


def combinations_of(t, k: int):
    """All combinations of k of the array t of (pos, token), in order, as (key, pos of the first, last)."""
    out = F.transform(t, lambda x, i: F.struct(x["token"].alias("key"), x["pos"].alias("pos"), x["pos"].alias("last"), (i + 1).alias("next")))
    for _ in range(k - 1):
        out = F.flatten(F.transform(out, lambda c: F.transform(F.slice(t, c["next"] + 1, F.size(t) - c["next"]), lambda x, i: F.struct(F.xxhash64(c["key"], x["token"]).alias("key"), c["pos"].alias("pos"), x["pos"].alias("last"), (c["next"] + i + 1).alias("next")))))
    return out


def _keys(rows: DataFrame) -> DataFrame:
    """Index keys (key, node, n, own, pos, last, s, own_band, comp) of rows whose tokens have their class: rare ones alone, and of frequent ones the
    combinations of K within a subclass. A set is indexed with the subclasses of its own band and with those of the band below it, for
    partners there; of two such partners the lesser is in its own band."""
    shared = ["node", "n", "own", "comp"]
    rare = rows.where("not frequent").select(F.xxhash64(F.lit(1), "token").alias("key"), *shared, "pos", "last", _subclasses(_band(F.col("n"))).alias("s"), F.lit(True).alias("own_band"))
    bands = F.array(F.struct(_band(F.col("n")).alias("band"), F.lit(True).alias("own_band")), F.struct((_band(F.col("n")) - 1).alias("band"), F.lit(False).alias("own_band")))
    dealt = rows.where("frequent").select(*shared, "token", "pos", F.explode(bands).alias("b")).select(*shared, "token", "pos", "b.*").where("band >= 0").withColumn("s", _subclasses(F.col("band")))
    dealt = dealt.where(f"pos <= n - (4 * n + 4) div 5 + s * {K - 1}").withColumn("sub", F.pmod(F.xxhash64("token", "band"), F.col("s")))
    lists = dealt.groupBy(*shared, "own_band", "band", "s", "sub").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))  # a few tokens of a prefix
    made = lists.where(F.size("t") >= K).select(*shared, "own_band", "band", "s", F.explode(combinations_of(F.col("t"), K)).alias("c"))
    combined = made.select(F.xxhash64(F.lit(K), "band", "c.key").alias("key"), *shared, "c.pos", "c.last", "s", "own_band")
    return rare.unionByName(combined)


def _across(rows: DataFrame, bits: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of different components, and a table to discard after their use. bits: node and its parity bits."""
    key_spans = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi").select("token", (F.col("k") > FREQUENT).alias("frequent"))
    keys = _keys(_with_token(rows, key_spans, hot))
    # a row stays if its key lies in its prefix even for the least partner that the key has
    least = keys.groupBy("key").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").drop("lo", "hi")
    keys = stash(keys.join(least, "key").where(f"9 * (n - last + s * {K - 1}) >= 4 * (n + greatest(least, (4 * n + 4) div 5))").drop("least"))
    split = keys.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi").select("key", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    met_keys = keys.join(split, "key").join(bits, "node")
    ones = met_keys.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    all_blocks = met_keys.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = F.expr("x.key = y.key and x.block = y.block and x.comp < y.comp and (x.own_band or y.own_band)") & _can_link("x", "y", f"least(x.s, y.s) * {K - 1}") & _near_enough("x", "y")
    pairs = ones.alias("x").join(all_blocks.alias("y"), met)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), keys


def _hot_tokens(rows: DataFrame) -> list[tuple[int, int]]:
    """(token, df) of the hot tokens. Rows are counted in HOT buckets, and tokens in the buckets that are large enough to hold a hot one;
    both counts have partial sums."""
    bucket = F.pmod("token", F.lit(HOT))
    sizes = [tuple(r) for r in rows.groupBy(bucket.alias("b")).count().collect()]  # HOT rows at most
    limit = 4 * sum(n for _, n in sizes) // HOT
    large = [b for b, n in sizes if n > max(1, limit)]
    if not large:
        return []
    found = rows.where(bucket.isin(large)).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max(1, limit))
    return [tuple(r) for r in found.collect()]


def _with_token(rows: DataFrame, table: DataFrame, hot: list[int]) -> DataFrame:
    """rows joined with a table of one row per token. What the table has on the hot tokens is broadcast."""
    if not hot:
        return rows.join(table, "token")
    is_hot = F.col("token").isin(hot)
    return rows.where(~is_hot).join(table, "token").unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), "token"))


def _shared(rows: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """Rows (node, n, token) whose token another node has, with its df. Rows of hot tokens are dealt by node and take the df given."""
    if not hot:
        return rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    known = F.broadcast(rows.sparkSession.createDataFrame(hot, "token long, _df long"))  # HOT / 4 rows at most
    dealt = rows.join(known, "token", "left").withColumn("_deal", F.when(F.col("_df").isNotNull(), F.xxhash64("node")))
    count = F.count(F.lit(1)).over(Window.partitionBy("token", "_deal"))
    return dealt.withColumn("df", F.coalesce("_df", count)).where("df > 1").drop("_df", "_deal")


def _open_nodes(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, list]:
    """Step 1: the nodes that may link, and what may be discarded after their use. Tokens that are hot in all rows, copies
    too, count as shared, which leaves no fewer nodes."""
    hot = _hot_tokens(rows.where("n > 1").select(F.explode("tokens").alias("token")))
    windows = rows.where("n > 1").select("row", "tokens").join(nodes.where("n > 1").select("row", "node", "n"), "row")
    shared = stash(_shared(windows.select("node", "n", F.explode("tokens").alias("token")), hot).drop("df"))
    free_shuffles(rows.sparkSession)
    least_k = F.expr(f"greatest(2, ((4 * n + 4) div 5) div {WINDOW})")
    enough = lambda df: df.groupBy("node", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_k).select("node")
    again = _shared(shared.join(enough(shared), "node", "left_semi"), hot).drop("df")
    return stash(enough(again)), [shared]


def _prefixes(sets: DataFrame) -> DataFrame:
    """Steps 2 and 3: rows (node, n, own, token, pos, last) of the prefixes; own: how many tokens no other open node has; bits:
    on a node's first row, the parity bits of the tokens that others have."""
    rows = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = _shared(rows, _hot_tokens(rows))
    lists = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).withColumn("own", F.col("n") - F.size("t"))
    alive = lists.where("n - own >= (4 * n + 4) div 5").withColumn("bits", _parities())
    length = (F.least(F.col("n"), F.expr("n - (4 * n + 4) div 5 + 1") + _subclasses(_band(F.col("n"))) * (K - 1)) - F.col("own")).cast("int")  # tokens of its own come first
    prefix = alive.withColumn("t", F.slice("t", F.lit(1), F.greatest(length, F.lit(0)))).select("node", "n", "own", "bits", F.posexplode("t").alias("i", "x"))
    return prefix.select("node", "n", "own", F.col("x.token").alias("token"), (F.col("own") + F.col("i")).alias("pos"), (F.col("own") + F.col("i")).alias("last"), F.when(F.col("i") == 0, F.col("bits")).alias("bits"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A set is the distinct 5-word shingles of the text, lower-cased in A-Z; fewer words make one; a null or empty text has
    an empty set and is linked with nothing. Links are 100 * intersection >= 80 * union; component_id is the least doc_id
    reachable. Rows of one doc_id are one document in links, each with a row of its own; a row with a null doc_id is
    linked with nothing and its component_id is null. An empty table gives an empty table; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = stash(set_rows(docs, whole=False).withColumn("row", F.monotonically_increasing_id()))
    rows = stash(windows.drop("tokens"))
    classes = rows.where("n > 0 and doc_id is not null").groupBy(*SAME).agg(F.min(F.struct("doc_id", "row")).alias("m")).select(*SAME, F.col("m.doc_id").alias("doc"), "m.row")
    several = classes.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc")  # a doc_id that repeats with other texts
    nodes = stash(classes.join(several.withColumn("_s", F.lit(True)), "doc", "left").withColumn("node", F.when(F.col("_s"), F.xxhash64("doc", *SAME)).otherwise(F.col("doc"))).drop("_s"))

    open_nodes, used = _open_nodes(windows, nodes)
    discard(windows)
    held = nodes.drop("row").join(open_nodes, "node", "left_semi").withColumnRenamed("doc", "doc_id")
    texts = docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = stash(set_rows(texts, whole=True).join(held, ["doc_id", *SAME]).dropDuplicates(["doc_id", *SAME]).select("node", "n", "tokens"))
    discard(open_nodes, *used)

    prefixes = stash(_prefixes(sets))
    free_shuffles(docs.sparkSession)
    centre = F.max(F.struct((-F.col("own") / F.col("n")).alias("w"), (-F.col("node")).alias("d"), "n", "own", "pos", "last"))
    hot = [t for t, _ in _hot_tokens(prefixes)]
    short = prefixes.where("pos <= n - (4 * n + 4) div 5")  # two linked sets share a token here
    best = short.groupBy("token").agg(centre.alias("c")).select("token", F.struct((-F.col("c.d")).alias("node"), "c.n", "c.own", "c.pos", "c.last").alias("y"))
    row = F.struct("node", "n", "own", "pos", "last").alias("x")
    stars = _with_token(short.select("token", row), best, hot).where(F.expr("x.node <> y.node") & _can_link("x", "y", "0"))
    candidates = stash(stars.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct())
    links = stash(_verified(candidates, sets))
    group = components(links)

    in_group = stash(prefixes.drop("bits").join(group, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    bits = stash(prefixes.where("bits is not null").select("node", "bits"))
    discard(prefixes)
    tried = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, used_keys = _across(in_group, bits, hot)
    more = stash(pairs.join(tried, ["a", "b"], "left_anti"))
    discard(in_group, bits, used_keys)
    known = links.unionByName(_verified(more, sets)).unionByName(_same_ids(rows, nodes))
    final = components(known)
    discard(candidates, links, group, more, sets)

    labelled = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = labelled.join(least, "component").select(*SAME, "component_id")
    out = rows.select("doc_id", *SAME).join(labels, SAME, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _same_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes that rows of one doc_id fall in: none unless a doc_id repeats."""
    repeated = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    held = rows.join(repeated, "doc_id", "left_semi").join(nodes, SAME).select("doc_id", "node")
    return held.join(held.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).distinct()
