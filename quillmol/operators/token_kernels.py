"""Token similarities as inverted-index joins: tokens are counted per molecule and joined on the token, so only pairs that
share a token are touched; the dense result is filled once at the end."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmol.functions import tokens as K
from quillmol.functions.normalize import preprocess, ring_numbers

#: Templates of so many bytes of names and strings at most, and so many rows, are broadcast for the dense result; more are cross-joined by a shuffle.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 200_000


def pairs(lib: DataFrame, tmpl: DataFrame) -> DataFrame:
    """Every (library, template) pair of (name, s) sides, as columns l_*, t_*."""
    left = lib.select([F.col(c).alias(f"l_{c}") for c in lib.columns])
    right = tmpl.select([F.col(c).alias(f"t_{c}") for c in tmpl.columns])
    said = [F.octet_length(F.col(c).cast("string")) for c, kind in tmpl.dtypes if kind == "string"]
    rows, size = tmpl.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(map(lambda x: F.coalesce(x, F.lit(0)), said), F.lit(8 * len(tmpl.columns) + 300))), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES  # 300: a fingerprint's bytes
    return left.crossJoin(F.broadcast(right) if small else right)


def counted(side: DataFrame, make: Callable[[Column], Column], p: str) -> DataFrame:
    return side.select(F.col("name").alias(f"{p}_name"), F.explode(make(F.col("s"))).alias("tok")).groupBy(f"{p}_name", "tok").agg(F.count(F.lit(1)).alias(f"{p}_n"))


def _totals(counts: DataFrame, p: str) -> DataFrame:
    n = F.col(f"{p}_n")
    return counts.groupBy(f"{p}_name").agg(F.count(F.lit(1)).alias(f"{p}_u"), F.sum(n).alias(f"{p}_sum"), F.sum(n * n).alias(f"{p}_sq"))


def overlaps(lib: DataFrame, tmpl: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """Every pair with its counts: u, sum and sq of each side, and of what both have shared (tokens), least (sum of the lesser
    counts), ratio (sum of 2 least / (n + m)) and dot."""
    lc, tc = counted(lib, make, "l"), counted(tmpl, make, "t")
    low = F.least("l_n", "t_n")
    met = lc.join(tc, "tok").groupBy("l_name", "t_name").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(low).alias("least"), F.sum(2.0 * low / (F.col("l_n") + F.col("t_n"))).alias("ratio"), F.sum(F.col("l_n") * F.col("t_n")).alias("dot")
    )
    lib2 = lib.join(_side(lc, "l"), "name", "left")
    tmpl2 = tmpl.join(_side(tc, "t"), "name", "left")
    out = pairs(lib2.fillna(0), tmpl2.fillna(0)).join(met, ["l_name", "t_name"], "left")
    return out.fillna(0, ["shared", "least", "ratio", "dot"])


def _side(counts: DataFrame, p: str) -> DataFrame:
    t = _totals(counts, p)
    return t.select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_u").alias("u"), F.col(f"{p}_sum").alias("sum"), F.col(f"{p}_sq").alias("sq"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def lingo(lib: DataFrame, tmpl: DataFrame, q: int = 4, pre: bool = True) -> DataFrame:
    o = overlaps(lib, tmpl, lambda s: K.lingos(s, q, pre=pre))
    u = F.col("l_u") + F.col("t_u") - F.col("shared")
    return o.withColumn("score", F.when(u == 0, 1.0).otherwise(_ratio(F.col("ratio"), u)))


def tversky(lib: DataFrame, tmpl: DataFrame, alpha: float = 0.9, beta: float = 0.1, q: int = 4, pre: bool = True, query: str = "library") -> DataFrame:
    """query: the side whose surplus alpha weighs."""
    o = overlaps(lib, tmpl, lambda s: K.lingos(s, q, pre=pre))
    i = F.col("least").cast("double")
    first, second = (F.col("l_sum"), F.col("t_sum")) if query == "library" else (F.col("t_sum"), F.col("l_sum"))
    return o.withColumn("score", F.when((F.col("l_sum") == 0) & (F.col("t_sum") == 0), 1.0).otherwise(_ratio(i, i + F.lit(alpha) * (first - i) + F.lit(beta) * (second - i))))


COEFFICIENTS = ("tanimoto", "dice", "cosine")


def _coefficient(name: str, dot: Column, a: Column, b: Column) -> Column:
    if name not in COEFFICIENTS:
        raise ValueError(f"coefficient is one of {', '.join(COEFFICIENTS)}")
    dot, a, b = dot.cast("double"), a.cast("double"), b.cast("double")
    return {"tanimoto": _ratio(dot, a + b - dot), "dice": _ratio(2 * dot, a + b), "cosine": _ratio(dot, F.sqrt(a) * F.sqrt(b))}[name]


def _prepared(df: DataFrame, pre: bool) -> DataFrame:
    return df.withColumn("s", preprocess(F.col("s"))) if pre else df


def _short(k: int, score: Column) -> Column:
    """Strings under k: equal ones of both score 1, all others 0."""
    a, b = F.length("l_s") < k, F.length("t_s") < k
    return F.when(a & b, (F.col("l_s") == F.col("t_s")).cast("double")).when(a | b, 0.0).otherwise(score)


def spectrum(lib: DataFrame, tmpl: DataFrame, k: int = 4, coefficient: str = "tanimoto", pre: bool = True, rings: bool = False) -> DataFrame:
    lib, tmpl = _prepared(lib, pre), _prepared(tmpl, pre)
    score = _coefficient(coefficient.lower(), F.col("dot"), F.col("l_sq"), F.col("t_sq"))
    return overlaps(lib, tmpl, lambda s: K.lingos(s, k, rings=rings, pre=False)).withColumn("score", _short(k, score))


def substring(lib: DataFrame, tmpl: DataFrame, least: int = 2, normalized: bool = True, pre: bool = True) -> DataFrame:
    o = overlaps(_prepared(lib, pre), _prepared(tmpl, pre), lambda s: K.substrings(s, least))
    return o.withColumn("score", _ratio(F.col("dot").cast("double"), F.sqrt(F.col("l_sq").cast("double") * F.col("t_sq"))) if normalized else F.col("dot").cast("double"))


def _common_neighbours(k: int, m: int, h: int, a: Column) -> Column:
    """How many strings of k letters, of a, lie within m mismatches of both of two that differ in h places: i places as the first, j as the second
    and the rest of the h otherwise, and t of the others changed."""
    out = F.lit(0.0)
    for i in range(h + 1):
        for j in range(h - i + 1):
            for t in range(k - h + 1):
                if h - i + t <= m and h - j + t <= m:
                    other = h - i - j
                    ways = math.comb(h, i) * math.comb(h - i, j) * math.comb(k - h, t)
                    out = out + F.lit(float(ways)) * (F.pow(a - 2, F.lit(other)) if other else F.lit(1.0)) * (F.pow(a - 1, F.lit(t)) if t else F.lit(1.0))
    return out


def _near(vocabulary: DataFrame, k: int, apart: int) -> DataFrame:
    """Pairs of k-mers (tok, tok2, h) that differ in h <= apart places. They meet on their forms with that many places blanked, not all with all."""
    spots = list(combinations(range(1, k + 1), min(apart, k)))
    kept = [F.concat(F.lit(""), *[F.substring("tok", i, 1) for i in range(1, k + 1) if i not in s]) for s in spots]
    forms = vocabulary.select("tok", F.explode(F.array(*[F.struct(F.lit(n).alias("spot"), c.alias("rest")) for n, c in enumerate(kept)])).alias("b")).select("tok", "b.*")
    met = forms.join(forms.withColumnRenamed("tok", "tok2"), ["spot", "rest"]).select("tok", "tok2").distinct()
    return met.withColumn("h", F.expr(f"aggregate(sequence(1, {k}), 0, (a, i) -> a + if(substring(tok, i, 1) = substring(tok2, i, 1), 0, 1))"))


def _neighbours(tokens: Column, m: int, alphabet: str) -> Column:
    """Every k-mer's strings within m mismatches, changed letters being of the alphabet; each k-mer gives its own."""
    letters = F.array(*[F.lit(c) for c in alphabet])

    def changed(w):
        places = F.sequence(F.lit(1), F.length(w))
        return F.concat(F.array(w), F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(F.substring(w, F.lit(1), i - 1), c, F.substring(w, i + 1, F.length(w)))))))

    def all_of(w):
        out = F.array(w)
        for _ in range(m):
            out = F.array_distinct(F.flatten(F.transform(out, changed)))
        return out

    return F.flatten(F.transform(tokens, all_of))


def mismatch(lib: DataFrame, tmpl: DataFrame, k: int = 4, m: int = 1, coefficient: str = "tanimoto", pre: bool = True, rings: bool = False, alphabet: str | None = None) -> DataFrame:
    """Up to m mismatches, in closed form: two k-mers at Hamming distance h <= 2 m share _common_neighbours, with the letters of the pair of strings as
    alphabet. m = 0, or fewer than two letters, is spectrum(). Library and templates meet once, each string's norm takes its own k-mers only. With an
    alphabet given, neighbours are made one by one."""
    if m < 0:
        raise ValueError("m is 0 at least")
    if m == 0 or alphabet is not None and len(alphabet) < 2:
        return spectrum(lib, tmpl, k, coefficient, pre, rings)
    lib, tmpl = _prepared(lib, pre), _prepared(tmpl, pre)
    if rings:
        lib, tmpl = (d.withColumn("s", ring_numbers(F.col("s"))) for d in (lib, tmpl))
    if alphabet is not None:
        score = _coefficient(coefficient.lower(), F.col("dot"), F.col("l_sq"), F.col("t_sq"))
        return overlaps(lib, tmpl, lambda s: _neighbours(K.kmers(s, k), m, "".join(sorted(set(alphabet))))).withColumn("score", _short(k, score))
    reach = min(2 * m, k)
    make = lambda s: K.kmers(s, k)
    lc, tc = counted(lib, make, "l"), counted(tmpl, make, "t")
    near = _near(lc.select("tok").unionByName(tc.select("tok")).distinct(), k, reach)
    sums = lambda w, p: [F.sum(F.when(F.col("h") == h, w).otherwise(0)).alias(f"{p}{h}") for h in range(reach + 1)]
    met = lc.join(near, "tok").join(tc.withColumnRenamed("tok", "tok2"), "tok2").groupBy("l_name", "t_name").agg(*sums(F.col("l_n") * F.col("t_n"), "d"))

    def norms(counts, p):
        other = counts.select(F.col(f"{p}_name"), F.col("tok").alias("tok2"), F.col(f"{p}_n").alias("_n"))
        return counts.join(near, "tok").join(other, [f"{p}_name", "tok2"]).groupBy(f"{p}_name").agg(*sums(F.col(f"{p}_n") * F.col("_n"), p))

    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    out = pairs(lib.withColumn("abc", letters(F.col("s"))), tmpl.withColumn("abc", letters(F.col("s")))).withColumn("A", F.size(F.array_union("l_abc", "t_abc")).cast("double"))
    out = out.join(met, ["l_name", "t_name"], "left").join(norms(lc, "l"), "l_name", "left").join(norms(tc, "t"), "t_name", "left")
    weight = lambda h: F.when(F.col("A") < 2, F.lit(float(h == 0))).otherwise(_common_neighbours(k, m, h, F.col("A")))
    of = lambda p: sum((F.coalesce(F.col(f"{p}{h}"), F.lit(0)).cast("double") * weight(h) for h in range(reach + 1)), F.lit(0.0))
    return out.withColumn("score", _short(k, _coefficient(coefficient.lower(), of("d"), of("l"), of("t"))))


def tfidf_model(corpus: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """tok, idf: ln((1 + N) / (1 + df)) + 1 over the corpus (s); keep it to score later data."""
    n = corpus.agg(F.count(F.lit(1)).alias("_docs"))
    df = corpus.withColumn("_i", F.monotonically_increasing_id()).select("_i", F.explode(F.array_distinct(make(F.col("s")))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("tok", (F.log((1.0 + F.col("_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # n is one row


def word_vectors(mols: DataFrame, make: Callable[[Column], Column], use_idf: bool = True, corpus: DataFrame | None = None) -> DataFrame:
    """name, tok and w: sublinear TF-IDF of length one, learned from the corpus, or the molecules themselves; without use_idf the counts of the
    corpus's tokens."""
    known = tfidf_model(corpus if corpus is not None else mols.select("s"), make)
    counts = counted(mols, make, "l").join(known, "tok").withColumnRenamed("l_name", "name")
    if not use_idf:
        return counts.select("name", "tok", F.col("l_n").cast("double").alias("w"))
    w = counts.withColumn("w", (1.0 + F.log("l_n")) * F.col("idf"))
    return w.select("name", "tok", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("name")))).alias("w"))


def tfidf_of_pairs(lib: DataFrame, tmpl: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """Cosine of TF-IDF vectors whose corpus is the pair alone: a token of both has idf 1, one of either ln 1.5 + 1."""
    alone = (math.log(1.5) + 1.0) ** 2
    weight = lambda p: (1.0 + F.log(f"{p}_n")) * (1.0 + F.log(f"{p}_n"))
    lc, tc = counted(lib, make, "l"), counted(tmpl, make, "t")
    whole = lambda c, p: c.groupBy(f"{p}_name").agg(F.sum(weight(p)).alias(f"{p}_all"))
    met = lc.join(tc, "tok").groupBy("l_name", "t_name").agg(F.sum((1.0 + F.log("l_n")) * (1.0 + F.log("t_n"))).alias("dot"), F.sum(weight("l")).alias("l_met"), F.sum(weight("t")).alias("t_met"))
    norm = lambda p: F.col(f"{p}_met") + F.lit(alone) * (F.col(f"{p}_all") - F.col(f"{p}_met"))
    scored = met.join(whole(lc, "l"), "l_name").join(whole(tc, "t"), "t_name").select("l_name", "t_name", (F.col("dot") / F.sqrt(norm("l") * norm("t"))).alias("score"))
    return pairs(lib, tmpl).join(scored, ["l_name", "t_name"], "left").fillna(0.0, ["score"])


def tfidf(lib: DataFrame, tmpl: DataFrame, make: Callable[[Column], Column], model: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """Cosine of sublinear TF-IDF vectors; the corpus is both sides unless a corpus or a model is given."""
    model = model if model is not None else tfidf_model(corpus if corpus is not None else lib.select("s").unionAll(tmpl.select("s")), make)

    def weighted(side, p):
        w = counted(side, make, p).join(model, "tok").withColumn("w", (1.0 + F.log(f"{p}_n")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(f"{p}_name")))
        return w.select(f"{p}_name", "tok", (F.col("w") / norm).alias(f"{p}_w"))

    met = weighted(lib, "l").join(weighted(tmpl, "t"), "tok").groupBy("l_name", "t_name").agg(F.sum(F.col("l_w") * F.col("t_w")).alias("score"))
    return pairs(lib, tmpl).join(met, ["l_name", "t_name"], "left").fillna(0.0, ["score"])
