import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmol.llm import ngram_join
from quillmol.llm.components import components


def brute(rows):
    """Sets, links of all pairs, and the least id reachable."""
    sets = []
    for d, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            if d is not None and e is not None and s and r and 100 * len(s & r) >= 80 * len(s | r):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 6, 30, 90, 200]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(40)] + passage
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w).replace("w1", "W1" if rng.random() < 0.5 else "w1")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    rows = corpus(seed)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    long_text = " ".join(f"t{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one  two"), (None, "one two"), (10, long_text), (11, long_text + " end"), (12, long_text), (12, long_text), (3, "a b c d e f g h"), (3, "one two")]
    got = ngram_join.jaccard_classes(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (9, 1, 3), (None, 1, None), (10, 29996, 10), (11, 29997, 10), (12, 29996, 10), (12, 29996, 10), (3, 4, 3), (3, 1, 3)], key=str)


def test_empty(spark):
    assert ngram_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def families(seed):
    """Many components that share a passage, families whose members lose and gain a tenth, and sets of over 400 shingles."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for _ in range(30):  # what is left of each is shared by two texts
        own = [rng.choice(words) for _ in range(rng.choice([12, 18, 25]))]
        rows += [own + passage, own[:-1] + [rng.choice(words)] + passage]
    for size in (40, 120, 700):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(max(1, rng.choice([size // 100, size // 50, size // 30]))):
                w[rng.randrange(size)] = rng.choice(words)
            rows.append(w[: size - rng.choice([0, 0, size // 12])])
    return [(7 * i + 2, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("frequent", "block"), [(24, 2048), (2, 3)])
def test_families_and_a_common_passage(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = families(frequent)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_keys_grow_with_the_prefix(spark):
    """A set of n tokens, all of them frequent, has no more than 2 n keys of two tokens."""
    for n in (10, 100, 1000, 5000):
        rows = spark.range(n).selectExpr("1L as node", f"{n}L as n", "0L as own", "1L as comp", "xxhash64(id) as token", "id as pos", "id as last", "true as frequent")
        made = ngram_join._keys(rows.where(f"pos <= {n - (4 * n + 4) // 5} + {ngram_join.SUBCLASSES[int(math.log(n) / math.log(1.3))]}")).count()
        assert 0.2 * n <= made <= 2 * n, (n, made)


def test_combinations(spark):
    t = spark.sql("select array(struct(3L as pos, 30L as token), struct(5L as pos, 50L as token), struct(6L as pos, 60L as token), struct(9L as pos, 90L as token)) as t")
    for k, count in ((1, 4), (2, 6), (3, 4), (4, 1)):
        rows = t.select(F.explode(ngram_join.combinations_of(F.col("t"), k)).alias("c")).select("c.*").collect()
        assert len({r["key"] for r in rows}) == count == len(rows) and {(r["pos"], r["last"]) for r in rows} == {(c[0], c[-1]) for c in itertools.combinations([3, 5, 6, 9], k)}
