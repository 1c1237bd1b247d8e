import pytest
from pyspark.sql import functions as F

from quillmol.functions import normalize as Z
from quillmol.functions import tokens as K
from quillmol.operators import bpe as B
from quillmol.operators import pair_kernels as P
from quillmol.operators import token_kernels as N
from quillmol.plans import catalogue, engine, registry


def mols(spark, *strings):
    return spark.createDataFrame([(i, f"m{i}", s) for i, s in enumerate(strings)], "pos long, name string, s string")


def one(spark, expr, s):
    return spark.createDataFrame([(s,)], "s string").select(expr(F.col("s")).alias("v")).first()["v"]


def score(spark, method, a, b, **kw):
    return engine.cross_similarity(mols(spark, a), mols(spark, b), method, **kw).first()["score"]


@pytest.mark.parametrize("s, want", [("CCCCl", "CCCL"), ("c1ccc(Br)cc1", "c1ccc(R)cc1"), ("C[C@@H](Cl)Br", "C[C¡H](L)R"), ("[Si]", "[G]"), ("[Ni]", "[Θ]"), ("[W]", "[·]"), ("", ""), ("[C@TH1]", "[C¢]")])
def test_preprocess(spark, s, want):
    assert one(spark, Z.preprocess, s) == want


def test_inchi(spark):
    aspirin = "1S/C9H8O4/c1-6(10)13-8-5-3-2-4-7(8)9(11)12/h2-5H,1H3,(H,11,12)"
    assert one(spark, lambda s: Z.inchi_layers(s, ["formula", "connections"]), aspirin) == "C9H8O4/c1-6(10)13-8-5-3-2-4-7(8)9(11)12"
    assert one(spark, lambda s: Z.inchi_body(s, False), "1S/CH4/h1H4") == "1S/CH4/h1H4"
    with pytest.raises(ValueError):
        Z.inchi_layers(F.lit("x"), ["colour"])


def test_tokens(spark):
    assert len(K.CHEMICAL) == 64
    assert one(spark, K.chemical, "CCCl") == ["C", "C", "Cl"]
    assert one(spark, K.atoms, "C%10CC%10") == ["C", "%10", "C", "C", "%10"]
    assert one(spark, K.atoms, "[nH+]") == ["[nH+]"]
    assert one(spark, lambda s: K.kmers(s, 4), "CC") == []
    assert one(spark, lambda s: K.ngrams(K.chemical(s), 1, 2), "CCl") == ["C", "Cl", "C Cl"]


@pytest.mark.parametrize("method, a, b, want", [
    ("edit", "CCC", "CCCCC", 0.6), ("edit", "", "", 1.0), ("nlcs", "ABC", "AC", 4 / 6), ("nlcs", "AAA", "BBB", 0.0), ("lcs_substring", "ABCDEF", "CDEFXY", 16 / 36),
    ("substring", "CCO", "CCOC", 3 / 18**0.5), ("substring", "CC", "XY", 0.0), ("lingo", "CC", "OO", 1.0), ("lingo", "CCCCC", "OO", 0.0), ("lingo", "c1ccc(L)cc1", "c1ccc(R)cc1", 1 / 3),
    ("lingo_tversky", "CCCCCO", "CCCCCCCN", 0.625), ("lingo_tversky", "CCCCCCCN", "CCCCCO", 0.416667), ("spectrum", "CCCCN", "CCCCO", 1 / 3), ("mismatch", "CCCCN", "CCCCO", 0.6), ("spectrum", "CCO", "CCO", 1.0),
    ("ncd", "", "CCO", 0.0), ("ncd", "CCO", "CCO", 1.0), ("hamming", "AB", "ABC", 2 / 3), ("damerau_levenshtein", "ca", "abc", 1 - 2 / 3), ("jaro", "", "", 0.0),
])
def test_scores(spark, method, a, b, want):
    assert score(spark, method, a, b, pre=False) == pytest.approx(want, abs=1e-6)


def test_golden(spark):
    rows = {r["Name"]: r for r in catalogue.QUERIES["golden_lingo_wide"](spark, "").collect()}
    assert len(rows) == 19
    assert rows["0092-0008"]["Similarity_0133-0086"] == "0.63571"
    assert rows["0054-0090"]["Similarity_0054-0090"] == "1.00000"


def test_registry():
    assert len(registry.METHODS) == 247 and len(registry.FINGERPRINTS) == 20
    assert "tok-bpe128_tfidf" not in registry.METHODS and "bpe128_count" in registry.FINGERPRINTS
    with pytest.raises(ValueError):
        registry.method("none")
    with pytest.raises(ValueError):
        registry.fingerprint("none")


def test_coefficient_is_checked(spark):
    with pytest.raises(ValueError):
        N.spectrum(mols(spark, "C").drop("pos"), mols(spark, "C").drop("pos"), coefficient="x")


def test_self_similarity(spark):
    got = {(r["lib_name"], r["tmpl_name"]): r["score"] for r in engine.self_similarity(mols(spark, "C", "CCO", "CCC"), "substring").collect()}
    assert len(got) == 9 and got["m0", "m0"] == 1.0 and got["m1", "m2"] == got["m2", "m1"]


def test_fingerprints(spark):
    fp = lambda s, k: engine.fingerprints(mols(spark, s), k, pre=False).first()["fp"]
    assert fp("CCCCCCCC", "smifp34")[0] == 8 and fp("CCCCCCCC", "smifp34_binary")[0] == 1
    assert fp("", "smifp34") == [0.0] * 34 and len(fp("C", "smifp38")) == 36
    merges = [("C", "C"), ("CC", "C")]
    assert engine.fingerprints(mols(spark, "CCC"), "bpe16_count", merges=merges).first()["fp"] == [0.0, 1.0]


def test_merges():
    assert B.merge_all(list("CCC"), {("C", "C"): 0}) == ["CC", "C"]
    assert B.merge_all(list("CCCC"), {("C", "C"): 0, ("CC", "C"): 1}) == ["CC", "CC"]


def test_pair_functions_against_tables():
    import random

    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert P._lcs(a, b) == lcs(a, b)
        assert P._run(a, b) == max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i : i + k] in b), default=0)


def test_mismatch_against_neighbourhoods(spark):
    import itertools
    import random

    rng = random.Random(5)
    strings = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(8)]

    def vector(s, k, letters):
        out = {}
        for i in range(len(s) - k + 1):
            m = s[i : i + k]
            near = {m} | {m[:j] + c + m[j + 1 :] for j, c in itertools.product(range(k), letters)}
            for x in near:
                out[x] = out.get(x, 0) + 1
        return out

    t = mols(spark, *strings)
    got = {(r["lib_name"], r["tmpl_name"]): r["score"] for r in engine.cross_similarity(t, t, "mismatch3", pre=False).collect()}
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            u, v = vector(a, 3, set(a + b)), vector(b, 3, set(a + b))
            dot = lambda p, q: sum(n * q.get(x, 0) for x, n in p.items())
            assert got[f"m{i}", f"m{j}"] == pytest.approx(dot(u, v) / (dot(u, u) + dot(v, v) - dot(u, v)))


def test_frozen_tfidf_model(spark):
    t = mols(spark, "CCO", "CCOC", "CCCCC").drop("pos")
    make = lambda s: K.ngrams(K.chemical(s), 1, 2)
    fresh = N.tfidf(t, t, make, corpus=t.select("s")).collect()
    frozen = N.tfidf(t, t, make, model=N.tfidf_model(t.select("s"), make)).collect()
    assert sorted((r["l_name"], r["t_name"], round(r["score"], 9)) for r in fresh) == sorted((r["l_name"], r["t_name"], round(r["score"], 9)) for r in frozen)


def test_merges_by_brute_force():
    """A pass for each merge, in rank order."""
    import random

    from quillmol.operators import bpe

    def plain(tokens, merges):
        for a, b in merges:
            out, i = [], 0
            while i < len(tokens):
                hit = tokens[i : i + 2] == [a, b]
                out.append(a + b if hit else tokens[i])
                i += 1 + hit
            tokens = out
        return tokens

    rng = random.Random(4)
    for _ in range(400):
        alphabet, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(0, 8)):
            pair = (rng.choice(alphabet), rng.choice(alphabet))
            if pair not in merges:
                merges.append(pair)
                alphabet.append("".join(pair))
        tokens = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        assert bpe.merge_all(list(tokens), {m: i for i, m in enumerate(merges)}) == plain(tokens, merges)


def test_mismatch_by_neighbours(spark):
    """The closed form against neighbours made one by one, for m from 0 to 3."""
    import itertools
    import random
    from collections import Counter

    from quillmol.operators import token_kernels as N

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd"[: rng.choice([1, 2, 4])]) for _ in range(rng.choice([2, 4, 6, 12]))) for _ in range(10)]
    side = spark.createDataFrame([(f"n{i}", s) for i, s in enumerate(texts)], "name string, s string")
    for k, m, alphabet in ((3, 0, None), (3, 1, None), (4, 2, None), (3, 3, None), (3, 1, "ab"), (3, 2, "bcx")):
        got = {(r["l_name"], r["t_name"]): r["score"] for r in N.mismatch(side, side.limit(4), k, m, pre=False, alphabet=alphabet).collect()}
        for (i, a), (j, b) in itertools.product(enumerate(texts), enumerate(texts[:4])):
            letters = alphabet or "".join(set(a + b))

            def spread(s, letters=letters):
                own = Counter()
                for p in range(len(s) - k + 1):
                    near = {s[p : p + k]}
                    for _ in range(m if len(letters) > 1 else 0):
                        near |= {w[:q] + c + w[q + 1 :] for w in near for q in range(k) for c in letters}
                    own.update(near)
                return own

            if min(len(a), len(b)) < k:
                want = float(a == b) if max(len(a), len(b)) < k else 0.0
            else:
                x, y = spread(a), spread(b)
                dot, p, q = (sum(u[w] * v[w] for w in u) for u, v in ((x, y), (x, x), (y, y)))
                want = dot / (p + q - dot)
            assert abs(got[f"n{i}", f"n{j}"] - want) < 1e-9, (k, m, alphabet, a, b)
