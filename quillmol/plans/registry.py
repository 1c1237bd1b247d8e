"""All similarity methods and fingerprints by name; each method is a plan builder (library, templates) -> pairs with score."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quillmol.functions import tokens as K
from quillmol.functions.normalize import preprocess
from quillmol.operators import bpe as B
from quillmol.operators import pair_kernels as P
from quillmol.operators import token_kernels as N

GRID = [(m, n) for m in range(1, 7) for n in range(m, 7)]
BPE_SIMILARITY = (16, 32, 64, 256, 512, 1024)
BPE_FINGERPRINT = (16, 32, 64, 128, 256, 512, 1024)


def _prepared(df, pre):
    return df.withColumn("s", preprocess(F.col("s"))) if pre else df


def _by_pair(kernel):
    def build(lib, tmpl, pre=True, **kw):
        return N.pairs(_prepared(lib, pre), _prepared(tmpl, pre)).withColumn("score", kernel(F.col("l_s"), F.col("t_s"), **kw))

    return build


def _by_fingerprint(compare, chars):
    def build(lib, tmpl, pre=True):
        side = lambda d: _prepared(d, pre).withColumn("fp", P.smifp(F.col("s"), chars))
        return N.pairs(side(lib), side(tmpl)).withColumn("score", compare(F.col("l_fp"), F.col("t_fp")))

    return build


def _tfidf(family, low, high):
    def build(lib, tmpl, pre=False, model=None, corpus=None, legacy_batch=False):
        """legacy_batch: the older batch form, 1- and 2-grams of replaced strings under every name."""
        if legacy_batch:
            return N.tfidf(_prepared(lib, True), _prepared(tmpl, True), lambda s: K.ngrams(K.TOKENISERS[family](s), 1, 2), model, corpus)
        return N.tfidf(lib, tmpl, lambda s: K.ngrams(K.TOKENISERS[family](s), low, high), model, corpus)

    return build


def _bpe_tfidf(first, low, high):
    def build(lib, tmpl, pre=False, vocab_path=None, merges=None, model=None, corpus=None, legacy_batch=False):
        if legacy_batch:
            return _bpe_tfidf(None, 1, 2)(_prepared(lib, True), _prepared(tmpl, True), False, vocab_path, merges, model, corpus)
        if merges is None:
            if vocab_path is None:
                raise FileNotFoundError("this method needs a BPE vocabulary: vocab_path")
            merges = B.read_merges(lib.sparkSession, vocab_path, first)
        used = merges[:first] if first else merges
        side = lambda d: d.withColumn("_t", B.bpe(F.col("s"), used)).withColumn("s", F.array_join("_t", "\x1f"))
        make = lambda s: K.ngrams(F.split(s, "\x1f"), low, high)
        keep = lambda d: side(d).drop("_t").where("s <> ''")
        scored = N.tfidf(keep(lib), keep(tmpl), make, model, corpus)
        return N.pairs(lib, tmpl).join(scored.select("l_name", "t_name", "score"), ["l_name", "t_name"], "left").fillna(0.0, ["score"])

    return build


def _methods():
    out = {"edit": _by_pair(P.edit), "nlcs": _by_pair(P.nlcs), "clcs": _by_pair(P.clcs), "substring": N.substring}
    for name, chars in (("smifp", P.SMIFP34), ("smifp38", P.SMIFP38)):
        out |= {f"{name}_cbd": _by_fingerprint(P.cityblock, chars), f"{name}_tanimoto": _by_fingerprint(P.tanimoto, chars)}
    out |= {"lingo": N.lingo, "lingo3": partial(N.lingo, q=3), "lingo5": partial(N.lingo, q=5)}
    out |= {"lingo_tversky": N.tversky, "lingo_tversky_sym": partial(N.tversky, alpha=0.5, beta=0.5), "lingo_dice": partial(N.tversky, alpha=0.5, beta=0.5)}
    out |= {"spectrum": N.spectrum, "spectrum3": partial(N.spectrum, k=3), "spectrum5": partial(N.spectrum, k=5), "spectrum_cosine": partial(N.spectrum, coefficient="cosine")}
    out |= {"mismatch": N.mismatch, "mismatch3": partial(N.mismatch, k=3), "mismatch5": partial(N.mismatch, k=5), "lcs_substring": _by_pair(P.lcs_substring)}
    out |= {"damerau_levenshtein": _by_pair(P.damerau), "jaro": _by_pair(P.jaro), "jaro_winkler": _by_pair(P.jaro_winkler), "hamming": _by_pair(P.hamming), "ncd": _by_pair(P.ncd)}
    for family in ("smiles", "schwaller", "selfies"):
        out |= {f"tok-{family}_tfidf": _tfidf(family, 1, 2)} | {f"tok-{family}_tfidf{m}{n}": _tfidf(family, m, n) for m, n in GRID}
    for k in ("", *BPE_SIMILARITY):
        out |= {f"tok-bpe{k}_tfidf": _bpe_tfidf(k or None, 1, 2)} | {f"tok-bpe{k}_tfidf{m}{n}": _bpe_tfidf(k or None, m, n) for m, n in GRID}
    return out


METHODS = _methods()
FINGERPRINTS = {
    "smifp34": (P.SMIFP34, False), "smifp34_binary": (P.SMIFP34, True), "smifp38": (P.SMIFP38, False), "smifp38_binary": (P.SMIFP38, True),
    **{f"bpe{k}_{kind}": (k or None, kind == "binary") for k in ("", *BPE_FINGERPRINT) for kind in ("count", "binary")},
}


def method(name: str):
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}")
    return METHODS[name]


def fingerprint(name: str):
    if name not in FINGERPRINTS:
        raise ValueError(f"unknown fingerprint {name!r}")
    return FINGERPRINTS[name]
