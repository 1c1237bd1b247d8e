"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 1024
N = 3
SEED = 4801
#: Documents that a language's prototype is learned from, at most about so many.
SAMPLE = 4000
MAX_LANGUAGES = 1024
UNKNOWN = "und"
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letter_vector(cp: int) -> np.ndarray:
    return np.random.default_rng([SEED, cp]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


class Profiles:
    """Vectors of texts. Letters become their lower-case code points, any run of other characters one gap; an n-gram's vector is the
    product of its letters' random vectors, each rolled by its place; a text's vector is the sum over its n-grams. Only letters'
    vectors are kept; n-grams' are made CHUNK at a time, so memory depends on neither the texts' length nor their n-grams."""

    #: Distinct n-grams of texts bundled together, characters read at once, n-grams made at once, letters kept.
    GRAMS, WINDOW, CHUNK, LETTERS = 1 << 17, 1 << 20, 1 << 12, 1 << 15

    def __init__(self):
        import sys
        import unicodedata

        self.letters = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                self.letters[c] = ord(low) if len(low) == 1 else ord(unicodedata.normalize("NFKD", low)[0])
        self.place = np.full(sys.maxunicode + 1, -1, np.int32)  # of a letter's vector
        self.known, self.vectors = 0, np.empty((64, DIM), np.int8)

    def _letters(self, cps: np.ndarray) -> np.ndarray:
        """The vectors of letters, at most CHUNK * N of them, making those that are new."""
        new = np.unique(cps[self.place[cps] < 0])
        if self.known + len(new) > self.LETTERS:
            self.place[:], self.known, new = -1, 0, np.unique(cps)
        while self.known + len(new) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        for c in new.tolist():
            self.vectors[self.known] = letter_vector(c)
            self.place[c], self.known = self.known, self.known + 1
        return self.vectors[self.place[cps]]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, as packed code points, and their counts."""
        before, parts = np.zeros(1, np.uint32), []  # a gap
        for i in range(0, len(text), self.WINDOW):
            cps = self.letters[np.frombuffer(text[i : i + self.WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)]
            if i + self.WINDOW >= len(text):
                cps = np.append(cps, np.uint32(0))
            keep = cps != 0
            keep[1:] |= cps[:-1] != 0
            keep[0] |= before[-1] != 0
            run = np.concatenate((before, cps[keep])).astype(np.uint64)
            if len(run) >= N:
                parts.append(np.unique((run[:-2] << np.uint64(42)) | (run[1:-1] << np.uint64(21)) | run[2:], return_counts=True))
            before = run[1 - N :].astype(np.uint32)
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def _made(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of n-grams."""
        low = np.uint64((1 << 21) - 1)
        out = self._letters((keys & low).astype(np.int64))
        for place in range(1, N):
            letters, at = np.unique((keys >> np.uint64(21 * place)) & low, return_inverse=True)
            out = out * np.roll(self._letters(letters.astype(np.int64)), place, axis=1)[at]
        return out.astype(np.float32)

    def bundle(self, texts: list[str], group: int = 128) -> np.ndarray:
        """The vectors of the texts, a row each; a text without letters has a zero vector. Texts go together, up to
        group of them, while their n-grams are few."""
        out = np.zeros((len(texts), DIM), np.float32)
        i = 0
        while i < len(texts):
            part, n = [], 0
            while i + len(part) < len(texts) and len(part) < group and (not part or n < self.GRAMS):
                part.append(self.grams(texts[i + len(part)] or ""))
                n += len(part[-1][0])
            keys = np.unique(np.concatenate([k for k, _ in part]))
            for a in range(0, len(keys), self.CHUNK):
                some = keys[a : a + self.CHUNK]
                counts = np.zeros((len(part), len(some)), np.float32)
                for j, (k, c) in enumerate(part):
                    lo, hi = np.searchsorted(k, some[0]), np.searchsorted(k, some[-1], "right")
                    counts[j, np.searchsorted(some, k[lo:hi])] = c[lo:hi]
                out[i : i + len(part)] += counts @ self._made(some)
            i += len(part)
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, by name, and their prototypes of length one, from rows (doc_id, text, lang) with text and lang.

    A language with more than sample documents gives about sample of them, those of the least hashes; the
    rows are summed in the tasks, so only languages x DIM numbers and a count per language come to the driver.
    """
    known = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in counts], "lang string, _share double")
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(share), "lang").where(draw < F.col("_share")).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        profiles, sums = Profiles(), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                langs, texts = batch.column(0).slice(i, 128).to_pylist(), batch.column(1).slice(i, 128).to_pylist()
                vectors = profiles.bundle(texts)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                for lang, v in zip(langs, vectors / np.maximum(norms, 1e-9), strict=True):
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * 1e6).astype(np.int64)  # whole numbers: any order of sums agrees
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = chosen.mapInArrow(run, "lang string, v array<bigint>")
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), DIM))
    for r in rows:
        out[langs.index(r["lang"]), r["i"]] = r["x"]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, (out / np.maximum(norms, 1e-9)).astype(np.float32)


def _scored(docs: DataFrame, model: tuple[list[str], np.ndarray], text: int, schema: T.StructType, keep: list[int]) -> DataFrame:
    """Columns keep of docs, by place, and the prediction for column text."""
    langs, prototypes = model

    def run(batches):
        import pyarrow as pa

        profiles = Profiles()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = batch.slice(i, 128)
                vectors = profiles.bundle(rows.column(text).to_pylist())
                norms = np.linalg.norm(vectors, axis=1)
                pred, score = [UNKNOWN] * rows.num_rows, [0.0] * rows.num_rows
                if langs:
                    cos = vectors @ prototypes.T / np.maximum(norms, 1e-9)[:, None]
                    for j in np.flatnonzero(norms > 0):
                        best = int(np.argmax(cos[j]))
                        pred[j], score[j] = langs[best], float(min(1.0, max(0.0, cos[j, best])))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score, the cosine with the nearest prototype (0 at least; ties: first by name). A text that is null or
    has no letter, or any text if nothing was learned, is "und" with score 0."""
    return _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, 1, SCORED, [0])


def label(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """All columns of docs, whose text is a string, with lang_pred and score as by predict(): row by row, without a join. Columns
    of docs with these two names are replaced."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, *SCORED.fields[1:]])
    return _scored(docs, model, docs.columns.index("text"), schema, list(range(len(docs.columns))))


def held_out():
    """Documents that nothing is learned from: crc32 of the doc_id as text is 2 modulo 4; a null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out; see fit() and predict(). An empty
    table gives an empty table; repeated rows are scored each; other columns are not read."""
    model = fit(docs.where(~held_out()), sample)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
