import base64
import random
import re

import corpus_pipeline
from quillmol.llm import langid, pii
from quillmol.llm.common import held, stash


def test_stages(spark):
    """Each stage against plain code on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r for r in docs.collect()}

    a = stash(stage["language"](spark, docs, sf))
    kept = {r["doc_id"] for r in a.collect()}
    assert a.columns == docs.columns and len(kept) >= 0.97 * len(before)
    assert all(re.search(r"[^\W\d_]", before[d]["text"] or "") for d in kept)

    b = stash(stage["near_copies"](spark, a, sf))
    sets = {}
    for d in sorted(kept):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), before[d]["text"]))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sets:
        for e in sets:
            if e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                p, q = find(d), find(e)
                parent[max(p, q)] = min(p, q)
    assert {r["doc_id"] for r in b.collect()} == {d for d in sets if find(d) == d}

    c = stash(stage["private_data"](spark, b, sf))
    patterns = pii.compiled()
    for r in c.collect():
        assert not pii.base_spans(r["text"], patterns) and r["n_chars"] == len(r["text"])
    assert c.count() == b.count()

    d = stash(stage["mixture"](spark, c, sf))
    times = {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert d.columns == docs.columns and max(times.values()) <= 2
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert 1.2 * size(c) < size(d) < 1.8 * size(c)

    e = stage["packing"](spark, d, sf).collect()
    assert sum(r["piece"] == 0 for r in e) == d.count()


def test_language_by_row(spark):
    """Labels are those of predict(), on odd rows too; rows of one doc_id are judged each, and an empty table stays empty."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    text = docs.where("text is not null").first()["text"]
    rows = [(1, text, None, "a", 1, 7), (1, "12 34", "x", "a", 1, 7), (2, None, None, None, None, 7), (None, "", None, "a", 0, 7), (3, text * 50, None, "a", 1, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    labelled = langid.label(odd, model)
    assert labelled.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert sorted(map(str, labelled.select("doc_id", "lang_pred", "score").collect())) == sorted(map(str, langid.predict(odd, model).collect()))
    stage = dict(corpus_pipeline.STAGES)["language"]
    both = odd.drop("score").unionByName(docs)
    kept = stage(spark, both, "")
    assert kept.where("text = '12 34'").count() == 0 and kept.where("text is null").count() == 0 and kept.where("lang is null").count() == 0
    assert stage(spark, docs.limit(0), "").collect() == []


def test_language_of_unspaced_texts(spark):
    """A long text without white space is held to the threshold like any other; a few letters are not."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blob = base64.b64encode(random.Random(3).randbytes(15000)).decode()
    texts = {"blob": blob, "han": "".join(chr(0x4E00 + i * 37 % 3000) for i in range(400)), "few": "Re.", "unspaced": re.sub(r"\s", "\u00a0", docs.where("length(text) > 500 and lang is not null").orderBy("doc_id").first()["text"])}
    odd = spark.createDataFrame([(10**6 + i, t, None, k, len(t)) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string, source string, n_chars long")
    rows = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(odd), "").where(f"doc_id >= {10**6}").collect()
    assert {r["source"] for r in rows} == {"few", "unspaced"}


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "One two three four five six.", "fr", "b", 27), (4, "One two three four five six.", "fr", "b", 27), (4, "Other words of the same id, mail a@b.de here.", "fr", "b", 1), (5, "Other words of the same id, mail a@b.de here.", "fr", "b", 1), *[(None, "no id here", "fr", None, 10)] * 40, (None, None, None, None, None), (7, " ".join(f"word{i % 997}" for i in range(40000)), "en", "a", 1)]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables, in each stage but the first, which has tests of its own."""
    table = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, size int, tie string")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    own = [r[:5] for r in ODD]
    kept = rows(stage["near_copies"](spark, table, ""))
    assert len(kept) == 6 - 1 + 41 and sum("'no id here'" in r for r in kept) == 40 and sum(r.startswith("(4,") for r in kept) == 1
    private = stage["private_data"](spark, table, "")
    assert private.columns == corpus_pipeline.COLUMNS and rows(private.select("doc_id", "text")) == sorted(str((d, t and t.replace("a@b.de", "[EMAIL]"))) for d, t, *_ in own)
    mixed = stage["mixture"](spark, table, "")
    got = rows(mixed)
    assert mixed.columns == corpus_pipeline.COLUMNS and set(got) <= set(map(str, own)) and sum(r.startswith(("(1,", "(2,", "(3,")) for r in got) == 3
    assert 41 <= sum(r.startswith("(None") for r in got) <= 81  # not all or none
    packed = stage["packing"](spark, table, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == len(ODD)
    for name in ("near_copies", "private_data", "mixture", "packing"):
        assert stage[name](spark, table.limit(0), "").collect() == []


def test_run_leaves_little_behind(spark):
    """Tables of the stages go; the last one that is read stays."""
    before = held()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and len(held() - before) <= 2
