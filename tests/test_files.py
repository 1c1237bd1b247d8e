import pytest
from pyspark.sql import functions as F

from quillmol.plans import batch, cli
from quillmol.sources import readers


def read(spark, path, **kw):
    return [(r["name"], r["s"]) for r in readers.read_molecules(spark, str(path), **kw).orderBy("pos").collect()]


def test_smi(spark, tmp_path):
    f = tmp_path / "a.smi"
    f.write_text("CCO ethanol\n\n# note\nCCC propane\nC\nN\nO a\nO a\nOO a_1\nOC a\n")
    assert read(spark, f) == [("ethanol", "CCO"), ("propane", "CCC"), ("mol_1", "C"), ("mol_2", "N"), ("a", "O"), ("a_1", "O"), ("a_1_1", "OO"), ("a_2", "OC")]


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,SMILES\nethanol,CCO\npropane,CCC\n")
    assert read(spark, tmp_path / "a.csv", smiles_col="SMILES", name_col="Name") == [("ethanol", "CCO"), ("propane", "CCC")]
    (tmp_path / "a.tsv").write_text("SMILES\tName\nCCO\tethanol\n")
    assert read(spark, tmp_path / "a.tsv") == [("ethanol", "CCO")]
    with pytest.raises(ValueError):
        read(spark, tmp_path / "a.csv", smiles_col="none")
    with pytest.raises(FileNotFoundError):
        read(spark, tmp_path / "none.csv")


def test_directory(spark, tmp_path):
    (tmp_path / "mol1.smi").write_text("CCO")
    (tmp_path / "mol2.smi").write_text("CCC propane")
    (tmp_path / "other.txt").write_text("CCC x")
    assert read(spark, tmp_path) == [("mol1", "CCO"), ("propane", "CCC")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "db.smi").write_text("CCO a\nCCCCO b\n")
    (tmp_path / "t.smi").write_text("CCO a\n")
    args = ["--database", str(tmp_path / "db.smi"), "--output", str(tmp_path / "out")]
    assert cli.main([*args, "--templates", str(tmp_path / "t.smi"), "--method", "edit"]) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert cli.main([*args, "--fingerprint", "smifp34", "--overwrite"]) == 0
    assert len(spark.read.csv(str(tmp_path / "out"), header=True).columns) == 35
    assert cli.main(["--database", str(tmp_path / "db.smi")]) == 1
    assert cli.main(["--list-methods"]) == 0 and "tok-bpe16_tfidf" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    from quillmol.streaming.stream import score_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("x", "CCO"), ("y", "CCCC")], "name string, s string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    got = []
    source = spark.readStream.schema("name string, s string").parquet(str(tmp_path / "in"))
    templates = spark.createDataFrame([("t", "CCO")], "name string, s string")
    score_stream(source, templates, "edit", lambda df, i: got.extend(df.collect()), str(tmp_path / "ck"), pre=False).awaitTermination()
    assert {r["lib_name"]: r["score"] for r in got} == {"x": 1.0, "y": 0.5}


def test_merges_over_the_bound_are_an_error(spark, tmp_path, monkeypatch):
    import json

    import pytest

    from quillmol.operators import bpe

    monkeypatch.setattr(bpe, "MAX_MERGES", 3)
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"merges": [["C", "C"], ["C", "O"], ["N", "C"], ["O", "O"]]}))
    with pytest.raises(ValueError, match="more than 3 merges"):
        bpe.read_merges(spark, str(path))
    assert bpe.read_merges(spark, str(path), 2) == [("C", "C"), ("C", "O")]
    path.write_text(json.dumps({"merges": [["C", "C"], ["C", "O"], ["N", "C"]]}))
    assert len(bpe.read_merges(spark, str(path))) == 3


def test_large_file_without_names(spark, tmp_path):
    """Every line of a file of several splits, in order."""
    n = 300_000
    path = tmp_path / "big.smi"
    path.write_text("\n".join(f"C{i}" + (f" n{i}" if i % 7 == 0 else "") for i in range(n)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        rows = readers.read_file(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == n
    rows.sort(key=lambda r: r["pos"])
    assert [r["s"] for r in rows] == [f"C{i}" for i in range(n)] and [r["pos"] for r in rows] == list(range(n))
    unnamed = [r["name"] for r in rows if r["name"].startswith("mol_")]
    assert unnamed == [f"mol_{i + 1}" for i in range(n - (n + 6) // 7)]


def test_directory_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "SPLITS", 3)
    for i in range(40):
        (tmp_path / f"f{i:02d}.smi").write_text(f"C{i} {'same' if i in (5, 30) else f'n{i}'}\nCC next\n")
    rows = sorted(map(tuple, readers.read_molecules(spark, str(tmp_path)).collect()))
    want = [(f"n{i}", f"C{i}") for i in range(40) if i != 30]
    want[5] = ("same", "C30")
    assert rows == [(i, *w) for i, w in enumerate(want)]
    (tmp_path / "only.smi").write_text("  CCO\nCCC\n")
    assert list(map(tuple, readers.read_first(spark, str(tmp_path / "f03.smi")).collect())) == [("n3", "C3")] and readers.read_first(spark, str(tmp_path / "only.smi")).first()["name"] == "CCC"


def test_drivers(spark, tmp_path):
    """Selection, dry runs, skips, logs and the exit code of the drivers over all variants."""
    (tmp_path / "lib.smi").write_text("CCO a\nCCCl b\nc1ccccc1Br c\n")
    (tmp_path / "tmpl.smi").write_text("CCO t\n")
    lib, tmpl = readers.read_molecules(spark, str(tmp_path / "lib.smi")).cache(), readers.read_molecules(spark, str(tmp_path / "tmpl.smi")).cache()
    out = str(tmp_path / "out")
    dry = batch.run(spark, "similarities", lib, tmpl, out, dry_run=True)
    assert len(dry) == 10 * 247 and {r[2] for r in dry} == {"dry", "skip"} and not (tmp_path / "out").exists()
    assert len(batch.jobs("fingerprints")) == 64
    pick = {"variants": ["smiles__replaced", "smiles__canonical_replaced"], "names": ["lingo", "hamming", "tok-bpe_tfidf"]}
    first = {(v, n): s for v, n, s, *_ in batch.run(spark, "similarities", lib, tmpl, out, **pick)}
    assert first["smiles__replaced", "lingo"] == first["smiles__replaced", "hamming"] == "ok" and first["smiles__replaced", "tok-bpe_tfidf"] == "skip"
    again = batch.run(spark, "similarities", lib, tmpl, out, **pick)
    assert {s for v, n, s, *_ in again if v == "smiles__replaced" and n != "tok-bpe_tfidf"} == {"skip_exists"}
    rows = {r["variant"]: r for r in spark.read.option("header", True).csv(f"{out}/timing_variants").collect()}
    assert rows["smiles__replaced"]["status"] == "ok" and rows["smiles__replaced"]["n_files"] == "2" and rows["smiles__canonical_replaced"]["status"] == "skip"
    wide = spark.read.option("header", True).csv(f"{out}/smiles__replaced__lingo.csv").collect()
    assert [r["Name"] for r in wide] == ["a", "b", "c"] and wide[0]["Similarity_t"] == "1.00000"
    args = ["fingerprints", "--database", str(tmp_path / "lib.smi"), "--output-dir", out, "--variants", "smiles__replaced", "--names", "smifp34"]
    assert batch.main(args) == 0 and spark.read.option("header", True).csv(f"{out}/timing").first()["status"] == "ok"
    assert batch.main(["fingerprints", "--database", str(tmp_path / "none.smi"), "--output-dir", out]) == 1
    bad = lib.withColumn("s", F.raise_error(F.lit("no")).cast("string"))
    assert {s for _, _, s, *_ in batch.run(spark, "fingerprints", bad, None, out, ["smiles__replaced"], ["smifp38"])} == {"fail"}
