"""Command line: similarity, fingerprint and listing modes."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmol.functions import normalize as Z
from quillmol.plans import engine, registry
from quillmol.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmol")
    for side in ("templates", "database"):
        p.add_argument(f"--{side}")
        p.add_argument(f"--{side}-smiles-col")
        p.add_argument(f"--{side}-name-col")
        p.add_argument(f"--{side}-delimiter")
        p.add_argument(f"--{side}-no-header", action="store_true")
    p.add_argument("--output")
    p.add_argument("--method", default="lingo", choices=list(registry.METHODS), metavar="METHOD")
    p.add_argument("--fingerprint", choices=list(registry.FINGERPRINTS), metavar="TYPE")
    p.add_argument("--inchi-layer", nargs="+", default=["all"], choices=["all", *Z.INCHI_LAYERS])
    p.add_argument("--shuffle-seed", type=int, default=42)
    p.add_argument("--timing-log")
    p.add_argument("--vocab")
    for flag in ("all-methods", "list-methods", "list-fingerprints", "inchi", "selfies", "canonicalize", "no-preprocess", "shuffle", "sort", "verbose", "overwrite", "demo"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def _prepared(df, a):
    s = F.col("s")
    if a.inchi:
        s = F.coalesce(F.nullif(Z.to_inchi_layers(s, "all" if a.inchi_layer == ["all"] else a.inchi_layer), F.lit("")), s)
    elif a.selfies:
        s = F.coalesce(F.nullif(Z.to_selfies(s), F.lit("")), s)
    elif a.canonicalize:
        s = Z.canonical(s)
    if a.shuffle:
        s = Z.shuffled(s, a.shuffle_seed)
    return df.withColumn("s", Z.sorted_chars(s) if a.sort else s)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_methods or a.list_fingerprints:
        print("\n".join(registry.METHODS if a.list_methods else registry.FINGERPRINTS))
        return 0
    spark = SparkSession.builder.appName("quillmol").getOrCreate()

    def side(name):
        get = lambda k: getattr(a, f"{name}_{k}")
        return readers.read_molecules(spark, getattr(a, name), smiles_col=get("smiles_col"), name_col=get("name_col"), delimiter=get("delimiter"), header=False if get("no_header") else None)

    if a.demo:
        a.method, lib = "lingo", spark.createDataFrame([(0, "aspirin", "CC(=O)Oc1ccccc1C(=O)O"), (1, "chlorobenzene", "Clc1ccccc1"), (2, "bromobenzene", "Brc1ccccc1")], "pos long, name string, s string")
        engine.self_similarity(lib, "lingo").orderBy("lib_name", "tmpl_name").show()
        return 0
    if not a.database or not a.output or not (a.templates or a.fingerprint):
        print("--database and --output are needed, and --templates or --fingerprint", file=sys.stderr)
        return 1
    lib = _prepared(side("database"), a).cache()
    if not lib.limit(1).count():
        print("no molecules", file=sys.stderr)
        return 1
    if a.fingerprint:
        fps = engine.fingerprints(lib, a.fingerprint, vocab_path=a.vocab)
        bits = fps.select(F.size("fp").alias("n")).first()["n"]
        writers.write_wide_csv(engine.wide_fingerprints(fps, bits), a.output, a.overwrite)
        return 0
    tmpl = _prepared(side("templates"), a).cache()
    names = [r["name"] for r in tmpl.orderBy("pos").select("name").collect()]  # the result's columns
    if not names:
        print("no templates", file=sys.stderr)
        return 1
    pre, log = not (a.no_preprocess or a.inchi or a.selfies), []
    for m in registry.METHODS if a.all_methods else [a.method]:
        began, status = time.time(), "ok"
        kw = ({"vocab_path": a.vocab} if "bpe" in m else {}) | ({} if "tfidf" in m else {"pre": pre})
        out = writers.output_name(a.output.removesuffix(".csv"), m) if a.all_methods else a.output
        if not a.overwrite and writers.exists(spark, out):
            log.append(("", m, "skip_exists", None))
            continue
        try:
            writers.write_wide_csv(engine.wide_scores(engine.cross_similarity(lib, tmpl, m, **kw), lib, names), out, a.overwrite)
        except (ImportError, FileNotFoundError) as e:
            if not a.all_methods:
                print(e, file=sys.stderr)
                return 1
            status = "skip"
        log.append(("", m, status, time.time() - began))
        if a.verbose:
            print(m, status, f"{log[-1][-1]:.1f} s", file=sys.stderr)
    if a.timing_log:
        writers.write_timings(spark.createDataFrame(log, "variant string, method string, status string, elapsed_s double"), a.timing_log)
    return 0


if __name__ == "__main__":
    sys.exit(main())
