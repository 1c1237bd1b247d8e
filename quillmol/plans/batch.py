"""Drivers over all variants: every similarity method or every fingerprint of each representation, with selection, dry runs, skips and logs."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmol.plans import engine, registry
from quillmol.plans.variants import FINGERPRINT_VARIANTS, VARIANTS, Variant
from quillmol.sources import readers, writers

LOG = "variant string, method string, status string, elapsed_s double, reason string"


def fingerprints_of(variant: Variant) -> list[str]:
    """All fingerprints of a SMILES variant; of another those that need no merges."""
    return [f for f in registry.FINGERPRINTS if variant.representation == "smiles" or not f.startswith("bpe")]


def jobs(kind: str, variants: list[str] | None = None, names: list[str] | None = None) -> list[tuple[Variant, str]]:
    """(variant, method or fingerprint) of a whole run, or of the variants and names selected."""
    every = VARIANTS if kind == "similarities" else FINGERPRINT_VARIANTS
    of = (lambda v: list(registry.METHODS)) if kind == "similarities" else fingerprints_of
    return [(v, n) for v in every if not variants or v.name in variants for n in of(v) if not names or n in names]


def _one(kind, v, name, lib, tmpl, columns, path, overwrite, vocab):
    side = lambda d: d.withColumn("s", v.apply(F.col("s")))
    if kind == "fingerprints":
        fps = engine.fingerprints(side(lib), name, v.preprocessed, vocab)
        writers.write_wide_csv(engine.wide_fingerprints(fps, fps.select(F.size("fp").alias("n")).first()["n"]), path, overwrite)
    else:
        kw = ({"vocab_path": vocab} if "bpe" in name else {}) | ({} if "tfidf" in name else {"pre": v.preprocessed})
        writers.write_wide_csv(engine.wide_scores(engine.cross_similarity(side(lib), side(tmpl), name, **kw), lib, columns), path, overwrite)


def run(spark: SparkSession, kind: str, lib: DataFrame | None, tmpl: DataFrame | None, folder: str, variants=None, names=None, dry_run: bool = False, overwrite: bool = False, vocab: str | None = None) -> list[tuple]:
    """(variant, method, status, elapsed_s, reason) of every job: ok, dry, skip (a library or the vocabulary is missing), skip_exists or fail. Results are
    <folder>/<variant>__<name>.csv; logs are timing_variants and timing_methods, or timing for fingerprints."""
    columns = [r["name"] for r in tmpl.orderBy("pos").select("name").collect()] if tmpl is not None and not dry_run else []  # the result's columns
    log = []
    for v, name in jobs(kind, variants, names):
        path, began, status, reason = f"{folder}/{writers.output_name(v.name, name)}", time.time(), "ok", ""
        if v.missing():
            status, reason = "skip", f"missing: {', '.join(v.missing())}"
        elif dry_run:
            status, reason = "dry", path
        elif not overwrite and writers.exists(spark, path):
            status, reason = "skip_exists", f"exists: {path}"
        else:
            try:
                _one(kind, v, name, lib, tmpl, columns, path, overwrite, vocab)
            except FileNotFoundError as e:
                status, reason = "skip", str(e)
            except Exception as e:  # a job that fails leaves the others
                status, reason = "fail", str(e).split("\n")[0]
        log.append((v.name, name, status, time.time() - began if status in ("ok", "fail") else None, reason))
    if not dry_run and log:
        table = spark.createDataFrame(log, LOG)
        writers.write_log(table.drop("reason"), f"{folder}/{'timing_methods' if kind == 'similarities' else 'timing'}")
        if kind == "similarities":
            writers.write_log(summary(table), f"{folder}/timing_variants")
    return log


def summary(log: DataFrame) -> DataFrame:
    """A row for each variant: fail if a job failed, skip if none could run, else ok; the seconds and the files."""
    ran = F.sum(F.col("status").isin("ok", "skip_exists", "dry").cast("int"))
    status = F.when(F.sum((F.col("status") == "fail").cast("int")) > 0, "fail").when(ran == 0, "skip").otherwise("ok")
    return log.groupBy("variant").agg(status.alias("status"), F.round(F.sum("elapsed_s"), 3).alias("elapsed_s"), F.sum(F.col("status").isin("ok", "skip_exists").cast("int")).alias("n_files"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillmol.batch")
    p.add_argument("kind", choices=["similarities", "fingerprints"])
    for flag in ("database", "templates", "output-dir", "vocab"):
        p.add_argument(f"--{flag}")
    p.add_argument("--variants", nargs="+")
    p.add_argument("--names", nargs="+", help="methods or fingerprints")
    for flag in ("list", "dry-run", "overwrite"):
        p.add_argument(f"--{flag}", action="store_true")
    a = p.parse_args(argv)
    if a.list:
        for v, name in jobs(a.kind, a.variants, a.names):
            print(v.name, name, *(["missing:", *v.missing()] if v.missing() else []))
        return 0
    if not a.database or not a.output_dir or a.kind == "similarities" and not a.templates:
        print("--database and --output-dir are needed, and --templates for similarities", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("quillmol").getOrCreate()
    try:
        lib = readers.read_molecules(spark, a.database).cache()
        tmpl = readers.read_molecules(spark, a.templates).cache() if a.templates else None
    except FileNotFoundError as e:
        print(f"no such path: {e}", file=sys.stderr)
        return 1
    log = run(spark, a.kind, lib, tmpl, a.output_dir, a.variants, a.names, a.dry_run, a.overwrite, a.vocab)
    for variant, name, status, elapsed, reason in log:
        print(f"{status.upper():12s} {variant}__{name} {f'{elapsed:.1f} s' if elapsed else ''} {reason}".rstrip())
    done = [s for _, _, s, _, _ in log]
    print(f"Completed: {done.count('ok') + done.count('dry')}  Skipped: {done.count('skip') + done.count('skip_exists')}  Failed: {done.count('fail')}")
    return int("fail" in done)


if __name__ == "__main__":
    sys.exit(main())
