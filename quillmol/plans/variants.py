"""Representations and their changes, as one table's column instead of a process for each."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmol.functions import normalize as Z


@dataclass(frozen=True)
class Variant:
    representation: str
    changes: tuple[str, ...] = ()
    needs: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return "__".join([self.representation, "_".join(self.changes)]) if self.changes else self.representation

    @property
    def preprocessed(self) -> bool:
        return "replaced" in self.changes

    def missing(self) -> list[str]:
        return [m for m in self.needs if importlib.util.find_spec(m) is None]

    def apply(self, s: Column) -> Column:
        """Convert (what can't be converted stays), canonicalise, then shuffle or sort."""
        if self.representation.startswith("inchi_"):
            layer = self.representation.removeprefix("inchi_")
            s = F.coalesce(F.nullif(Z.to_inchi_layers(s, layer), F.lit("")), s)
        if self.representation == "selfies":
            s = F.coalesce(F.nullif(Z.to_selfies(s), F.lit("")), s)
        if "canonical" in self.changes:
            s = Z.canonical(s)
        if "shuffled" in self.changes:
            s = Z.shuffled(s, 42)
        return Z.sorted_chars(s) if "sorted" in self.changes else s


VARIANTS = [
    Variant("smiles", ("replaced",)), Variant("smiles", ("raw",)), Variant("smiles", ("canonical", "replaced"), ("rdkit",)),
    Variant("smiles", ("replaced", "shuffled")), Variant("smiles", ("replaced", "sorted")),
    *[Variant(f"inchi_{layer}", (), ("rdkit",)) for layer in ("all", "formula", "connections", "hydrogens")],
    Variant("selfies", (), ("selfies",)),
]
#: The variants that fingerprints are made of.
FINGERPRINT_VARIANTS = [v for v in VARIANTS if v.representation == "selfies" or v.changes in (("replaced",), ("canonical", "replaced"), ("replaced", "shuffled"))]


def run_variants(lib: DataFrame, tmpl: DataFrame, methods: list[str], variants: list[Variant] | None = None) -> DataFrame:
    """variant, lib_name, tmpl_name, method, score of all variants whose libraries are here, as one query."""
    from functools import reduce

    from quillmol.plans.engine import cross_similarity

    parts = []
    for v in variants or VARIANTS:
        if v.missing():
            continue
        side = lambda d, v=v: d.withColumn("s", v.apply(F.col("s")))
        for m in methods:
            scored = cross_similarity(side(lib), side(tmpl), m, **({} if "tfidf" in m else {"pre": v.preprocessed}))
            parts.append(scored.select(F.lit(v.name).alias("variant"), "lib_name", "tmpl_name", "method", "score"))
    return reduce(DataFrame.unionByName, parts)
