"""Normalisation of molecule strings as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multi-character atoms and stereo marks, and the one character that stands for each.
REPLACEMENTS = {
    "@@": "¡", "@TH1": "¢", "@TH2": "£", "@AL1": "¤", "@AL2": "¥", "@SP1": "¦", "@SP2": "§", "@SP3": "¨", "@TB": "©", "@OH": "ª", "Cl": "L", "Br": "R", "Si": "G", "Se": "E",
    "se": "e", "As": "D", "as": "d", "Te": "T", "te": "t", "Ge": "«", "Ga": "¬", "Na": "Y", "Ca": "Ω", "Mg": "M", "Fe": "X", "Zn": "Z", "Cu": "Q", "Mn": "J",
    "Co": "K", "Ni": "Θ", "Al": "A", "Li": "Λ", "Ag": "!", "Au": "$", "Pt": "&", "Pd": "^", "Cr": "~", "Ti": "`", "Sn": ";", "Pb": ":", "Hg": "?", "Cd": "<",
    "Ba": ">", "Sr": "{", "Bi": "}", "Sb": "|", "In": "®", "Tl": "¯", "Be": "°", "Ra": "±", "Ru": "²", "Rh": "³", "Os": "´", "Ir": "µ", "Mo": "¶", "Nb": "¹",
    "Ta": "º", "Re": "»", "Tc": "¼", "W": "·", "V": "¸", "U": "Ë", "La": "½", "Ce": "¾", "Pr": "¿", "Nd": "À", "Sm": "Á", "Eu": "Â", "Gd": "Ã", "Tb": "Ä",
    "Dy": "Å", "Ho": "Æ", "Er": "Ç", "Tm": "È", "Yb": "É", "Lu": "Ê",
}
RESTORED = {v: k for k, v in REPLACEMENTS.items()}
# InChI layers and their letters.
INCHI_LAYERS = {"formula": "", "connections": "c", "hydrogens": "h", "charge": "q", "protons": "p", "stereo_db": "b", "stereo_tet": "t", "stereo_parity": "m", "stereo_type": "s", "isotope": "i", "fixedH": "f", "reconnected": "r"}

#: Longest first, so that a mark is never read as the start of a shorter one.
REPLACEMENT_PATTERN = "(?s)" + "|".join(re.escape(k) for k in sorted(REPLACEMENTS, key=len, reverse=True)) + "|."


def chars(s: Column) -> Column:
    return F.split(s, "")


def preprocess(s: Column) -> Column:
    """One pass over the string; what a replacement makes is never matched again."""
    table = F.create_map(*[F.lit(x) for kv in REPLACEMENTS.items() for x in kv])
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(REPLACEMENT_PATTERN), F.lit(0)), lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def ring_numbers(s: Column) -> Column:
    return F.regexp_replace(s, "[0-9]", "0")


def sorted_chars(s: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(chars(s), lambda c: c != "")), "")


def inchi_body(s: Column, strip_version: bool = True) -> Column:
    return F.regexp_replace(s, "^(InChI=)?(1S?/)?" if strip_version else "^InChI=", "")


def inchi_layers(s: Column, layers: str | list[str] = "all") -> Column:
    """The layers asked for, in that order; of a letter that repeats the last; absent layers are left out."""
    body = inchi_body(s)
    if layers == "all":
        return body
    names = [layers] if isinstance(layers, str) else list(layers)
    unknown = [n for n in names if n not in INCHI_LAYERS]
    if unknown:
        raise ValueError(f"unknown InChI layers: {', '.join(unknown)}")
    parts = F.split(body, "/")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def layer(name: str) -> Column:
        if name == "formula":
            return F.nullif(F.element_at(parts, 1), F.lit(""))
        return F.try_element_at(F.filter(rest, lambda x: F.startswith(x, F.lit(INCHI_LAYERS[name]))), F.lit(-1))

    return F.concat_ws("/", *map(layer, names))


def _backend(module: str, convert):
    """A row function of an optional library; None where it is missing or fails."""
    import importlib.util

    present = importlib.util.find_spec(module) is not None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return convert(x) if x else ""
            except Exception:  # what the library can't read has no other form
                return ""

        return s.map(one)

    return run if present else None


def canonical(s: Column) -> Column:
    """RDKit's canonical form where RDKit is installed; the input otherwise."""

    def convert(x):
        from rdkit import Chem

        mol = Chem.MolFromSmiles(x)
        return Chem.MolToSmiles(mol) if mol else ""

    f = _backend("rdkit", convert)
    return F.coalesce(F.nullif(f(s), F.lit("")), s) if f else s


def to_inchi(s: Column) -> Column:
    """InChI without its prefix, or an empty string."""

    def convert(x):
        from rdkit import Chem

        return Chem.MolToInchi(Chem.MolFromSmiles(x)).removeprefix("InChI=")

    f = _backend("rdkit", convert)
    return f(s) if f else F.when(s.isNotNull(), F.lit(""))


def to_selfies(s: Column) -> Column:
    def convert(x):
        import selfies

        return selfies.encoder(x)

    f = _backend("selfies", convert)
    return f(s) if f else F.when(s.isNotNull(), F.lit(""))


def to_inchi_layers(s: Column, layers: str | list[str] = "all") -> Column:
    return inchi_layers(to_inchi(s), layers)


def shuffled(s: Column, seed: int | None = 42) -> Column:
    """The characters in the order of a seeded Mersenne Twister shuffle, the same for strings of one length."""
    import random

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            own = list(v)
            random.Random(seed).shuffle(own)
            return "".join(own)

        return x.map(one)

    return run(s)
