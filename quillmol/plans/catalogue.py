"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quillmol.functions import normalize as Z
from quillmol.functions import sql
from quillmol.functions import tokens as K
from quillmol.operators import bpe as B
from quillmol.operators import pair_kernels as P
from quillmol.operators import token_kernels as N
from quillmol.plans import batch, engine, registry, variants
from quillmol.sources import readers

# A library of 19 molecules (two of them are the templates), InChI and SELFIES strings. STRINGS and MERGES are our own.
LIBRARY = """CC(=O)C1=CC=C(Br)C(N)=C1 0054-0090
NC1=CC2=NON=C2C=C1 0061-0013
OCN1C=NC=N1 0062-0039
NC1=NC2=C(S1)C=CC1=CC=CC=C21 0082-0017
CCN(CC)C1=CC=C2C(C)=C(CO)C(=O)OC2=C1 0083-0114
O=C1SC(NC2=CC=CC=C2)C(=O)N1C1=CC=CC=C1 0086-0080
CNC1=CC=C(Br)C2=C1C(=O)C1=CC=CC=C1C2=O 0092-0008
OCCNC(=O)C1=CC2=CC=CC=C2OC1=O 0096-0280
CCCCCCOC(=O)C(N)CC(C)C 0098-0003
NC1=CC=C2C(OC(=O)C=C2C(F)(F)F)=C1 0099-0265
NCC(CC(O)=O)C1CCCCC1 0107-0034
NC1=CC=C2OC(=NC2=C1)C1=CC=CC=C1 0109-0002
NC1=CC=C(C=C1)C1=NC2=CC=CC=C2O1 0109-0045
NC1=CC=C2NC(=NC2=C1)C1=CC=C(C=C1)C(O)=O 0109-0175
CC1=NC2=CC=C(CCO)C=C2S1 0133-0036
NC1=CC=C(Br)C=C1C(=O)C1=CC=CC=C1 0133-0054
CC1=NC2=CC(CCO)=CC=C2S1 0133-0074
CC1=NC2=CC(CO)=CC=C2N1C1=CC=CC=C1 0133-0083
NC1=CC=C(Br)C=C1C(=O)C1=CC=CC=C1Cl 0133-0086"""
TEMPLATES = ["0054-0090", "0133-0086"]
STRINGS = ["CCCCl", "c1ccc(Br)cc1", "C[C@@H](Cl)Br", "[Si]", "[Ni]", "[W]", "", "[C@TH1]", "C%10CC%10", "[nH+]", "C(=O)O", "CSn1cccc1", "F/C=C\\F", "[13C@H](O)N"]
INCHI = ["InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3", "1S/CH4/h1H4", "InChI=1S/C9H8O4/c1-6(10)13-8-5-3-2-4-7(8)9(11)12/h2-5H,1H3,(H,11,12)", "InChI=1/C4H8/c1-3-4-2/h3-4H,1-2H3/b4-3+", "C2H4/h1-2H2/i1D/h2D"]
SELFIES = ["[C][C][O]", "[C][C][N]", "[C][C][S]", "[C][=C][C][=C][Ring1][Branch1]x", "[C][C][Branch1][C][O][O]"]
MERGES = [("C", "C"), ("=", "C"), ("C", "=C"), ("(", "="), ("1", "=CC"), ("CC", "=C"), ("C", "1"), ("=", "O"), ("(=", "O"), ("N", "C1"), ("C", ")"), ("O", ")"), ("2", "=C"), ("=C", "C"), ("C", "(=O"), ("=CC", "=C")]


def _library(spark, names=None):
    rows = [(i, *reversed(line.split())) for i, line in enumerate(LIBRARY.splitlines())]
    return spark.createDataFrame([r for r in rows if names is None or r[1] in names], "pos long, name string, s string")


# Molecule files that the scan queries write and read, and the molecules in them.
FILES = {
    "scan_smi": ("a.smi", "CCO ethanol\nCCC\n\n# note\nCCN x\nCCS x\nCCP\n", {}, [(0, "ethanol", "CCO"), (1, "mol_1", "CCC"), (4, "x", "CCN"), (5, "x_1", "CCS"), (6, "mol_2", "CCP")]),
    "scan_csv": ("a.csv", "ID,SMILES\np1,CCO\np2,CCC\np1,CCN\n", {"smiles_col": "SMILES", "name_col": "ID"}, [(1, "p1", "CCO"), (2, "p2", "CCC"), (3, "p1_1", "CCN")]),
    "scan_tsv": ("a.tsv", "s\tn\nCCO\tone two\nCCC\tthree\n", {}, [(1, "one two", "CCO"), (2, "three", "CCC")]),
}


def _scratch(spark):
    """A new folder that all executors share: below spark.checkpoint.dir, or where it is unset and all is local a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local-cluster") and spark.sparkContext.master.startswith("local"):
        top = tempfile.gettempdir()
    if not top:
        raise ValueError("spark.checkpoint.dir is unset")
    return f"{top.rstrip('/')}/quillmol-files-{uuid.uuid4().hex}"


def _put(spark, path, body):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(body.encode()))
    out.close()
    return path


def _scan(spark, name):
    file, body, options, _ = FILES[name]
    return readers.read_molecules(spark, _put(spark, f"{_scratch(spark)}/{file}", body), **options).select("pos", "name", "s")


def _scan_directory(spark):
    folder = _scratch(spark)
    for file, body in (("m1.smi", "CCO"), ("m2.smi", "CCC propane\nCCCC butane"), ("m3.smi", "CCN m1"), ("m4.txt", "CCS other"), ("m5.smi", "")):
        _put(spark, f"{folder}/{file}", body)
    return readers.read_molecules(spark, folder).select("pos", "name", "s")


def _with_functions(spark, sf_dir):
    sql.register(spark)
    p = _parts(spark, sf_dir)
    return p.alias("a").crossJoin(F.broadcast(p.alias("b"))).selectExpr("a.name as lib_name", "b.name as tmpl_name", "round(jaro(a.s, b.s), 6) as jaro", "damerau_levenshtein(a.s, b.s) as edits")  # the distinct part names


def _strings(spark, rows):
    return spark.createDataFrame([(i, f"m{i}", s) for i, s in enumerate(rows)], "pos long, name string, s string")


def _parts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    return p.select(F.col("p_name").alias("name"), F.col("p_name").alias("s"))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def flagship(spark, sf_dir):
    """LINGO of every pair of distinct part names."""
    p = _parts(spark, sf_dir)
    return _scored(engine.cross_similarity(p, p, "lingo", pre=False))


def _scored(df):
    return df.select("lib_name", "tmpl_name", F.round("score", 6).alias("score"))


# --- SQL pieces ---

_q = lambda s: "'" + s.replace("'", "''") + "'"
_values = lambda rows: "(values " + ", ".join(f"({i}, {_q(n)}, {_q(s)})" for i, n, s in rows) + ") v(pos, name, s)"
_LIB_ROWS = [(i, *reversed(line.split())) for i, line in enumerate(LIBRARY.splitlines())]
_LIB = "select * from " + _values(_LIB_ROWS)
_TMPL = "select * from " + _values([r for r in _LIB_ROWS if r[1] in TEMPLATES])
_PARTS = "select distinct p_name as name, p_name as s from part"
_rows = lambda rows: "select * from " + _values([(i, f"m{i}", s) for i, s in enumerate(rows)])

_case = "case t " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in Z.REPLACEMENTS.items()) + " else t end"
_pp = lambda s: f"array_to_string(list_transform(regexp_extract_all({s}, {_q(Z.REPLACEMENT_PATTERN)}), lambda t: {_case}), '')"
_rings = lambda s: f"regexp_replace({s}, '[0-9]', '0', 'g')"
_kmers = lambda s, k: f"list_transform(range(1, length({s}) - {k} + 2), lambda i: substr({s}, i, {k}))"
_all = lambda s, p: f"regexp_extract_all({s}, {_q(p)})"
_subs = lambda s, least=2: f"flatten(list_transform(range(1, length({s}) - {least} + 2), lambda i: list_transform(range({least}, length({s}) - i + 2), lambda w: substr({s}, i, w))))"
_grams = lambda t, m, n: "flatten([" + ", ".join(f"list_transform(range(1, len({t}) - {k} + 2), lambda i: array_to_string({t}[i:i + {k - 1}], ' '))" for k in range(m, n + 1)) + "])"


def _overlap_sql(lib: str, tmpl: str, toks: str, score: str, shown: str = "round(({})::double, 6)") -> str:
    """toks: SQL of the tokens of s; score: SQL over l/t: u, sm, sq, s and shared, least_, ratio, dot."""
    return f"""
with lib as ({lib}), tmpl as ({tmpl}),
lc as (select name, tok, count(*)::double as n from (select name, unnest({toks}) as tok from lib) group by all),
tc as (select name, tok, count(*)::double as n from (select name, unnest({toks}) as tok from tmpl) group by all),
l as (select lib.name, lib.s, coalesce(count(tok), 0) as u, coalesce(sum(n), 0) as sm, coalesce(sum(n * n), 0) as sq from lib left join lc on lib.name = lc.name group by all),
t as (select tmpl.name, tmpl.s, coalesce(count(tok), 0) as u, coalesce(sum(n), 0) as sm, coalesce(sum(n * n), 0) as sq from tmpl left join tc on tmpl.name = tc.name group by all),
m as (select lc.name as ln, tc.name as tn, count(*) as shared, sum(least(lc.n, tc.n)) as least_, sum(2 * least(lc.n, tc.n) / (lc.n + tc.n)) as ratio, sum(lc.n * tc.n) as dot from lc join tc on lc.tok = tc.tok group by all),
x as (select l.name as lib_name, t.name as tmpl_name, l.s as ls, t.s as ts, l.u as lu, l.sm as lsm, l.sq as lsq, t.u as tu, t.sm as tsm, t.sq as tsq,
    coalesce(shared, 0) as shared, coalesce(least_, 0) as least_, coalesce(ratio, 0) as ratio, coalesce(dot, 0) as dot from l cross join t left join m on l.name = ln and t.name = tn)
select lib_name, tmpl_name, {shown.format(score)} as score from x"""


_LINGO_SCORE = "case when lu + tu - shared = 0 then 1.0 else ratio / (lu + tu - shared) end"
_tversky = lambda a, b: f"case when lsm = 0 and tsm = 0 then 1.0 when least_ + {a} * (lsm - least_) + {b} * (tsm - least_) = 0 then 0.0 else least_ / (least_ + {a} * (lsm - least_) + {b} * (tsm - least_)) end"
_coef = {"tanimoto": "dot / nullif(lsq + tsq - dot, 0)", "cosine": "dot / nullif(sqrt(lsq) * sqrt(tsq), 0)", "dice": "2 * dot / nullif(lsq + tsq, 0)"}
_spectrum = lambda k, c: f"case when length(ls) < {k} and length(ts) < {k} then (ls = ts)::int when length(ls) < {k} or length(ts) < {k} then 0.0 else coalesce({_coef[c]}, 0.0) end"


def _tfidf_sql(lib: str, tmpl: str, toks: str) -> str:
    return f"""
with lib as ({lib}), tmpl as ({tmpl}),
corpus as (select row_number() over () as i, s from (select s from lib union all select s from tmpl)),
idf as (select tok, ln((1.0 + (select count(*) from corpus)) / (1.0 + count(distinct i))) + 1.0 as idf from (select i, unnest({toks}) as tok from corpus) group by tok),
lw as (select name, c.tok, (1 + ln(n)) * idf as w from (select name, tok, count(*) as n from (select name, unnest({toks}) as tok from lib) group by all) c join idf on c.tok = idf.tok),
tw as (select name, c.tok, (1 + ln(n)) * idf as w from (select name, tok, count(*) as n from (select name, unnest({toks}) as tok from tmpl) group by all) c join idf on c.tok = idf.tok),
ln_ as (select name, sqrt(sum(w * w)) as norm from lw group by 1), tn_ as (select name, sqrt(sum(w * w)) as norm from tw group by 1),
d as (select lw.name as a, tw.name as b, sum(lw.w * tw.w) as dot from lw join tw on lw.tok = tw.tok group by all)
select lib.name as lib_name, tmpl.name as tmpl_name, round(coalesce(dot / (ln_.norm * tn_.norm), 0.0), 6) as score
from lib cross join tmpl left join d on a = lib.name and b = tmpl.name left join ln_ on ln_.name = lib.name left join tn_ on tn_.name = tmpl.name"""


_ONE = "case h when 0 then 1 + k * (z - 1) when 1 then z when 2 then 2 else 0 end"
_TWO = "case h when 0 then 1 + 4 * (z - 1) + 6 * (z - 1) * (z - 1) when 1 then z + 3 * (z - 1) * (2 + z - 2) when 2 then 4 + 2 * (z - 2) * 2 + (z - 2) * (z - 2) + 2 * 2 * (z - 1) when 3 then 6 + 6 * (z - 2) when 4 then 6 else 0 end"


def _mismatch_sql(lib: str, tmpl: str, k: int, weight: str, score: str = "d::double / (p + q - d)") -> str:
    """weight: SQL of what two k-mers at distance h share, of z letters."""
    ham = " + ".join(f"(substr(u.tok, {i}, 1) <> substr(v.tok, {i}, 1))::int" for i in range(1, k + 1))
    w = weight.replace("k *", f"{k} *")
    side = lambda x: f"select name, tok, count(*)::double as n from (select name, unnest({_kmers('s', k)}) as tok from {x}) group by all"
    sums = lambda x, y, on: f"select u.name as a, v.name as b, {ham} as h, sum(u.n * v.n) as w from {x} u join {y} v on {on} group by all"
    return f"""with lib as ({lib}), tmpl as ({tmpl}), lc as ({side('lib')}), tc as ({side('tmpl')}),
dd as ({sums('lc', 'tc', 'true')}), pp as ({sums('lc', 'lc', 'u.name = v.name')}), qq as ({sums('tc', 'tc', 'u.name = v.name')}),
x as (select l.name as a, t.name as b, l.s as ls, t.s as ts, len(list_distinct(string_split(l.s || t.s, '')))::double as z from lib l cross join tmpl t),
y as (select x.*, (select sum(w * {w}) from dd where dd.a = x.a and dd.b = x.b) as d, (select sum(w * {w}) from pp where pp.a = x.a) as p, (select sum(w * {w}) from qq where qq.a = x.b) as q from x)
select a as lib_name, b as tmpl_name, round(case when length(ls) < {k} and length(ts) < {k} then (ls = ts)::int::double when length(ls) < {k} or length(ts) < {k} then 0.0 else {score} end, 6) as score from y"""


def _pair_sql(side: str, score: str, extra: str = "") -> str:
    return f"with recursive p as ({side}){extra} select a.name as lib_name, b.name as tmpl_name, round(({score})::double, 6) as score from p a cross join p b"


_LCS = """, q as (select a.name as x, b.name as y, a.s as a, b.s as b from p a cross join p b),
r as (select x, y, a, b, 0 as i, list_transform(range(length(b) + 1), lambda j: 0) as row_ from q
  union all select x, y, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [greatest(row_[j + 1], row_[j] + (substr(a, i + 1, 1) = substr(b, j, 1))::int)]),
    lambda acc, v: list_append(acc, greatest(acc[-1], v[1])), [0]) from r where i < length(a)),
n as (select x, y, row_[-1] as n from r where i = length(a))"""
_RUNS = """, q as (select a.name as x, b.name as y, a.s as a, b.s as b from p a cross join p b),
w as (select x, y, unnest(range(1, length(a) + 1)) as i, a, b from q), w2 as (select x, y, i, unnest(range(1, length(a) - i + 2)) as k, a, b from w),
n as (select q.x, q.y, coalesce(max(k), 0) as n from q left join w2 on q.x = w2.x and q.y = w2.y and contains(w2.b, substr(w2.a, i, k)) group by all)"""
_PREFIX = "(select coalesce(max(k), 0) from unnest(range(1, least(length(a.s), length(b.s)) + 1)) u(k) where substr(a.s, 1, k) = substr(b.s, 1, k))"
_of_n = "(select n from n where x = a.name and y = b.name)"


def _counts_sql(s: str, chars: list[str], binary: bool = False) -> str:
    one = lambda c: f"len(list_filter(string_split({s}, ''), lambda x: x = {_q(c)}))"
    return "[" + ", ".join(f"({one(c)} > 0)::int::double" if binary else f"{one(c)}::double" for c in chars) + "]"


_text = lambda expr, sep="' '": f"array_to_string({expr}, {sep})"
_join = lambda c: F.array_join(c, " ")

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _register():
    lib = lambda spark: _library(spark)
    tmpl = lambda spark: _library(spark, TEMPLATES)
    # scalar functions
    _add("preprocess", lambda sp, d: _strings(sp, STRINGS).select("name", Z.preprocess(F.col("s")).alias("v")), f"select name, {_pp('s')} as v from ({_rows(STRINGS)})")
    _add("ring_norm", lambda sp, d: _documents(sp, d).select("doc_id", Z.ring_numbers(F.col("text")).alias("v")), f"select doc_id, {_rings('text')} as v from documents")
    _add("augment_sort", lambda sp, d: _parts(sp, d).select("name", Z.sorted_chars(F.col("s")).alias("v")), f"select name, array_to_string(list_sort(string_split(s, '')), '') as v from ({_PARTS})")
    body = "regexp_replace(s, '^(InChI=)?(1S?/)?', '')"
    _add("inchi_clean", lambda sp, d: _strings(sp, INCHI).select("name", Z.inchi_body(F.col("s")).alias("v")), f"select name, {body} as v from ({_rows(INCHI)})")
    layer = lambda p: f"list_filter(string_split({body}, '/')[2:], lambda x: x[1:1] = '{p}')[-1]"
    _add("inchi_layers", lambda sp, d: _strings(sp, INCHI).select("name", Z.inchi_layers(F.col("s"), ["hydrogens", "formula", "connections", "isotope"]).alias("v")),
         f"select name, concat_ws('/', {layer('h')}, string_split({body}, '/')[1], {layer('c')}, {layer('i')}) as v from ({_rows(INCHI)})")
    _add("canonicalize", lambda sp, d: lib(sp).select("name", Z.canonical(F.col("s")).alias("v")))
    _add("to_inchi", lambda sp, d: lib(sp).select("name", Z.to_inchi(F.col("s")).alias("v")))
    _add("to_selfies", lambda sp, d: lib(sp).select("name", Z.to_selfies(F.col("s")).alias("v")))
    _add("augment_shuffle", lambda sp, d: lib(sp).select("name", Z.shuffled(F.col("s"), 42).alias("v")))
    # tokenisers
    for name, make, sql in (("lingo_tokens", lambda s: K.lingos(s), _kmers("p", 4)), ("kmer_tokens", lambda s: K.lingos(s, 4, rings=False), _kmers("p", 4))):
        inner = _rings(_pp("s")) if name == "lingo_tokens" else _pp("s")
        _add(name, lambda sp, d, make=make: lib(sp).select("name", _join(make(F.col("s"))).alias("v")), f"select name, {_text(sql)} as v from (select name, {inner} as p from ({_LIB}))")
    _add("substrings", lambda sp, d: _parts(sp, d).select("name", _join(K.substrings(F.col("s"))).alias("v")), f"select name, {_text(_subs('s'))} as v from ({_PARTS})")
    for name, make, pattern, rows in (("tok_smiles", K.chemical, K.CHEMICAL_PATTERN, STRINGS), ("tok_schwaller", K.atoms, K.ATOM_PATTERN, STRINGS), ("tok_selfies", K.selfies_tokens, K.SELFIES_PATTERN, SELFIES)):
        _add(name, lambda sp, d, make=make, rows=rows: _strings(sp, rows).select("name", _join(make(F.col("s"))).alias("v")), f"select name, {_text(_all('s', pattern))} as v from ({_rows(rows)})")
    _add("tok_lingo_words", lambda sp, d: lib(sp).select("name", _join(K.lingo_words(F.col("s"))).alias("v")), f"select name, {_text(_all('lower(' + _text(_kmers('p', 4)) + ')', '[^ ]+'))} as v from (select name, {_rings(_pp('s'))} as p from ({_LIB}))")
    _add("ngrams", lambda sp, d: lib(sp).select("name", F.array_join(K.ngrams(K.chemical(F.col("s")), 1, 3), "|").alias("v")), f"select name, {_text(_grams('t', 1, 3), _q('|'))} as v from (select name, {_all('s', K.CHEMICAL_PATTERN)} as t from ({_LIB}))")
    # token kernels on molecules (replaced) and on part names (raw)
    pl = f"select pos, name, {_rings(_pp('s'))} as s from ({_LIB})"
    pt = f"select pos, name, {_rings(_pp('s'))} as s from ({_TMPL})"
    ul = f"select pos, name, {_pp('s')} as s from ({_LIB})"
    ut = f"select pos, name, {_pp('s')} as s from ({_TMPL})"
    mol = lambda m, **kw: lambda sp, d: _scored(engine.cross_similarity(lib(sp), tmpl(sp), m, **kw))
    part = lambda m, **kw: lambda sp, d: _scored(engine.cross_similarity(_parts(sp, d), _parts(sp, d), m, **({} if "tfidf" in m else {"pre": False}) | kw))
    ringed = f"select name, {_rings('s')} as s from ({_PARTS})"
    for m, q, score in (("lingo", 4, _LINGO_SCORE), ("lingo3", 3, _LINGO_SCORE), ("lingo5", 5, _LINGO_SCORE), ("lingo_tversky", 4, _tversky(0.9, 0.1)), ("lingo_tversky_sym", 4, _tversky(0.5, 0.5)), ("lingo_dice", 4, _tversky(0.5, 0.5))):
        _add(f"sim_{m}", mol(m), _overlap_sql(pl, pt, _kmers("s", q), score))
        _add(f"part_{m}", part(m), _overlap_sql(ringed, ringed, _kmers("s", q), score))
    for m, k, c in (("spectrum", 4, "tanimoto"), ("spectrum3", 3, "tanimoto"), ("spectrum5", 5, "tanimoto"), ("spectrum_cosine", 4, "cosine")):
        _add(f"sim_{m}", mol(m), _overlap_sql(ul, ut, _kmers("s", k), _spectrum(k, c)))
        _add(f"part_{m}", part(m), _overlap_sql(_PARTS, _PARTS, _kmers("s", k), _spectrum(k, c)))
    _add("sim_spectrum_dice", lambda sp, d: _scored(N.spectrum(lib(sp).drop("pos"), tmpl(sp).drop("pos"), 4, "dice").withColumnsRenamed({"l_name": "lib_name", "t_name": "tmpl_name"})), _overlap_sql(ul, ut, _kmers("s", 4), _spectrum(4, "dice")))
    sub = "case when lsq = 0 or tsq = 0 then 0.0 else dot / sqrt(lsq * tsq) end"
    _add("sim_substring", mol("substring"), _overlap_sql(ul, ut, _subs("s"), sub))
    _add("sim_substring_raw", mol("substring", normalized=False), _overlap_sql(ul, ut, _subs("s"), "dot"))
    _add("part_substring", part("substring"), _overlap_sql(_PARTS, _PARTS, _subs("s"), sub))
    for m, k in (("mismatch", 4), ("mismatch3", 3), ("mismatch5", 5)):
        _add(f"sim_{m}", mol(m), _mismatch_sql(ul, ut, k, _ONE))
        _add(f"part_{m}", part(m), _mismatch_sql(_PARTS, _PARTS, k, _ONE))
    renamed = lambda df: _scored(df.withColumnsRenamed({"l_name": "lib_name", "t_name": "tmpl_name"}))
    plain = lambda sp: (lib(sp).drop("pos"), tmpl(sp).drop("pos"))
    _add("sim_mismatch_m2", lambda sp, d: renamed(N.mismatch(*plain(sp), k=4, m=2)), _mismatch_sql(ul, ut, 4, _TWO))
    _add("sim_mismatch_m0", lambda sp, d: renamed(N.mismatch(*plain(sp), m=0)), _overlap_sql(ul, ut, _kmers("s", 4), _spectrum(4, "tanimoto")))
    _add("sim_mismatch_rings", lambda sp, d: renamed(N.mismatch(*plain(sp), rings=True, coefficient="dice")), _mismatch_sql(pl, pt, 4, _ONE, "2.0 * d / (p + q)"))
    neighbours = f"flatten(list_transform({_kmers('s', 3)}, lambda w: list_distinct(list_append(flatten(list_transform(range(1, 4), lambda i: list_transform(['C', 'N', 'O'], lambda c: substr(w, 1, i - 1) || c || substr(w, i + 1)))), w))))"
    _add("sim_mismatch_alphabet", lambda sp, d: renamed(N.mismatch(*plain(sp), k=3, alphabet="CNO")), _overlap_sql(ul, ut, neighbours, _spectrum(3, "tanimoto")))
    # character fingerprints
    for name, chars in (("smifp", P.SMIFP34), ("smifp38", P.SMIFP38)):
        za, zb = _counts_sql("a.s", chars), _counts_sql("b.s", chars)
        dot = lambda x, y: f"list_dot_product({x}, {y})"
        _add(f"sim_{name}_cbd", part(f"{name}_cbd"), f"with p as (select name, s, {_counts_sql('s', chars)} as v from ({_PARTS})) select a.name as lib_name, b.name as tmpl_name, round(1.0 / (1.0 + list_sum(list_transform(range(1, {len(chars) + 1}), lambda i: abs(a.v[i] - b.v[i])))), 6) as score from p a cross join p b")
        _add(f"sim_{name}_tanimoto", part(f"{name}_tanimoto"), f"with p as (select name, {_counts_sql('s', chars)} as v from ({_PARTS})) select a.name as lib_name, b.name as tmpl_name, round(case when {dot('a.v', 'a.v')} = 0 and {dot('b.v', 'b.v')} = 0 then 1.0 else coalesce({dot('a.v', 'b.v')} / nullif({dot('a.v', 'a.v')} + {dot('b.v', 'b.v')} - {dot('a.v', 'b.v')}, 0), 0.0) end, 6) as score from p a cross join p b")
        fp = "smifp34" if name == "smifp" else name
        for suffix, binary in (("", False), ("_binary", True)):
            _add(f"fp_{fp}{suffix}", lambda sp, d, k=fp + suffix: engine.fingerprints(lib(sp), k).select("name", F.array_join(F.transform("fp", lambda x: F.format_string("%.0f", x)), ",").alias("v")),
                 f"select name, array_to_string(list_transform({_counts_sql('s', chars, binary)}, lambda x: x::int), ',') as v from ({ul})")
    _add("fp_documents", lambda sp, d: _documents(sp, d).select("doc_id", F.array_join(F.transform(P.smifp(F.col("text"), P.SMIFP34), lambda x: F.format_string("%.0f", x)), ",").alias("v")), f"select doc_id, array_to_string(list_transform({_counts_sql('text', P.SMIFP34)}, lambda x: x::int), ',') as v from documents")
    cells = ", ".join(f"printf('%.0f', v[{i + 1}]) as bit_{i}" for i in range(34))
    _add("fp_wide", lambda sp, d: engine.wide_fingerprints(engine.fingerprints(lib(sp), "smifp34"), 34), f"select pos::bigint as pos, name as \"Name\", {cells} from (select pos, name, {_counts_sql('s', P.SMIFP34)} as v from ({ul}))")
    # pair kernels on part names
    _n = lambda f: f"case when length(a.s) = 0 and length(b.s) = 0 then 1.0 when length(a.s) = 0 or length(b.s) = 0 then 0.0 else {f} end"
    size = "greatest(length(a.s), length(b.s))"
    _add("sim_edit", part("edit"), _pair_sql(_PARTS, f"1.0 - levenshtein(a.s, b.s)::double / {size}"))
    _add("sim_hamming", part("hamming"), _pair_sql(_PARTS, f"1.0 - hamming(rpad(a.s, {size}::int, ' '), rpad(b.s, {size}::int, ' '))::double / {size}"))
    _add("sim_damerau", part("damerau_levenshtein"), _pair_sql(_PARTS, f"1.0 - damerau_levenshtein(a.s, b.s)::double / {size}"))
    _add("sim_jaro", part("jaro"), _pair_sql(_PARTS, "jaro_similarity(a.s, b.s)"))
    _add("sim_jaro_winkler", part("jaro_winkler"), _pair_sql(_PARTS, "jaro_winkler_similarity(a.s, b.s)"))
    square = "n * n / (length(a.s) * length(b.s))"
    joined = lambda cte, score: f"with recursive p as ({_PARTS}){cte} select a.name as lib_name, b.name as tmpl_name, round(({_n(score)})::double, 6) as score from p a cross join p b join n on n.x = a.name and n.y = b.name"
    _add("sim_nlcs", part("nlcs"), joined(_LCS, square))
    _add("lcs_substring", part("lcs_substring"), joined(_RUNS, square))
    _add("sim_prefix", lambda sp, d: N.pairs(_parts(sp, d), _parts(sp, d)).select(F.col("l_name").alias("lib_name"), F.col("t_name").alias("tmpl_name"), P.prefix_length("l_s", "t_s").cast("double").alias("score")),
         f"with p as ({_PARTS}) select a.name as lib_name, b.name as tmpl_name, {_PREFIX}::double as score from p a cross join p b")
    both = _LCS.replace(" n as (", " n1 as (").replace("\nn as (", "\nn1 as (") + ", " + _RUNS[_RUNS.index("\nw as") + 1 :]
    _add("sim_clcs", part("clcs"), f"with recursive p as ({_PARTS}){both} select a.name as lib_name, b.name as tmpl_name, round((0.33 * n1.n * n1.n + 0.33 * {_PREFIX} * {_PREFIX} + 0.34 * n.n * n.n)::double / (length(a.s) * length(b.s)), 6) as score from p a cross join p b join n on n.x = a.name and n.y = b.name join n1 on n1.x = a.name and n1.y = b.name")
    _add("sim_ncd", part("ncd"))
    # TF-IDF
    for family, rows, pattern in (("smiles", None, K.CHEMICAL_PATTERN), ("schwaller", None, K.ATOM_PATTERN), ("selfies", SELFIES, K.SELFIES_PATTERN)):
        for m, n in ((1, 2), (1, 1), (2, 2), (4, 4), (1, 6), (6, 6)):
            left = (lambda sp, rows=rows: _strings(sp, rows)) if rows else lib
            right = (lambda sp, rows=rows: _strings(sp, rows).where("pos < 2")) if rows else tmpl
            lsql, tsql = (_rows(rows), f"select * from ({_rows(rows)}) where pos < 2") if rows else (_LIB, _TMPL)
            toks = _grams(_all("s", pattern), m, n)
            _add(f"sim_tok_{family}_tfidf_{m}{n}", lambda sp, d, left=left, right=right, k=f"tok-{family}_tfidf{m}{n}": _scored(engine.cross_similarity(left(sp), right(sp), k)), _tfidf_sql(lsql, tsql, toks))
    words = _all("lower(" + _text(_kmers("s", 4)) + ")", "[^ ]+")
    _add("sim_lingo_tfidf", lambda sp, d: _scored(N.tfidf(lib(sp).drop("pos"), tmpl(sp).drop("pos"), K.lingo_words).withColumnsRenamed({"l_name": "lib_name", "t_name": "tmpl_name"})), _tfidf_sql(pl, pt, words))
    pair_words = _all("lower(" + _text(_kmers("s", 4)) + ")", "[^ ]+")
    _add("sim_lingo_tfidf_pair", lambda sp, d: renamed(N.tfidf_of_pairs(*plain(sp), K.lingo_words)), f"""
with lib as ({pl}), tmpl as ({pt}), l as (select name, tok, 1 + ln(count(*)) as w from (select name, unnest({pair_words}) as tok from lib) group by all), t as (select name, tok, 1 + ln(count(*)) as w from (select name, unnest({pair_words}) as tok from tmpl) group by all),
x as (select a.name as a, b.name as b, l.tok, l.w, exists(select 1 from t where t.name = b.name and t.tok = l.tok) as both_ from lib a cross join tmpl b join l on l.name = a.name),
y as (select a.name as a, b.name as b, t.tok, t.w, exists(select 1 from l where l.name = a.name and l.tok = t.tok) as both_ from lib a cross join tmpl b join t on t.name = b.name),
p as (select a, b, sum(pow(w * case when both_ then 1.0 else ln(1.5) + 1 end, 2)) as n from x group by all), q as (select a, b, sum(pow(w * case when both_ then 1.0 else ln(1.5) + 1 end, 2)) as n from y group by all),
d as (select x.a, x.b, sum(x.w * y.w) as dot from x join y on x.a = y.a and x.b = y.b and x.tok = y.tok group by all)
select p.a as lib_name, p.b as tmpl_name, round(coalesce(dot, 0.0) / sqrt(p.n * q.n), 6) as score from p join q on p.a = q.a and p.b = q.b left join d on d.a = p.a and d.b = p.b""")
    _add("lingo_vectors_counts", lambda sp, d: N.word_vectors(lib(sp), K.lingo_words, use_idf=False), f"select name, tok, count(*)::double as w from (select name, unnest({pair_words}) as tok from ({pl})) group by all")
    _add("lingo_vectors", lambda sp, d: N.word_vectors(lib(sp), K.lingo_words).withColumn("w", F.round("w", 6)), f"""with c as (select name, tok, count(*) as n from (select name, unnest({pair_words}) as tok from ({pl})) group by all),
i as (select tok, ln((1.0 + (select count(*) from ({pl}))) / (1.0 + count(*))) + 1.0 as idf from c group by tok), w as (select name, c.tok, (1 + ln(n)) * idf as w from c join i on c.tok = i.tok)
select name, tok, round(w / sqrt(sum(w * w) over (partition by name)), 6) as w from w""")
    grams12 = _grams(_all(_pp("s"), K.CHEMICAL_PATTERN), 1, 2)
    _add("sim_tok_smiles_tfidf_legacy", mol("tok-smiles_tfidf44", legacy_batch=True), _tfidf_sql(_LIB, _TMPL, grams12))
    # matrices
    _add("golden_lingo_wide", lambda sp, d: engine.wide_scores(engine.cross_similarity(lib(sp), tmpl(sp), "lingo"), lib(sp), TEMPLATES),
         f"with g as ({_overlap_sql(pl, pt, _kmers('s', 4), _LINGO_SCORE, '{}')}) select pos::bigint as pos, name as \"Name\", " + ", ".join(f"printf('%.5f', max(score) filter (tmpl_name = '{t}')) as \"Similarity_{t}\"" for t in TEMPLATES) + f" from g join ({_LIB}) l on l.name = lib_name group by pos, name")
    _add("self_lingo", lambda sp, d: _scored(engine.self_similarity(lib(sp), "lingo")), f"select lib_name, tmpl_name, case when lib_name = tmpl_name then 1.0 else score end as score from ({_overlap_sql(pl, pl, _kmers('s', 4), _LINGO_SCORE)})")
    _add("top_parts", lambda sp, d: engine.top_k(_scored(engine.cross_similarity(_parts(sp, d), _parts(sp, d), "lingo", pre=False)), 3).select("lib_name", "tmpl_name", "score", "rank"),
         f"select * from (select *, row_number() over (partition by tmpl_name order by score desc, lib_name) as rank from ({_overlap_sql(ringed, ringed, _kmers('s', 4), _LINGO_SCORE)})) where rank <= 3")
    _add("variants_lingo", lambda sp, d: variants.run_variants(lib(sp), tmpl(sp), ["lingo", "edit"]).withColumn("score", F.round("score", 6)))
    _add("dry_jobs", lambda sp, d: sp.createDataFrame([(v.name, n) for v, n in batch.jobs("fingerprints") if not v.needs], "variant string, name string"),
         "select v.variant, f.name from (values ('smiles__replaced'), ('smiles__replaced_shuffled')) v(variant) cross join (values " + ", ".join(f"('{n}')" for n in registry.FINGERPRINTS) + ") f(name)")
    # files and SQL functions
    shown = lambda rows: "select pos::bigint as pos, name, s from (values " + ", ".join(f"({i}, {_q(n)}, {_q(s)})" for i, n, s in rows) + ") v(pos, name, s)"
    for name, (_, _, _, rows) in FILES.items():
        _add(name, lambda sp, d, name=name: _scan(sp, name), shown(rows))
    _add("scan_smi_dir", lambda sp, d: _scan_directory(sp), shown([(0, "m1", "CCN"), (1, "propane", "CCC")]))
    _add("sql_functions", _with_functions, f"with p as ({_PARTS}) select a.name as lib_name, b.name as tmpl_name, round(jaro_similarity(a.s, b.s), 6) as jaro, damerau_levenshtein(a.s, b.s)::int as edits from p a cross join p b")
    # merges
    _add("bpe_vocab", lambda sp, d: B.bpe_vocabulary(sp, MERGES), "select rank::int as rank, a, b from (values " + ", ".join(f"({i}, {_q(a)}, {_q(b)})" for i, (a, b) in enumerate(MERGES)) + ") v(rank, a, b)")
    _add("tok_bpe16", lambda sp, d: lib(sp).select("name", _join(B.bpe(F.col("s"), MERGES)).alias("v")))
    for kind in ("count", "binary"):
        _add(f"fp_bpe16_{kind}", lambda sp, d, kind=kind: engine.fingerprints(lib(sp), f"bpe16_{kind}", merges=MERGES).select("name", F.array_join(F.transform("fp", lambda x: F.format_string("%.0f", x)), ",").alias("v")))
    _add("sim_tok_bpe16_tfidf_12", mol("tok-bpe16_tfidf12", merges=MERGES))


_register()
