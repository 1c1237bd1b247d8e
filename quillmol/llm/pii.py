"""Personal data by candidate boosting: fixed patterns, and beside them spans that wide generators propose and boosted trees choose."""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmol.llm.boosting import Boosted, calibrated, fit

KINDS = ("email", "ip", "card", "phone")
#: Held-out precision at which a kind's threshold is set.
PRECISION = 0.99
CONTEXT = 32

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be personal data in other writing: high recall, overlaps allowed; none
#: begins or ends inside a run of digits.
WIDE = {
    "email": r"[\w.+-]+\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[\w-]{2,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,12}){1,3}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./_-]{0,2}[0-9]){9,15}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
}
#: Words before or after a span that speak for or against a kind: fixed values.
CUES = {
    "email": "mail email e-mail contact write reach address",
    "ip": "ip host server address from login client",
    "card": "card visa mastercard credit payment pay cc",
    "phone": "call phone tel telephone mobile cell fax ring whatsapp text",
    "not": "version isbn issn order invoice id ref serial page date price total code part item section year build model",
}
_CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str, patterns: dict):
    """(start, end) of the e-mail pattern. Its local part has no @, so each @ is tried once, with the run of local characters that ends there."""
    at, after = text.find("@"), 0
    while at >= 0:
        own = text[after:at]
        start = after + len(own.rstrip(_LOCAL))
        after = at + 1
        host = patterns["host"].match(text, after) if start < at else None
        if host:
            yield start, host.end()
            after = host.end()
        at = text.find("@", after)


def _ips(text: str, patterns: dict):
    """(start, end) of the address pattern: in a chain of numbers with single dots it takes four at a time."""
    for m in patterns["chain"].finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str, patterns: dict) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind; failing matches are dropped. The time is
    linear in the text: no run of characters is tried from each of its places."""
    out = [(a, 0, b) for a, b in _emails(text, patterns)]
    if patterns["digit"].search(text):
        out += [(a, 1, b) for a, b in _ips(text, patterns)]
        for m in patterns["card"].finditer(text):
            if m.end() - m.start() <= 37:  # 19 digits and 18 separators
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in patterns["phone"].finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: Characters of an e-mail's local part.
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    """Format and context of a proposed span."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall(r"[0-9]+", span)
    near = re.findall(r"[a-z-]+", (before + " " + after).lower())
    cue = lambda k: float(any(w in _CUE_SETS[k] for w in near))
    seps = set(re.findall(r"[^0-9A-Za-z]", span))
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(bool(digits) and luhn(digits)), float(len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)),
        float(len(seps)), float("." in seps), float("-" in seps), float(" " in seps), float("/" in seps), float("(" in span and ")" in span), float(span[:1] == "+" or span[:2] == "00"),
        float("@" in span), float(bool(re.search(r"[(\[]\s?(?:at|dot|\.)\s?[)\]]", span))), float(bool(re.search(r"\sdot\s", span))), float(bool(re.search(r"\.\s", span))), float("\n" in span), float(any(ord(c) > 127 for c in span)),
        float(bool(re.match(r"[\w+-]*[._0-9+][\w.+-]*[\s@(\[]", span))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#v" and before != ""), float(after[:1] in "%°" and after != ""),
        float(bool(re.search(r"(?:19|20)[0-9]{2}[./ -][0-9]{1,2}[./ -][0-9]{1,2}|[0-9]{1,2}[./ -][0-9]{1,2}[./ -](?:19|20)[0-9]{2}", span))),
        float(len(set(digits))), cue("email"), cue("ip"), cue("card"), cue("phone"), cue("not"),
    ]


def _wide_emails(text: str, patterns: dict):
    """(start, end) of the wide e-mail pattern: each at, written in any way, with the whole name before it."""
    after = 0
    for m in patterns["at"].finditer(text):
        start = m.start() - (m.start() > after and text[m.start() - 1].isspace())
        end = start
        while start > after and ((c := text[start - 1]).isalnum() or c in "_.+-"):
            start -= 1
        after = m.end()
        host = patterns["wide_host"].match(text, after) if start < end else None
        if host:
            yield start, host.end()


def proposals(text: str, patterns: dict) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what may be personal data; may overlap."""
    out = [(a, 0, b) for a, b in _wide_emails(text, patterns)]
    if patterns["digit"].search(text):
        for k in (1, 2, 3):
            out += [(m.start(), k, m.end()) for m in patterns["wide"][KINDS[k]].finditer(text)]
    return list(dict.fromkeys(out))


def compiled() -> dict:
    """The patterns, and their parts that are tried at a place known before: what follows an at, and chains of numbers."""
    after_at = lambda p, mark: p[p.index(mark) + len(mark) :]
    parts = {"host": after_at(BASE["email"], "@"), "wide_host": after_at(WIDE["email"], r"\sat\s)"), "chain": r"[0-9]+(?:\.[0-9]+)*", "digit": "[0-9]", "at": r"@|\(at\)|\[at\]|\sat\s"}
    return {k: re.compile(p) for k, p in (BASE | parts).items()} | {"wide": {k: re.compile(p) for k, p in WIDE.items() if k != "email"}}


def _example(rng: random.Random) -> tuple[str, int, int, int, int]:
    """A text, a span in it, its kind, and whether it is personal data."""
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind, good = rng.randrange(4), rng.random() < 0.5
    cue = rng.choice(CUES[KINDS[kind] if good or rng.random() < 0.1 else "not"].split()) if rng.random() < 0.7 else letters(2, 8)
    if kind == 0:
        at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", ".")])
        name, host, end = letters(2, 9) + rng.choice(["", ".", "_", number(2)]) + letters(1, 4), letters(3, 9), rng.choice(["com", "org", "net", "de", "fr", "es"])
        if rng.random() < 0.2:  # a host as it is, after a name that is no plain word
            at, dot, name = " at ", ".", letters(2, 9) + rng.choice([".", "_", number(2)]) + letters(2, 8)
        span = f"{name}{at}{host}{dot}{end}" if good else rng.choice([f"{letters(2, 9)} at {letters(2, 8)}{rng.choice(['. ', '.\n', '.\n\n', ' . '])}{letters(2, 9).title()}", f"{letters(2, 5)} at {letters(3, 8)}.{letters(2, 4)}", f"{letters(3, 6)} at {letters(2, 4)} . {letters(4, 9)}"])
    elif kind == 1:
        octet = lambda: str(rng.randint(1, 255))
        sep = rng.choice([".", "[.]", "(.)", " . "])
        span = sep.join(octet() for _ in range(4)) if good else rng.choice([". ".join(number(rng.randint(1, 3)) for _ in range(4)), ".".join(number(rng.randint(1, 2)) for _ in range(4)), ".".join(str(rng.randint(256, 999)) for _ in range(4))])
    elif kind == 2:
        body = number(15)
        check = next(c for c in "0123456789" if luhn(body + c))
        digits = body + check if good else body + rng.choice([c for c in "0123456789" if c != check])
        sep = rng.choice(["", ".", "/", "_", " - ", "  "] if good else ["", "", " ", "-", "."])
        span = sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    else:
        shape = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"])
        good_span = shape.format(number(3), number(3), number(4)) if rng.random() < 0.6 else f"00{number(2)} {number(3)} {number(3)} {number(rng.randint(2, 4))}"
        span = good_span if good else rng.choice([f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1950, 2030)}", f"{number(2)}-{number(2)}-{number(2)}", " ".join(number(rng.randint(2, 4)) for _ in range(rng.randint(3, 5))), f"978-{number(2)}-{number(4)}-{number(3)}"])
        if good and "00" != span[:2] and "(" not in span and cue not in _CUE_SETS["phone"]:
            cue = rng.choice(CUES["phone"].split())  # bare groups of digits are a number to call only where the words say so
    before = " ".join(letters(2, 8) for _ in range(rng.randint(0, 4)))
    before = f"{before} {cue}{rng.choice([' ', ': ', ' is '])}"
    text = before + span + rng.choice([" ", ". ", ", ", ""]) + " ".join(letters(2, 8) for _ in range(rng.randint(0, 4)))
    return text, len(before), len(before) + len(span), kind, int(good)


@functools.lru_cache(maxsize=4)
def train(seed: int = 11, n: int = 6000) -> tuple[Boosted, list[float]]:
    """The trees, learned from made examples, and a threshold for each kind, calibrated on others."""
    rng = random.Random(seed)
    rows = [_example(rng) for _ in range(n)]
    x, y = np.array([features(t, a, b, k) for t, a, b, k, _ in rows]), np.array([g for *_, g in rows], float)
    kinds = np.array([k for _, _, _, k, _ in rows])
    cut = 2 * n // 3
    model = fit(x[:cut], y[:cut])
    scores = model.log_odds(x[cut:])
    return model, [max(0.0, calibrated(scores[kinds[cut:] == k], y[cut:][kinds[cut:] == k], PRECISION)) for k in range(4)]


class Taken:
    """Disjoint spans, in order."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(texts: list[str], model: Boosted, thresholds: list[float], patterns: dict) -> list[tuple[list, list]]:
    """For each text its fixed spans, and all spans; a chosen span overlaps no other."""
    base = [base_spans(t, patterns) for t in texts]
    taken = [Taken([(a, b) for a, _, b in own]) for own in base]
    rows, where = [], []
    for i, t in enumerate(texts):
        for s, k, e in proposals(t, patterns):
            if taken[i].free(s, e):
                rows.append(features(t, s, e, k))
                where.append((i, s, k, e))
    chosen: list[list] = [[] for _ in texts]
    if rows:
        scores = model.log_odds(np.array(rows))
        for j in np.argsort(-scores, kind="stable").tolist():
            i, s, k, e = where[j]
            if scores[j] >= thresholds[k] and taken[i].free(s, e):
                chosen[i].append((s, k, e))
                taken[i].add(s, e)
    return [(sorted(b), sorted(b + c)) for b, c in zip(base, chosen, strict=True)]


def shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def _apply(docs: DataFrame, columns: list[str], schema: T.StructType, row) -> DataFrame:
    model, thresholds = train()  # made once in a driver

    def run(batches):
        import pyarrow as pa

        patterns = compiled()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256).to_pylist()
                found = find([r["text"] or "" for r in part], model, thresholds, patterns)
                yield pa.RecordBatch.from_pylist([row(r, *f) for r, f in zip(part, found, strict=True)], pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in schema.fields]))

    return docs.select(*[F.col(c).cast("long" if c == "doc_id" else "string") for c in columns]).mapInArrow(run, schema)


def find_private(docs: DataFrame) -> DataFrame:
    """Counts of each kind by the fixed patterns, their checksum, and all spans of every whole text.

    A null or empty text has none. Spans go by start, then kind. Repeated rows are searched each; a null doc_id stays null; other
    columns are left out; an empty table gives an empty table.
    """

    def row(r, base, spans):
        counts = {f"n_{k}": sum(b[1] == i for b in base) for i, k in enumerate(KINDS)}
        return {"doc_id": r["doc_id"], **counts, "base_sha256": hashlib.sha256(shown(base).encode()).hexdigest(), "spans": shown(spans)}

    return _apply(docs, ["doc_id", "text"], FOUND, row)


def redact_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text with its spans replaced by their kinds, lang and source. A null text stays null."""
    return _apply(docs, ["doc_id", "text", "lang", "source"], KEPT, lambda r, base, spans: r | {"text": None if r["text"] is None else redact(r["text"], spans)})
