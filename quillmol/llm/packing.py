"""Best-fit packing of token sequences under several capacities at once."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmol.llm.common import stash

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs, some 60 bytes each; there are as many tasks as the pieces need.
PIECES = 1 << 16
#: Chunks whose ids a worker keeps, about 200 bytes each.
CACHE = 400_000

PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField("piece", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
)
PACKED = T.StructType([*PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


class Ids:
    """Ids of whole texts by one byte-level BPE file of the tokenizers library.

    A text is cut before single spaces, where pre-tokenisation always cuts, and the ids of the most chunks are kept. New
    chunks are encoded together; where the file's ids are its merge ranks, by tiktoken on the same vocabulary, which gives the same ids in
    a third of the time. Texts in which white space runs across a cut, or that hold a special token's mark, go to tokenizers whole.
    """

    def __init__(self, path: str | None = None, cache: int = CACHE):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.run = re.compile(r"\s (?:\s|\Z)")
        self.known: dict[str, bytes] = {}
        self.cache = cache
        with open(path, encoding="utf-8") as f:
            self.fast = self._by_rank(json.load(f), public_tokenizers.PATTERN)
        self.known[""] = self._encode([" "])[0]

    def _by_rank(self, model: dict, pattern: str):
        """The vocabulary as ranks, if ids are merge ranks."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        join = lambda m: "".join(m) if isinstance(m, list) else m.replace(" ", "")
        if any(vocab.get(join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        special = {x["content"] for x in model.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose bytes begin with a space
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, words: list[str]) -> dict[str, bytes]:
        """Ids of chunks with a space before each."""
        joined, out = [w for w in words if self.fast and not w[0].isspace()], {}
        alone = [w for w in words if not self.fast or w[0].isspace()]
        out.update(zip(alone, self._encode([" " + w for w in alone]), strict=True) if alone else ())
        for i in range(0, len(joined), 4096):
            part = joined[i : i + 4096]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            out.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return out

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without the end id."""
        out: list = [b""] * len(texts)
        whole, cut = [], []
        for i, t in enumerate(texts):
            if t and ("<|" in t or self.run.search(t)):
                whole.append(i)
            elif t:
                first, *rest = t.split(" ")
                cut.append((i, first, rest))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True) if whole else ():
            out[i] = ids
        known = self.known
        missing = {w for _, _, rest in cut for w in rest if w not in known}
        new = self._chunks(list(missing)) if missing else {}
        if len(known) < self.cache:  # the first that come are the frequent ones
            known.update(new)
            new = {}
        get = known.__getitem__ if not new else lambda w: known.get(w) or new[w]
        for (i, _, rest), head in zip(cut, self._encode([f for _, f, _ in cut]) if cut else (), strict=True):
            out[i] = head + b"".join(map(get, rest))
        return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut to the capacity; the first
    piece is the shorter one. A null or empty text has the end id only. A null doc_id stays null; repeated rows are cut each; other
    columns are left out; an empty table gives an empty table."""

    def run(batches):
        import pyarrow as pa

        ids_of, end = Ids(tokenizer), np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            cols: list[list] = [[], [], [], [], []]
            i = 0
            while i < len(texts):  # runs of rows of a bounded size
                part, n = [], 0
                while i + len(part) < len(texts) and (not part or n < 2_000_000):
                    part.append(texts[i + len(part)].as_py())
                    n += len(part[-1] or "")
                for d, ids in zip(doc_ids[i : i + len(part)], ids_of.batch(part), strict=True):
                    ids += end
                    total, at, k = len(ids) // 4, 0, 0
                    step = total % capacity or capacity
                    while at < total:
                        for col, v in zip(cols, (d, k, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])), strict=True):
                            col.append(v)
                        at, k, step = at + step, k + 1, capacity
                i += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECE.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, costs: np.ndarray, capacity: tuple[float, float, float], rule: str = "dot", weights=(1.0, 0.25, 0.25)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first.

    An item needs its tokens, one document and its attention cost; a bin has a residual of each. Among the
    open bins that hold the item under every constraint, rule "dot" takes the one of largest weighted dot product of
    the item with what the bin has used, and "norm" the one of least weighted norm of what would be left; ties
    go to the fuller bin. Open bins are kept by residual tokens, in order of residual cost and then documents; of each class the first that
    holds the item, which no other of the class beats in tokens and cost, is the candidate.
    """
    tokens, docs, cost = capacity
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    cap = int(tokens)
    classes: list[list] = [[] for _ in range(cap + 1)]  # sorted (residual cost, residual documents, bin)
    low_cost, low_docs, top_cost = np.full(cap + 1, np.inf), np.full(cap + 1, np.inf), np.full(cap + 1, -1.0)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    w = np.array(weights, float)
    residual = np.arange(cap + 1, dtype=float)
    n_bins = 0

    def note(r):
        own = classes[r]
        low_cost[r], low_docs[r], top_cost[r] = (own[0][0], own[0][1], own[-1][0]) if own else (np.inf, np.inf, -1.0)

    for i in order.tolist():
        size, c = int(lengths[i]), float(costs[i])
        if size > cap or c > cost or docs < 1:
            raise ValueError("an item is larger than a bin")
        fit = top_cost[size:] >= c
        if size < cap and fit.any():
            rc, rd = low_cost[size:], low_docs[size:]
            if (tight := np.flatnonzero(fit & (rc < c))).size:  # classes whose first bin lacks the cost
                rc, rd = rc.copy(), rd.copy()
                for k in tight.tolist():
                    own = classes[size + k]
                    rc[k], rd[k], _ = own[bisect.bisect_left(own, (c,))]
            with np.errstate(invalid="ignore"):
                if rule == "dot":
                    used = w[0] * (size / tokens) * (1 - residual[size:] / tokens) + w[1] * (1 / docs) * (1 - rd / docs) + w[2] * (c / cost) * (1 - rc / cost)
                    r = size + int(np.argmax(np.where(fit, used, -np.inf)))
                else:
                    left = w[0] * ((residual[size:] - size) / tokens) ** 2 + w[1] * ((rd - 1) / docs) ** 2 + w[2] * ((rc - c) / cost) ** 2
                    r = size + int(np.argmin(np.where(fit, left, np.inf)))
            rc, rd, b = classes[r].pop(bisect.bisect_left(classes[r], (c,)))
            note(r)
        else:
            r, rc, rd, b = cap, float(cost), float(docs), n_bins
            n_bins += 1
        bins[i], offsets[i] = b, cap - r
        r, rc, rd = r - size, rc - c, rd - 1
        if r and rd >= 1:
            bisect.insort(classes[r], (rc, rd, b))
            note(r)
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, rule: str = "dot") -> DataFrame:
    """Adds sequence_id and offset to pieces, which are stashed first.

    They are dealt out evenly, whatever their documents, to partitions of PIECES at most, as many as there have to be; each packs its
    own, and its sequence_ids hold its number, so they are unique. Rows are sorted first: a lost task packs alike again. No
    row is tokenised again for that. max_docs None: capacity, as each piece has a token; max_cost None: capacity squared, what a full piece
    needs alone. Either then decides nothing beside the tokens, which is what fewest sequences ask for; lower ones do.
    """
    limits = (float(capacity), float(max_docs or capacity), float(max_cost or capacity**2))
    items = stash(items)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths, lengths.astype(float) ** 2, limits, rule)
        table = table.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 32)))
        yield from table.append_column("offset", pa.array(offsets)).to_batches()

    return items.repartition(items.count() // PIECES + 1).mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, max_docs: int | None = None, max_cost: float | None = None, rule: str = "dot") -> DataFrame:
    """Packs all documents, whole; see pieces() and pack(). Null doc_id stays null; repeated rows are packed each;
    an empty table gives an empty table; other columns are left out."""
    return pack(pieces(docs, capacity, tokenizer=tokenizer), capacity, max_docs, max_cost, rule)
