"""AVI motion-JPEG columns: RIFF files of intra frames, written, indexed, decoded and cut into shots.

Payload bytes are the 8-bit samples of grey 24 x 24 frames in JPEG's lossless process (ITU-T T.81, process 14, predictor
1). The writer's Huffman table gives category c a code of 9 - c bits, so every difference takes 9 bits in all and a
frame's scan, before byte stuffing, 648 bytes; that lets numpy read and write many frames at once. The reader takes any RIFF/AVI
file with an idx1 index (or walks the chunks without one), its further segments too, any single-component lossless frame of 8 bits with
predictor 1, and the brightness of baseline frames, as cameras write them; such frames are decoded code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 24
FRAME = SIDE * SIDE
SCAN = FRAME * 9 // 8
FPS = 25
BINS = 16
#: A shot ends where the histogram difference is over the mean plus SIGMAS deviations of the WINDOW differences before
#: it and over FLOOR of a frame's samples.
WINDOW, SIGMAS, FLOOR = 12, 3.0, 0.25


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """9 bits of each difference -255 .. 255 (at difference + 255), and the difference of each 9 bits."""
    d = np.arange(-255, 256)
    c = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(int) + 1)
    prefix = ((1 << (8 - c)) - 1) << 1  # 8 - c ones and a zero
    bits = np.where(d < 0, d + (1 << c) - 1, d)
    value = (prefix << c) | bits
    back = np.zeros(512, np.int16)
    back[value] = d
    return value.astype(np.uint16), back


def frame_head(side: int = SIDE) -> bytes:
    """SOI, the Huffman table, the lossless frame header and the scan header."""
    counts = [1] * 9 + [0] * 7  # one code of each length 1 .. 9: categories 8, 7, ... 0
    dht = bytes([0, *counts, *range(8, -1, -1)])
    sof = struct.pack(">BHHB3B", 8, side, side, 1, 1, 0x11, 0)
    sos = bytes([1, 1, 0, 1, 0, 0])
    mark = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + mark(0xC4, dht) + mark(0xC3, sof) + mark(0xDA, sos)


def scans(samples: np.ndarray) -> np.ndarray:
    """(n, 648) scan bytes, not stuffed, of (n, 24, 24) frames."""
    value, _ = _tables()
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    v = value[d.reshape(-1, 8) + 255]
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = ((v[:, j - 1] & ((1 << j) - 1)) << (8 - j)) | (v[:, j] >> (j + 1))
    out[:, 8] = v[:, 7] & 255
    return out.reshape(-1, SCAN)


def unscan(raw: np.ndarray) -> np.ndarray:
    """The (n, 576) samples of (n, 648) scan bytes."""
    _, back = _tables()
    b = raw.reshape(-1, 9).astype(np.uint16)
    v = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        v[:, i] = ((b[:, i] & ((1 << (8 - i)) - 1)) << (i + 1)) | (b[:, i + 1] >> (7 - i))
    d = back[v].reshape(-1, SIDE, SIDE)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16) + 128
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def write_avi(frames: list[bytes], side: int = SIDE, fps: int = FPS) -> bytes:
    """A RIFF AVI file: headers, a movi list of 00dc chunks, and an idx1 index."""
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    body = b"AVI " + chunk(b"LIST", hdrl) + b"LIST" + struct.pack("<I", at) + b"movi" + b"".join(parts) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: bytes, at: int, end: int):
    """(kind, list type, where the body is, where it ends) of the chunks from at to end."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, data[at + 8 : at + 12] if kind == b"LIST" else b"", at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def _walk(data: bytes, at: int, end: int) -> list[bytes]:
    """The frames of a movi list, those of its rec lists too, in order."""
    frames = []
    for kind, form, a, b in _chunks(data, at, end):
        if form == b"rec ":
            frames += _walk(data, a + 4, b)
        elif kind in (b"00dc", b"00db"):
            frames.append(data[a:b])
    return frames


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index names, and frames a second; without an index, as in the further segments (AVIX) of a long file, the movi
    list's chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI file")
    frames, fps, at = [], float(FPS), 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        size = struct.unpack_from("<I", data, at + 4)[0]
        movi, index = None, None
        for kind, form, a, b in _chunks(data, at + 12, min(len(data), at + 8 + size)):
            if form == b"movi":
                movi = (a, b)
            elif form == b"hdrl":
                us = struct.unpack_from("<I", data, a + 12)[0]
                fps = 1e6 / us if us else fps
            elif kind == b"idx1":
                index = data[a:b]
        if movi is None:
            raise ValueError("no movi list")
        if index is None:
            frames += _walk(data, movi[0] + 4, movi[1])
        else:
            rows = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
            rows = rows[np.isin(rows["id"], [b"00dc", b"00db"])]
            shift = 0 if len(rows) and rows["at"][0] >= movi[0] + 4 else movi[0]  # some files count from their start
            frames += [data[a : a + s] for a, s in zip((rows["at"].astype(np.int64) + shift + 8).tolist(), rows["size"].tolist(), strict=True)]
        at += 8 + size + (size & 1)
    return frames, fps


# Fixed values of ITU-T T.81, annex K: Huffman tables of frames without their own, as (codes of each length 1 .. 16, symbols). Of the
# AC tables only the symbols of codes under 16 bits are listed; the rest follow in ascending order.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: ("0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    0x11: ("00020102040403040705040400010277", "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _standard() -> dict[int, tuple[bytes, bytes]]:
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for k, (counts, listed) in STANDARD.items():
        first = bytes.fromhex(listed)
        out[k] = (bytes.fromhex(counts), first + bytes(sorted(set(every) - set(first))) if k >> 4 else first)
    return out


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits, 256 times the length plus the symbol of the code that they begin with; 0 if none."""
    out, at, k = np.zeros(1 << 16, np.int64), 0, 0
    for n, many in enumerate(counts, 1):
        for s in symbols[k : k + many]:
            out[at : at + (1 << (16 - n))] = n << 8 | s
            at += 1 << (16 - n)
        k += many
    if at > 1 << 16 or k > len(symbols):
        raise ValueError("no Huffman table")
    return out.tolist()


class Bits:
    """Codes and numbers of an entropy-coded segment."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw + b"\0" * 4, 0, 8 * len(raw)

    def _take(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("a cut frame")

    def code(self, table: list[int]) -> int:
        i = self.at >> 3
        found = table[int.from_bytes(self.raw[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF]
        if not found:
            raise ValueError("no such code")
        self._take(found >> 8)
        return found & 255

    def number(self, n: int) -> int:
        """n bits as the standard's signed number of category n."""
        if n > 15:
            raise ValueError("no such category")
        i = self.at >> 3
        v = int.from_bytes(self.raw[i : i + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self._take(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def _scan(data: bytes, at: int) -> list[bytes]:
    """The one scan from at to the end mark, cut at restart marks, without stuffing."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 == len(data):
            raise ValueError("a cut frame")
        mark = data[at + 1]
        if mark == 0xFF:  # a fill byte
            at += 1
        elif mark == 0:
            at += 2
        else:
            out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at = at + 2
            if not 0xD0 <= mark <= 0xD7:
                break
    if mark != 0xD9 or b"\xff\xd8" in data[at:]:
        raise ValueError("several scans or fields")
    return out


def _slow_frame(data: bytes, known: dict | None = None) -> np.ndarray:
    """The samples of a grey lossless frame with any Huffman table, or the first component, which is the brightness, of a baseline or
    extended one; known keeps lookup tables from frame to frame."""
    known = {} if known is None else known
    at, tables, quants, kind, restart = 2, {}, {}, None, 0
    while True:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if data[at] != 0xFF or len(body) != size - 2:
            raise ValueError("a cut frame")
        at += 2 + size
        if mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC0 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            kind, frame = mark, body
        elif mark == 0xDA:
            break
    if kind not in (0xC0, 0xC1, 0xC3):
        raise ValueError("a progressive or arithmetic frame")
    n = frame[5]
    if frame[0] != 8 or body[0] != n:
        raise ValueError("several scans, or samples of other than 8 bits")

    def table(k: int) -> list[int]:
        pair = (tables or _standard())[k]
        if pair not in known:
            known[pair] = _lookup(*pair)
        return known[pair]

    segments = _scan(data, at)
    if kind == 0xC3:
        if n != 1 or len(segments) != 1 or body[3] != 1:
            raise ValueError("only grey lossless frames with predictor 1, without restarts")
        return _lossless(Bits(segments[0]), struct.unpack_from(">HH", frame, 1), table(body[2] >> 4))
    parts = [(frame[7 + 3 * i] >> 4, frame[7 + 3 * i] & 15, table(body[2 + 2 * i] >> 4), table(0x10 | body[2 + 2 * i] & 15)) for i in range(n)]
    return _baseline(segments, struct.unpack_from(">HH", frame, 1), parts, quants[frame[8]], restart)


def _lossless(bits: Bits, side: tuple[int, int], table: list[int]) -> np.ndarray:
    out = np.zeros(side, np.int64)
    for y in range(side[0]):
        for x in range(side[1]):
            out[y, x] = bits.number(bits.code(table)) + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    return (out & 255).astype(np.uint8)


def _baseline(segments: list[bytes], side: tuple[int, int], parts: list[tuple], quant: np.ndarray, restart: int) -> np.ndarray:
    """The first of the components (h, v, DC table, AC table). All are read, as their codes are interleaved."""
    if len(parts) == 1:
        parts = [(1, 1, *parts[0][2:])]
    if not all(h and v for h, v, *_ in parts):
        raise ValueError("no sampling factors")
    h_most, v_most, (h0, v0, *_) = max(p[0] for p in parts), max(p[1] for p in parts), parts[0]
    across, down = -(-side[1] // (8 * h_most)), -(-side[0] // (8 * v_most))
    every = restart or max(1, across * down)
    if len(segments) != max(1, -(-across * down // every)):
        raise ValueError("a cut frame")
    found = np.zeros((down * v0, across * h0, 64))
    for k in range(across * down):
        if k % every == 0:
            bits, before = Bits(segments[k // every]), [0] * len(parts)
        for i, (h, v, dc, ac) in enumerate(parts):
            for b in range(h * v):
                before[i] += bits.number(bits.code(dc))
                block, j = [0] * 64, 1
                block[0] = before[i]
                while j < 64 and (symbol := bits.code(ac)):
                    j += symbol >> 4
                    if j > 63 or not symbol & 15 and symbol != 0xF0:
                        raise ValueError("no such coefficient")
                    block[ZIGZAG[j]] = bits.number(symbol & 15)
                    j += 1
                if i == 0:
                    found[k // across * v + b // h, k % across * h + b % h] = block
    steps = np.zeros(64)
    steps[ZIGZAG] = quant
    u = np.arange(8)[:, None]
    basis = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * np.arange(8) + 1) * u * np.pi / 16)
    planes = basis.T @ (found * steps).reshape(*found.shape[:2], 8, 8) @ basis
    samples = np.clip(np.floor(planes + 128.5), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * down * v0, 8 * across * h0)
    return samples[: -(-side[0] * v0 // v_most), : -(-side[1] * h0 // h_most)]


def decode(frames: list[bytes]) -> np.ndarray:
    """The samples of equal-sized frames, a row each."""
    if not frames:
        return np.empty((0, FRAME), np.uint8)
    head = frame_head()
    if all(f.startswith(head) for f in frames):
        raw = b"".join([f[len(head) : -2].replace(b"\xff\x00", b"\xff") for f in frames])
        return unscan(np.frombuffer(raw, np.uint8))
    known: dict = {}
    return np.stack([_slow_frame(f, known).ravel() for f in frames])


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of 576."""
    head, end = frame_head(), b"\xff\xd9"
    raw = scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE)).tobytes()
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(write_avi([head + raw[i : i + SCAN].replace(b"\xff", b"\xff\x00") + end for i in range(at, at + n * SCAN, SCAN)]))
        at += n * SCAN
    return out


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """First and end frames of the shots, by differences of neighbours' histograms against those just before."""
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    width = samples.shape[1]
    hist = np.bincount(((samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * width)
    s, q = np.concatenate(([0.0], np.cumsum(d))), np.concatenate(([0.0], np.cumsum(d * d)))
    i = np.arange(len(d))
    lo = np.maximum(0, i - WINDOW)
    k = np.maximum(1, i - lo)
    mean = (s[i] - s[lo]) / k
    dev = np.sqrt(np.maximum(0.0, (q[i] - q[lo]) / k - mean * mean))
    cuts = (np.flatnonzero((d > FLOOR) & (d > mean + SIGMAS * dev)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
CLIP = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("clip", T.IntegerType()), T.StructField("first_frame", T.LongType()), T.StructField("end_frame", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("error", T.StringType())])
DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    + [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def _runs(batch, limit: int = 2_000_000):
    """Rows of a batch in runs of about limit bytes: (doc_ids, texts as bytes)."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    i = 0
    while i < len(ids):
        part, n = [], 0
        while i + len(part) < len(ids) and (not part or n < limit):
            t = texts[i + len(part)].as_buffer()
            part.append(t.to_pybytes() if t is not None else b"")
            n += len(part[-1])
        yield ids[i : i + len(part)], part
        i += len(part)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI file of every text. Null and empty texts are one frame of 255."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, texts in _runs(batch):
                files = encode([payload(t) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=MEDIA.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of every AVI file in (doc_id, media), with error null. A null file has none; a file that can't be read, for a cut or progressive
    frame, say, has one row of nulls that says why, and no other file suffers. A null doc_id stays null; repeated rows are read each; other
    columns are left out; an empty table gives an empty table."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[] for _ in CLIP]
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := m.as_py()) is None:
                    continue
                try:
                    frames, fps = read_avi(data)
                    rows = [(d, k, a, b, a / fps, b / fps, None) for k, (a, b) in enumerate(shots(decode(frames)))]
                except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:  # what broken files lead to
                    rows = [(d, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                for row in rows:
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=CLIP.names)

    return media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(run, CLIP)


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as AVI, reads the file back and gives checksums of both and the clips.

    Null and empty texts are one frame; equal texts have equal values; a null doc_id stays null; an empty
    table gives an empty table. feature: frames, clips, and each clip's first frame. The files are read in the task that
    wrote them; to_media() and clips() keep them as a column instead.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, texts in _runs(batch):
                files = encode([payload(t) for t in texts])
                cols: list[list] = [[] for _ in DIGEST]
                for d, t, data in zip(ids, texts, files, strict=True):
                    frames, _ = read_avi(data)
                    samples = decode(frames)
                    back, cut = samples.tobytes(), shots(samples)
                    row = (d, len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(samples)} frames, {len(cut)} clips: " + " ".join(str(a) for a, _ in cut))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=DIGEST.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)
