"""Media columns: AVI motion-JPEG written and read with numpy, and shots found in its frames.

Payload bytes are the quantised DCT coefficients of baseline grey JPEG frames, the unit in which that
format is lossless. Size category 8 of the JPEG code has exactly 256 values, +-128 to +-255, whose 8 extra
bits number them from 0 to 255: a payload byte is the coefficient with those bits. The Huffman tables of
the frames give that category the code 00000000, so each coefficient takes two whole bytes, and a restart
marker after each block makes DC differences absolute. Any baseline decoder reads such frames; the decoder
here reads them with numpy and any other grey baseline frame bit by bit.

A file has one frame for each ``FRAME_BLOCKS`` blocks of 64 payload bytes (the last one is filled with
category-0 blocks), the payload's length in a LIST INFO chunk, and an idx1 index, by which frames are found.

Shots: each decoded frame's histogram is compared with the frame's before; a cut is where the difference is
over a floor and over the mean plus ``K`` deviations of the differences around it.

Cases: null and empty payloads become 64 zero bytes; payloads of any length and content are stored whole;
equal payloads give equal files, so repeated rows give equal rows; null doc_ids pass through; malformed files raise
ValueError; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from rangeframe.llm.common import map_text

#: Blocks across and down a frame, and frames a second.
ACROSS, DOWN, FPS = 4, 4, 10
FRAME_BLOCKS = ACROSS * DOWN
BINS, WINDOW, K, FLOOR = 32, 8, 1.5, 0.08


def zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in the order of their diagonals."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def dct_basis() -> np.ndarray:
    """Samples (row-major) from zigzag coefficients: the 8x8 inverse DCT as one matrix."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(one, one)[zigzag()].astype(np.float32)


_BASIS = dct_basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head() -> bytes:
    """Everything of a frame before its scan: quantisers of 1, and 8-bit codes for categories 8 and 0."""
    codes = lambda kind: bytes([kind]) + bytes([0] * 7 + [2] + [0] * 8) + b"\x08\x00"
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + b"\x01\x11\x00"),
            _segment(0xC4, codes(0x00) + codes(0x10)),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


#: A block whose difference and other coefficients are all 0: category 0 for DC, end of block for AC.
_EMPTY_BLOCK = b"\x01\x01"


def encode_frame(payload: np.ndarray) -> bytes:
    """One frame of (blocks, 64) payload bytes, at most FRAME_BLOCKS blocks."""
    head = frame_head()
    n = len(payload)
    body = np.zeros((n, 130), np.uint8)
    body[:, 1:128:2] = payload
    body[:, 128] = 0xFF
    body[:, 129] = 0xD0 + np.arange(n) % 8
    if (payload == 0xFF).any():
        scan = b"".join(row[:128].tobytes().replace(b"\xff", b"\xff\x00") + row[128:].tobytes() for row in body)
    else:
        scan = body.tobytes()
    rest = b"".join(_EMPTY_BLOCK + bytes([0xFF, 0xD0 + k % 8]) for k in range(n, FRAME_BLOCKS))
    return head + (scan + rest)[:-2] + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """A motion-JPEG file of a payload whose length is a multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    frames = [encode_frame(blocks[k : k + FRAME_BLOCKS]) for k in range(0, len(blocks), FRAME_BLOCKS)]
    chunks, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(_chunk(b"00dc", f))
        at += len(chunks[-1])
    width, height, largest = 8 * ACROSS, 8 * DOWN, max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISBJ", str(len(payload)).encode()))
    movi = _chunk(b"LIST", b"movi" + b"".join(chunks))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + movi + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    fps: float
    payload_size: int | None
    frames: list[memoryview]


def parse_avi(data: bytes) -> Avi:
    """The frames of a file, found by its idx1 index (offsets from ``movi`` or from the file's start)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, size, movi, index = 0.0, None, None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", data, at)
            body = at + 8
            if body + n > len(data):
                raise ValueError("a chunk ends after its file")
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = body
                else:
                    todo.append((body + 4, body + n))
            elif name == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", data, body)[0])
            elif name == b"ISBJ":
                size = int(data[body : body + n].rstrip(b"\x00") or b"0")
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", n // 16 * 4, body).reshape(-1, 4)
            at = body + n + n % 2
    if movi is None or index is None:
        raise ValueError("the file has no frames or no index")
    view = memoryview(data)
    base = movi if len(index) == 0 or data[movi + int(index[0, 2]) : movi + int(index[0, 2]) + 4] == struct.pack("<I", index[0, 0]) else 0
    frames = [view[base + o + 8 : base + o + 8 + n] for tag, _, o, n in index.tolist() if struct.pack("<I", tag)[2:] in (b"dc", b"db")]
    return Avi(fps, size, frames)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, k, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


@dataclass
class Head:
    width: int
    height: int
    quant: np.ndarray
    dc: dict[tuple[int, int], int]
    ac: dict[tuple[int, int], int]
    restart: int
    scan: int

    @property
    def aligned(self) -> bool:
        """Whether blocks can be the two-byte coefficients that encode_frame writes."""
        return self.restart == 1 and self.dc.get((8, 0)) == 8 and self.ac.get((8, 0)) == 8


def parse_head(frame: bytes) -> Head:
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, dict] = {}
    width = height = restart = 0
    use = 0
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames are decoded")
            use = body[8]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = body[2]
            return Head(width, height, quant[use], huff[tables >> 4], huff[0x10 | tables & 15], restart, at)
    raise ValueError("the frame has no scan")


def _slow_scan(scan: bytes, head: Head, blocks: int) -> np.ndarray:
    """Coefficients of any grey baseline scan, bit by bit."""
    out = np.zeros((blocks, 64), np.int32)
    per, at = head.restart or blocks, 0
    for part in _intervals(scan):
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).tolist()
        pos, last = 0, 0

        def symbol(table):
            nonlocal pos
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no such code")

        def value(size):
            nonlocal pos
            v = int("".join(map(str, bits[pos : pos + size])) or "0", 2)
            pos += size
            return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(per, blocks - at)):
            last += value(symbol(head.dc))
            out[at, 0] = last
            k = 1
            while k < 64:
                s = symbol(head.ac)
                if s == 0:
                    break
                k += s >> 4
                if s != 0xF0:
                    out[at, k] = value(s & 15)
                k += 1
            at += 1
    return out


def _intervals(scan: bytes) -> list[bytes]:
    """What stands between restart markers, without stuffed bytes."""
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if scan[at + 1 : at + 2] != b"\x00":
            out.append(scan[start:at])
            start = at + 2
        at += 2
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, scan[start:]]]


def decode_frame(frame: bytes, head: Head) -> tuple[np.ndarray, int]:
    """Quantised coefficients (blocks, 64) in zigzag order, and how many blocks come before empty ones."""
    blocks = -(-head.width // 8) * -(-head.height // 8)
    scan = bytes(frame[head.scan :])
    if scan[-2:] == b"\xff\xd9":
        scan = scan[:-2]
    if head.aligned:
        rows = None
        if len(scan) == blocks * 130 - 2:
            rows = np.frombuffer(scan + b"\xff\xd0", np.uint8).reshape(blocks, 130)
            rows = rows[:, :128] if (rows[:, 128] == 0xFF).all() and (rows[:, 129] & 0xF8 == 0xD0).all() else None
        if rows is None:
            parts = _intervals(scan)
            full = [x for x in parts if x != _EMPTY_BLOCK]
            if parts == full + [_EMPTY_BLOCK] * (blocks - len(full)) and all(len(x) == 128 for x in full):
                rows = np.frombuffer(b"".join(full), np.uint8).reshape(-1, 128)
        if rows is not None and not rows[:, ::2].any():
            b = rows[:, 1::2].astype(np.int32)
            coefficients = np.zeros((blocks, 64), np.int32)
            coefficients[: len(b)] = np.where(b < 128, b - 255, b)
            return coefficients, len(b)
    return _slow_scan(scan, head, blocks), blocks


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that number coefficients of category 8."""
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks, 64) by the inverse DCT."""
    return np.clip(np.rint(coefficients.astype(np.float32) * quant @ _BASIS) + 128, 0, 255).astype(np.uint8)


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS grey levels for each frame (frames, samples)."""
    bins = frames.astype(np.int64) * BINS // 256 + np.arange(len(frames))[:, None] * BINS
    return np.bincount(bins.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS) / max(1, frames.shape[1])


def cuts(shares: np.ndarray) -> np.ndarray:
    """Frames at which a new shot begins (0 among them, if there are frames)."""
    if len(shares) < 2:
        return np.arange(len(shares))
    d = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    total, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    k = np.arange(len(d))
    lo, hi = np.maximum(0, k - WINDOW), np.minimum(len(d), k + WINDOW + 1)
    n = hi - lo
    mean = (total[hi] - total[lo]) / n
    deviation = np.sqrt(np.maximum(0, (squares[hi] - squares[lo]) / n - mean * mean))
    return np.concatenate([[0], np.flatnonzero((d > FLOOR) & (d > mean + K * deviation)) + 1])


@dataclass
class Read:
    payload: bytes
    fps: float
    n_frames: int
    starts: np.ndarray

    def clips(self) -> list[tuple[int, float, float]]:
        """(first frame, begin, end in seconds) of each shot."""
        ends = [*self.starts[1:].tolist(), self.n_frames]
        return [(a, a / self.fps, b / self.fps) for a, b in zip(self.starts.tolist(), ends)]


def read_avi(data: bytes) -> Read:
    """Decode all frames of a file: the payload and the shots."""
    avi = parse_avi(data)
    parts, full = [], []
    head, begins = None, b"-"
    for f in avi.frames:
        if bytes(f[: len(begins)]) != begins:
            head = parse_head(bytes(f))
            begins = bytes(f[: head.scan])
        c, n = decode_frame(f, head)
        parts.append((c, head.quant))
        full.append(n)
    if not parts:
        return Read(b"", avi.fps, 0, np.arange(0))
    payload = payload_of(np.concatenate([c[:n] for (c, _), n in zip(parts, full)]))
    if avi.payload_size is not None:
        payload = payload[: avi.payload_size]
    shares = []
    for k in range(0, len(parts), 512):
        shown = [samples(c, q).ravel() for c, q in parts[k : k + 512]]
        if len({len(x) for x in shown}) == 1:
            shares.append(histograms(np.array(shown)))
        else:
            shares.extend(histograms(x[None, :]) for x in shown)
    return Read(payload, avi.fps, len(parts), cuts(np.concatenate(shares)))


def pad(text: bytes) -> bytes:
    """The payload of a text: zero bytes up to a positive multiple of 64."""
    return text + b"\x00" * (-len(text) % 64 if text else 64)


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The media column of each text, as AVI bytes: doc_id, n_bytes, avi."""

    def make():
        def work(texts: list[bytes]) -> dict:
            return {"n_bytes": list(map(len, texts)), "avi": [encode_avi(pad(t)) for t in texts]}

        return work

    return map_text(docs, [doc_id], text, "n_bytes long, avi binary", make)


def clips(files: DataFrame, file_id: str, avi: str = "avi") -> DataFrame:
    """Timed clip rows of an AVI column: file_id, clip, first_frame, begin_s, end_s. Null files have none."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    source = files.where(F.col(avi).isNotNull()).select(F.col(file_id).alias("file_id"), F.col(avi).alias("avi"))
    schema = f"file_id {source.schema[0].dataType.simpleString()}, clip int, first_frame int, begin_s double, end_s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, x in enumerate(batch.column(1)):
                found = read_avi(x.as_py()).clips()
                ids += [k] * len(found)
                rows += [(j, *c) for j, c in enumerate(found)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["file_id", "clip", "first_frame", "begin_s", "end_s"],
            )

    return source.mapInArrow(run, schema)


def media_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as AVI, read it back, and return digests and a feature of its shots."""

    def make():
        def work(texts: list[bytes]) -> dict:
            rows = []
            for t in texts:
                stored = encode_avi(pad(t))
                read = read_avi(stored)
                starts = ",".join(f"{b:.1f}" for _, b, _ in read.clips())
                feature = f"frames={read.n_frames};shots={len(read.starts)};begins={starts}"
                rows.append((len(t), len(read.payload), hashlib.sha256(read.payload).hexdigest(), zlib.crc32(read.payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return dict(zip(names, map(list, zip(*rows))))

        return work

    return map_text(docs, [doc_id], text, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
