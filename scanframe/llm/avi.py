"""Media columns: AVI motion-JPEG written, parsed, decoded and cut into timed clips.

``to_avi`` stores bytes without loss: a frame is a strip of 8 x 8 blocks, a byte is one quantised DCT coefficient
(value 256 + byte, quantiser 1), every block is a restart interval of its own. ``frames_of`` reads RIFF chunks and
the frame index; ``Scan`` decodes baseline JPEG scans of any Huffman tables, all restart intervals side by side.
``clips`` compares histograms of neighbouring frames and starts a clip where the difference stands out from the
recent ones.

Defined results: a null text is empty (one block of zeros); equal bytes give equal files; media that is null or no
motion-JPEG file yields no clip; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 64
FRAME_BLOCKS = 64
FRAME_MS = 40
BINS = 16
#: A clip starts where the difference (per mille of the samples) exceeds CUT_BASE + CUT_TIMES x the mean of the last WINDOW.
CUT_BASE, CUT_TIMES, WINDOW = 200, 2, 8
#: Blocks decoded side by side, and bytes of media to an output batch.
SIDE_BY_SIDE, OUT_BYTES = 1 << 14, 1 << 23
CLIPS = "clip int, first_frame int, last_frame int, start_ms long, end_ms long, cut_difference int"


# ---- writing -------------------------------------------------------------------------------------------------------

def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def _jpeg_head(blocks: int) -> bytes:
    """Grey strip of width 8; in both tables the one symbol, category 9, has a code of seven zeros."""
    table = bytes(6) + b"\x01" + bytes(9) + b"\x09"
    return (b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * blocks, 8, 1) + b"\x01\x11\x00")
            + _segment(0xC4, b"\x00" + table) + _segment(0xC4, b"\x10" + table) + _segment(0xDD, b"\x00\x01")
            + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"))


def _jpeg(blocks: np.ndarray) -> bytes:
    """Seven code bits, then nine bits 1bbbbbbbb: two bytes to a coefficient, so an interval has a fixed length."""
    n = len(blocks)
    out = np.empty((n, 2 * BLOCK + 2), np.uint8)
    out[:, 0:2 * BLOCK:2] = 1
    out[:, 1:2 * BLOCK:2] = blocks
    out[:, -2] = 0xFF
    out[:, -1] = 0xD0 + np.arange(n) % 8
    out[-1, -1] = 0xD9
    flat = out.ravel()
    if (blocks == 0xFF).any():
        data = np.zeros((n, 2 * BLOCK + 2), bool)
        data[:, 1:2 * BLOCK:2] = blocks == 0xFF
        flat = np.insert(flat, np.flatnonzero(data.ravel()) + 1, 0)
    return _jpeg_head(n) + flat.tobytes()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def payload_of(data: bytes) -> bytes:
    """The bytes, zeros appended up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def write_avi(data: bytes) -> bytes:
    blocks = np.frombuffer(payload_of(data), np.uint8).reshape(-1, BLOCK)
    n_frames = -(-len(blocks) // FRAME_BLOCKS)
    per = -(-len(blocks) // n_frames)
    n_frames = -(-len(blocks) // per)
    if len(blocks) % per:
        blocks = np.concatenate([blocks, np.zeros((per - len(blocks) % per, BLOCK), np.uint8)])
    movi, index, at = [], [], 4
    for i in range(0, len(blocks), per):
        jpeg = _jpeg(blocks[i:i + per])
        movi.append(_chunk(b"00dc", jpeg))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        at += len(movi[-1])
    largest = max(map(len, movi))
    avih = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, n_frames, 0, 1, largest, 8, 8 * per, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, n_frames, largest, 0, 0, 0, 0, 8, 8 * per)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8, 8 * per, 1, 24, b"MJPG", 8 * 8 * per * 3, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(data)))
    body = (b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl))
            + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))
    return _chunk(b"RIFF", body)


# ---- reading -------------------------------------------------------------------------------------------------------

def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4:at + 8], "little")
        yield data[at:at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def frames_of(data: bytes) -> tuple[list[tuple[int, int]], int, int | None]:
    """(place and size of every frame in the file, microseconds per frame, stored payload length) by its RIFF index."""
    frames: list[tuple[int, int]] = []
    movi, micros, stored = None, FRAME_MS * 1000, None
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    todo = [(12, len(data))]
    while todo:
        at, end = todo.pop()
        for name, start, size in _chunks(data, at, end):
            if name == b"LIST" and data[start:start + 4] == b"movi":
                movi = start, size
            elif name == b"LIST":
                todo.append((start + 4, start + size))
            elif name == b"avih":
                micros = int.from_bytes(data[start:start + 4], "little")
            elif name == b"strd" and size == 8:
                stored = int.from_bytes(data[start:start + 8], "little")
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, start).reshape(-1, 4)
                frames = [(int(o), int(n)) for _, _, o, n in index[index[:, 0] >> 16 == int.from_bytes(b"dc", "little")]]
    if movi is None:
        raise ValueError("no movi list")
    if frames:
        base = movi[0] if data[movi[0] + frames[0][0]:][:4] == b"00dc" else 0  # offsets are from the list or the file
        return [(base + o + 8, n) for o, n in frames], micros, stored
    return [(s, n) for name, s, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if name == b"00dc"], micros, stored


class _Head:
    """Tables and geometry of a JPEG up to its scan."""

    def __init__(self, head: bytes):
        huff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.restart, at = 0, 2
        while at < len(head):
            marker, size = head[at + 1], int.from_bytes(head[at + 2:at + 4], "big")
            body = head[at + 4:at + 2 + size]
            if marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    huff[body[0]] = _lookup(counts, body[17:17 + n])
                    body = body[17 + n:]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack(">HH", body[1:5])
                parts = {body[6 + 3 * i]: body[7 + 3 * i] for i in range(body[5])}
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            at += 2 + size
        most = max(v >> 4 for v in parts.values()), max(v & 15 for v in parts.values())
        self.blocks = []  # of an MCU: component, DC table, AC table
        for i, (part, tables) in enumerate(order):
            count = (parts[part] >> 4) * (parts[part] & 15) if len(order) > 1 else 1
            self.blocks += [(i, huff[tables >> 4], huff[0x10 | tables & 15])] * count
        if len(order) == 1:
            most = 1, 1
        self.mcus = -(-self.width // (8 * most[0])) * -(-self.height // (8 * most[1]))
        self.restart = self.restart or self.mcus
        self.key = (self.restart, self.mcus)


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For any 16 bits: length and symbol of the code that they begin with."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            span = slice(code << (16 - bits), (code + 1) << (16 - bits))
            length[span], symbol[span] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


@lru_cache(maxsize=512)
def _head(head: bytes) -> _Head:
    return _Head(head)


def _split(jpeg: bytes) -> tuple[bytes, int]:
    """The part before the scan's data, and where the data begins."""
    at = 2
    while True:
        size = int.from_bytes(jpeg[at + 2:at + 4], "big")
        if jpeg[at] != 0xFF or size < 2 or at > len(jpeg):
            raise ValueError("broken JPEG")
        at += 2 + size
        if jpeg[at - size - 1] == 0xDA:
            return jpeg[:at], at


class Scan:
    """Decodes the scans of many frames that share their head."""

    def __init__(self, head: _Head):
        self.head = head

    def coefficients(self, scans: list[bytes]) -> np.ndarray:
        """Levels in scan order, (frames, blocks of a frame, 64)."""
        data = np.frombuffer(b"".join(scans) + bytes(8), np.uint8)
        ends = np.cumsum([len(s) for s in scans])
        mark = np.flatnonzero(data[:-1] == 0xFF)
        after = data[mark + 1]
        stuffed = mark[after == 0] + 1
        cuts = mark[(after & 0xF8) == 0xD0]
        starts = np.sort(np.concatenate([ends - np.array([len(s) for s in scans]), cuts + 2]))
        per = -(-self.head.mcus // self.head.restart)
        if len(starts) != per * len(scans):
            raise ValueError("restart intervals are missing")
        if len(stuffed):
            starts -= np.searchsorted(stuffed, starts)
            data = np.delete(data, stuffed)
        here = np.minimum(self.head.restart, self.head.mcus - np.tile(np.arange(per), len(scans)) * self.head.restart)
        out = np.zeros((len(starts), self.head.restart * len(self.head.blocks), BLOCK), np.int16)
        for i in range(0, len(starts), SIDE_BY_SIDE):
            self._side_by_side(data, 8 * starts[i:i + SIDE_BY_SIDE], here[i:i + SIDE_BY_SIDE], out[i:i + SIDE_BY_SIDE])
        return out.reshape(len(scans), -1, BLOCK)[:, :self.head.mcus * len(self.head.blocks)]

    def _side_by_side(self, data: np.ndarray, at: np.ndarray, mcus: np.ndarray, out: np.ndarray) -> None:
        wide = data.astype(np.int32)
        three = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]  # 24 bits from every byte

        def peek(p: np.ndarray) -> np.ndarray:
            return (three[p >> 3] >> (8 - (p & 7))) & 0xFFFF

        def number(p: np.ndarray, size: np.ndarray) -> np.ndarray:
            bits = peek(p) >> (16 - size)
            return np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits)

        parts = 1 + max(b[0] for b in self.head.blocks)
        before = np.zeros((parts, len(at)), np.int64)
        for m in range(int(mcus.max())):
            live = np.flatnonzero(mcus > m)
            for b, (part, (dc_len, dc_sym), (ac_len, ac_sym)) in enumerate(self.head.blocks):
                place = m * len(self.head.blocks) + b
                p = at[live]
                code = peek(p)
                size = dc_sym[code]
                p = p + dc_len[code]
                before[part, live] += number(p, size)
                out[live, place, 0] = before[part, live]
                at[live] = p + size
                rows, k = live, np.ones(len(live), np.int64)
                while len(rows):
                    p = at[rows]
                    code = peek(p)
                    symbol = ac_sym[code]
                    size, k = symbol & 15, k + (symbol >> 4)
                    p = p + ac_len[code]
                    some = size > 0
                    if some.all() and (k < BLOCK).all():
                        out[rows, place, k] = number(p, size)
                    else:
                        good = some & (k < BLOCK)
                        out[rows[good], place, k[good]] = number(p[good], size[good])
                    at[rows] = p + size
                    k = k + 1
                    on = (k < BLOCK) & (symbol != 0)
                    if not on.all():
                        rows, k = rows[on], k[on]


def decode(files: list[bytes]) -> list[tuple[list[np.ndarray], int, int | None]]:
    """For each file: the frames' levels, microseconds per frame, stored length. Frames with equal heads go together."""
    found, groups = [], {}
    for i, data in enumerate(files):
        places, micros, stored = frames_of(data)
        found.append(([None] * len(places), micros, stored))
        for j, (at, size) in enumerate(places):
            jpeg = data[at:at + size]
            head, start = _split(jpeg)
            end = size - 2 if jpeg[-2:] == b"\xff\xd9" else size
            groups.setdefault(head, []).append((i, j, jpeg[start:end]))
    for head, members in groups.items():
        scan = Scan(_head(head))
        step = max(1, SIDE_BY_SIDE // max(1, scan.head.mcus))
        for a in range(0, len(members), step):
            part = members[a:a + step]
            for (i, j, _), levels in zip(part, scan.coefficients([m[2] for m in part]), strict=True):
                found[i][0][j] = levels
    return found


def stored_bytes(frames: list[np.ndarray], stored: int) -> bytes:
    """The payload of a file that ``write_avi`` wrote."""
    return b"".join([(f - 256).astype(np.uint8).tobytes() for f in frames])[:max(BLOCK, -(-stored // BLOCK) * BLOCK)]


def shots(frames: list[np.ndarray], micros: int) -> list[tuple[int, int, int, int, int, int]]:
    """Clips (number, first and last frame, start and end in ms, difference at its start)."""
    if not frames:
        return []
    hist = np.stack([np.bincount((f.ravel() & 0xFF) // (256 // BINS), minlength=BINS) * 1000 // max(1, f.size) for f in frames])
    step = np.abs(np.diff(hist, axis=0)).sum(1).tolist()
    starts, differences = [0], [0]
    for i, d in enumerate(step):
        recent = step[max(0, i - WINDOW):i]
        if d * max(1, len(recent)) > CUT_BASE * max(1, len(recent)) + CUT_TIMES * sum(recent):
            starts.append(i + 1)
            differences.append(d)
    ends = [s - 1 for s in starts[1:]] + [len(frames) - 1]
    return [(n, s, e, s * micros // 1000, (e + 1) * micros // 1000, d) for n, (s, e, d) in enumerate(zip(starts, ends, differences, strict=True))]


# ---- columns -------------------------------------------------------------------------------------------------------

def _with(fields: list[T.StructField], drop: set[str], more: str) -> T.StructType:
    new = T._parse_datatype_string(more).fields
    return T.StructType([f for f in fields if f.name not in drop | {x.name for x in new}] + new)


def to_avi(docs: DataFrame) -> DataFrame:
    """Replaces ``text`` by ``media`` (binary, an AVI file of its UTF-8 bytes)."""
    schema = _with(docs.schema.fields, {"text"}, "media binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            first, held, out = 0, 0, []
            for i, text in enumerate(texts):
                out.append(write_avi(text.as_py() or b""))
                held += len(out[-1])
                if held > OUT_BYTES or i == len(texts) - 1:
                    rest = batch.slice(first, len(out))
                    yield pa.RecordBatch.from_arrays([*[rest.column(f.name) for f in schema.fields[:-1]], pa.array(out, pa.binary())], names=schema.names)
                    first, held, out = i + 1, 0, []

    return docs.drop("media").mapInArrow(run, schema)


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list]]:
    """Parts of bounded size, as rows, files and what they hold."""
    media = batch.column("media")
    first, held, files = 0, 0, []
    for i, m in enumerate(media):
        files.append(m.as_py())
        held += len(files[-1] or b"")
        if held > OUT_BYTES or i == len(media) - 1:
            good = [f for f in files if f is not None and f[:4] == b"RIFF"]
            got = iter(decode(good))
            yield batch.slice(first, len(files)), files, [next(got) if f is not None and f[:4] == b"RIFF" else None for f in files]
            first, held, files = i + 1, 0, []


def clips(media: DataFrame) -> DataFrame:
    """One row per clip, with the other columns of its file."""
    schema = _with(media.schema.fields, {"media"}, CLIPS)
    kept = [f.name for f in schema.fields[:-6]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, found in _decoded(batch):
                cut = [[] if x is None else shots(x[0], x[1]) for x in found]
                which = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
                values = list(zip(*[r for c in cut for r in c], strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(n).take(which) for n in kept], *[pa.array(v, t) for v, t in zip(values, [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32()], strict=True)]], names=schema.names)

    return media.mapInArrow(run, schema)


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Per file that ``to_avi`` wrote: what is read back from it, and its clips as ``frames;start-end,...`` in ms."""
    schema = _with(media.schema.fields, {"media"}, DIGEST)
    kept = [f.name for f in schema.fields[:-7]]

    def row(data: bytes, frames: list[np.ndarray], micros: int, stored: int) -> tuple:
        payload = stored_bytes(frames, stored)
        cut = ",".join(f"{s}-{e}" for _, _, _, s, e, _ in shots(frames, micros))
        return (stored, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(frames)};{cut}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, files, found in _decoded(batch):
                values = list(zip(*[row(f, *x) if x else (None,) * 7 for f, x in zip(files, found, strict=True)], strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in kept], *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], names=schema.names)

    return media.mapInArrow(run, schema)
