"""Hand-made pictures and files."""

import struct
import zlib

import numpy as np


def texture(h, w, seed=7):
    """Smooth random gray picture, no repeats."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (h + 2, w + 2)).astype(float)
    b = (a[:-2, :-2] + 2 * a[1:-1, 1:-1] + a[2:, 2:] + a[:-2, 2:] + a[2:, :-2]) / 6
    return b.astype(np.uint8)


def smooth(h, w, seed=7, grain=16):
    """Random picture whose details are about ``grain`` pixels wide, as coarse searches need."""
    from scanframe.functions import kernels
    small = np.random.default_rng(seed).integers(0, 256, (h // grain + 2, w // grain + 2)).astype(np.uint8)
    return kernels.resize(small, float(grain))[:h, :w]


def frame_row(frame_id, img, **extra):
    img = img if img.ndim == 3 else img[:, :, None]
    return {"frame_id": frame_id, **extra, "width": img.shape[1], "height": img.shape[0], "n_channels": img.shape[2],
            "data": bytearray(np.ascontiguousarray(img, np.uint8).tobytes())}


def frames_df(spark, rows, keys="frame_id long"):
    schema = f"{keys}, width int, height int, n_channels int, data binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def png(rgb):
    """PNG bytes of an (h, w, 3 or 4) array in red-green-blue order."""
    h, w, c = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff(rgb):
    """Uncompressed little-endian TIFF of an (h, w, 3) array."""
    h, w, _ = rgb.shape
    data = rgb.astype(np.uint8).tobytes()
    offset = 8 + len(data)
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 3, offset), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3),
            (278, 3, 1, h), (279, 4, 1, len(data))]
    ifd = struct.pack("<H", len(tags))
    for tag, kind, count, value in tags:
        ifd += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 and count == 1 else struct.pack("<I", value))
    return struct.pack("<2sHI", b"II", 42, offset + 6) + data + struct.pack("<HHH", 8, 8, 8) + ifd + struct.pack("<I", 0)
