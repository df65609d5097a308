"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed stride.

Documents are tokenised once, each followed by an end id, and cut into sequences of ``LENGTH`` ids as they come in a task
(its last one is filled up with end ids). Sequences are numbered through; a keyed Feistel permutation over the next even
power of two, walked along its cycle until it falls below their number, gives every sequence its global slot: a shuffle
that needs no sort key, no state and no driver. Slots are split by ranges, a range to a shard. A shard is a header and one
record of fixed stride per slot, so a reader finds any slot by arithmetic and resumes anywhere; beside it lies an index of
which document's tokens stand where. Files are written under temporary names and renamed once the manifest is stored.

Defined results: a null text is empty (its end id alone); null and repeated ids and repeated rows are kept as they are;
an empty table writes no shard and reads back empty. Only ``doc_id`` and ``text`` are used.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm import warc
from scanframe.llm.packing import _tokenised, _words

LENGTH, END = 4096, 2
SHARD_SLOTS = 1 << 12
ROUNDS = 6
MAGIC = b"SLOTS1\0\0"
HEADER = struct.Struct("<8sIIqq24x")  # magic, length, bytes of an id, first slot, slots
PART = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("known", "<i8"), ("start", "<i8"), ("length", "<i8"), ("offset", "<i8"), ("doc_tokens", "<i8")])
_PARTS = "array<struct<doc_id:bigint,start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>"
_SEQUENCES = f"task int, nth long, ids binary, parts {_PARTS}"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slot long, offset long"


# ---- the permutation -----------------------------------------------------------------------------------------------

def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x ^ np.uint64(key & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(29))


def _keys(key: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]


def slots(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Slot of each index in [0, n), a permutation of them; ``back`` gives the index of each slot."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _keys(key)[::-1] if back else _keys(key)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]  # walk on until the domain is met again
    return out.astype(np.int64)


# ---- sequences -----------------------------------------------------------------------------------------------------

def _packed(ids: bytes) -> bytes:
    """Compressed for the way to the writer, which crosses the store once and a shuffle once."""
    import zstandard
    return zstandard.ZstdCompressor(level=3, write_checksum=False).compress(ids)


def _unpacked(data: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(data)


def _sequences(batches: Iterator[pa.RecordBatch], tokenizer_file: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    task, words, tail = TaskContext.get().partitionId(), _words(tokenizer_file), np.array([end], "<u2").tobytes()
    nth, rows, ids, parts, filled = 0, [], [], [], 0

    def batch_of() -> pa.RecordBatch:
        part = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "doc_tokens")]))
        kinds = [pa.int32(), pa.int64(), pa.binary(), part]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], names=["task", "nth", "ids", "parts"])

    for batch in batches:
        for doc, found in _tokenised(batch, words):
            found += tail
            n, at = len(found) // 2, 0
            while at < n:
                take = min(n - at, length - filled)
                ids.append(found[2 * at:2 * (at + take)])
                parts.append({"doc_id": doc, "start": at, "length": take, "offset": filled, "doc_tokens": n})
                at, filled = at + take, filled + take
                if filled == length:
                    rows.append((task, nth, _packed(b"".join(ids)), parts))
                    nth, ids, parts, filled = nth + 1, [], [], 0
                    if len(rows) == 2048:
                        yield batch_of()
                        rows = []
    if filled:
        rows.append((task, nth, _packed(b"".join(ids) + tail * (length - filled)), parts))
    yield batch_of()


# ---- shards --------------------------------------------------------------------------------------------------------

def _write(batches: Iterator[pa.RecordBatch], uri: str, n: int, per_shard: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slot; a shard's records and its index are two files."""
    store, root = warc.file_system(uri)
    done: list[tuple] = []
    shard, out, index, sha, size, names = None, None, [], None, 0, ("", "")

    def close() -> None:
        out.close()
        done.append((shard, 0, names[0], names[0][38:], size, size // (2 * length), sha.hexdigest()))
        data = np.concatenate(index).tobytes() if index else b""
        with store.open_output_stream(f"{root}/{names[1]}", compression=None) as side:
            side.write(data)
        done.append((shard, 1, names[1], names[1][38:], len(data), len(data) // PART.itemsize, hashlib.sha256(data).hexdigest()))

    for batch in batches:
        for slot, ids, parts in zip(*(batch.column(c).to_pylist() for c in ("slot", "ids", "parts")), strict=True):
            if slot // per_shard != shard:
                if out:
                    close()
                shard, index, sha, size = slot // per_shard, [], hashlib.sha256(), 0
                names = tuple(f"_tmp/{uuid.uuid4().hex}-slots-{shard:08d}.{kind}" for kind in ("bin", "idx"))
                out = store.open_output_stream(f"{root}/{names[0]}", compression=None)
                head = HEADER.pack(MAGIC, length, 2, shard * per_shard, min(per_shard, n - shard * per_shard))
                out.write(head)
                sha.update(head)
                size = len(head)
            ids = _unpacked(ids)
            out.write(ids)
            sha.update(ids)
            size += len(ids)
            index.append(np.array([(slot, p["doc_id"] or 0, p["doc_id"] is not None, p["start"], p["length"], p["offset"], p["doc_tokens"]) for p in parts], PART))
    if out:
        close()
    yield warc._manifest(done)


def write(docs: DataFrame, uri: str, tokenizer_file: str, key: int = 0, length: int = LENGTH, end: int = END, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """Writes the documents' sequences under ``uri`` in the order of ``key`` and returns the stored manifest."""
    spark = docs.sparkSession
    cut = docs.select("doc_id", "text").mapInArrow(lambda it: _sequences(it, tokenizer_file, length, end), _SEQUENCES)
    cut.write.option("compression", "zstd").parquet(f"{uri}/sequences")  # a task's sequences are committed once
    rows = spark.read.parquet(f"{uri}/sequences")
    per_task = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()  # a row per task
    n, first = 0, {}
    for r in per_task:
        first[r["task"]], n = n, n + r["n"]

    @F.pandas_udf("long")
    def slot_of(task: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(slots(task.map(first).to_numpy(np.int64) + nth.to_numpy(np.int64), n, key))

    store, root = warc.file_system(uri)
    store.create_dir(f"{root}/_tmp")
    shards = max(1, -(-n // per_shard))
    placed = rows.withColumn("slot", slot_of("task", "nth")).withColumn("shard", F.floor(F.col("slot") / per_shard))
    dealt = placed.select("shard", "slot", "ids", "parts").repartitionByRange(shards, "shard").sortWithinPartitions("slot")
    dealt.mapInArrow(lambda it: _write(it, uri, n, per_shard, length), warc.MANIFEST).write.parquet(f"{uri}/written")
    spark.read.parquet(f"{uri}/written").mapInArrow(lambda it: warc._rename(it, uri), warc.MANIFEST).write.parquet(f"{uri}/manifest")
    store.delete_dir(f"{root}/_tmp")
    return spark.read.parquet(f"{uri}/manifest")


def _records(store, root: str, name: str, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(slot, ids) of a shard from slot ``first`` up to ``last``, read on from the first record wanted."""
    with store.open_input_file(f"{root}/{name}") as file:
        magic, length, width, start, n = HEADER.unpack(file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard")
        stride = length * width
        at, end = max(first, start), min(last, start + n)
        file.seek(HEADER.size + (at - start) * stride)
        while at < end:
            many = min(end - at, max(1, (1 << 22) // stride))
            data = file.read(many * stride)
            if len(data) != many * stride:
                raise ValueError(f"{name} is cut short")
            for i in range(many):
                yield at + i, data[i * stride:(i + 1) * stride]
            at += many


def _chosen(spark: SparkSession, uri: str, first: int, last: int | None, per_shard: int) -> DataFrame:
    manifest = spark.read.parquet(f"{uri}/manifest").filter("seq = 0").select("shard", "name").filter(F.col("shard") >= first // per_shard)
    if last is not None:
        manifest = manifest.filter(F.col("shard") * per_shard < last)
    n = manifest.count()
    return manifest.repartitionByRange(n, "shard") if n > 1 else manifest


def read(spark: SparkSession, uri: str, first: int = 0, last: int | None = None, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """(slot, ids as little-endian unsigned 16-bit numbers) from slot ``first`` up to, without, ``last``."""
    end = last if last is not None else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = warc.file_system(uri)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                for row in _records(store, root, name, first, end):
                    rows.append(row)
                    if len(rows) == 1024:
                        yield _pairs(rows)
                        rows = []
                yield _pairs(rows)

    def _pairs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["slot", "ids"])

    return _chosen(spark, uri, first, last, per_shard).mapInArrow(run, "slot long, ids binary")


def pieces(spark: SparkSession, uri: str, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """One row per piece of a document, from the shards and their indexes: where it stands, and the CRC of its ids there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = warc.file_system(uri)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name[:-3]}idx", compression=None) as side:
                    index = np.frombuffer(side.read(), PART)  # bounded by the shard
                bounds = np.searchsorted(index["slot"], np.arange(index["slot"][0], index["slot"][-1] + 2)) if len(index) else [0]
                crcs = np.zeros(len(index), np.int64)
                for i, (_, ids) in enumerate(_records(store, root, name, 0, 1 << 62)):
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    for j in range(bounds[i], bounds[i + 1]):
                        offset = index["offset"][j]
                        crcs[j] = zlib.crc32(wide[offset:offset + index["length"][j]])
                doc = pa.array(index["doc_id"], mask=index["known"] == 0)
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(np.ascontiguousarray(index[c])) for c in ("start", "length")], pa.array(crcs),
                                                  *[pa.array(np.ascontiguousarray(index[c])) for c in ("doc_tokens", "slot", "offset")]], names=[x.split()[0] for x in PIECES.split(", ")])

    return _chosen(spark, uri, 0, None, per_shard).mapInArrow(run, PIECES)
