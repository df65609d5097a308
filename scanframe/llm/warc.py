"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page. The borders between shards come from the rows themselves (a hash-chosen sample of
ids, about ``BORDER_SAMPLE`` a shard, only places borders), so the same pages give the same files wherever they run.
A shard's file is rolled by compressed size; headers and digests are made anew from the payload. A task writes to
temporary names and returns manifest rows; once those are stored, files get their final names, and only files in the
manifest count: what a lost executor left behind is never read.

Of equal payloads of ``revisit_from`` bytes or more, the one with the largest page id is a response and the others are
revisits of it. Only the revisits' ids travel to the writer, beside the pages; payloads are shuffled once.

Defined results: a null html is an empty payload; a null page id sorts first and counts as smallest (equal payloads
that have null ids only are all responses); repeated rows with the same id and payload have the same type; a null url
is written as ``about:blank``; an empty table writes no file.

Files go through ``pyarrow.fs``, which reaches local, HDFS, S3 and GCS folders by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 1 << 25
ROLL_BYTES = 1 << 26
BORDER_SAMPLE = 200
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
MANIFEST = "shard int, seq int, temporary string, name string, bytes long, records long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the standard's URL name space


def file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return z.compress(record) + z.flush()


def _id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers_to: int | None) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    fields = [("WARC-Record-ID", _id(page_id, digest, copy)), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", "sha1:" + digest),
              ("WARC-Page-Id", "" if page_id is None else str(page_id)), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is None:
        return _record("response", [*fields, ("Content-Type", "application/http; msgtype=response")], head + payload)
    fields += [("WARC-Refers-To", _id(refers_to, digest, 0)), ("WARC-Refers-To-Page-Id", str(refers_to)),
               ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _record("revisit", fields, b"")


class _File:
    def __init__(self, store, root: str, shard: int, seq: int):
        self.shard, self.seq, self.bytes, self.records, self.sha = shard, seq, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:06d}-{seq:04d}.warc.gz"
        self.temporary = f"_tmp/{uuid.uuid4().hex}-{self.name}"
        self.out = store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.add(_record("warcinfo", [("WARC-Record-ID", _id(self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.seq, self.temporary, self.name, self.bytes, self.records, self.sha.hexdigest()


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])


def _write(batches: Iterator[pa.RecordBatch], uri: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, page, digest; a revisit's row comes just before its pages."""
    store, root = file_system(uri)
    file, done, key, copy, refers = None, [], None, 0, None
    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "page_id", "digest", "revisit", "refers_to", "url", "html")]
        for i in range(len(batch)):
            shard, page, digest, revisit, target, url, html = (c[i].as_py() for c in columns)
            if file and file.shard != shard:
                done.append(file.close())
                file = None
            if (shard, page, digest) != key:
                key, copy, refers = (shard, page, digest), 0, None
            if revisit:
                refers = target
                continue
            file = file or _File(store, root, shard, 0)
            if file.bytes >= roll:
                done.append(file.close())
                file = _File(store, root, shard, file.seq + 1)
            file.add(page_record(page, url, (html or "").encode(), copy, refers))
            copy += 1
    if file:
        done.append(file.close())
    yield _manifest(done)


def _rename(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Safe to repeat: a name that an earlier attempt has moved already stays."""
    from pyarrow import fs
    store, root = file_system(uri)
    for batch in batches:
        for row in batch.to_pylist():
            if store.get_file_info(f"{root}/{row['temporary']}").type == fs.FileType.File:
                store.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
            if store.get_file_info(f"{root}/{row['name']}").size != row["bytes"]:
                raise OSError(f"{row['name']} is not the file of the manifest")
        yield batch


def write(pages: DataFrame, uri: str, revisit_from: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``uri`` and returns the manifest, stored as ``uri``/manifest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"))
    thin = rows.select("page_id", "digest", F.octet_length("html").alias("size"))
    n, total = thin.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = 1 + total // shard_bytes
    every = max(1, n // (BORDER_SAMPLE * shards))
    chosen = thin.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id", "digest"), F.lit(every)) == 0)) if shards > 1 else None
    sample = np.sort(np.array([r[0] for r in chosen.select("page_id").collect()], np.int64)) if shards > 1 else np.array([], np.int64)
    borders = np.unique(sample[np.arange(1, shards) * len(sample) // shards]) if len(sample) else sample

    store, root = file_system(uri)
    store.create_dir(f"{root}/_tmp")

    @F.pandas_udf("int")
    def shard_of(page: pd.Series) -> pd.Series:
        at = np.searchsorted(borders, page.fillna(-(1 << 63)).to_numpy(np.int64), side="right")
        return pd.Series(at.astype(np.int32))

    same = thin.filter(F.col("size") >= revisit_from).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("refers_to"))
    revisits = (thin.join(same.filter((F.col("copies") > 1) & F.col("refers_to").isNotNull()), "digest")
                .filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to"))
    both = (rows.select("page_id", "digest", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
            .unionByName(revisits.select("page_id", "digest", F.lit(True).alias("revisit"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))))
    shard = shard_of(F.col("page_id")) if len(borders) else F.lit(0)
    dealt = (both.withColumn("shard", shard).repartitionByRange(shards, "shard")
             .sortWithinPartitions("shard", "page_id", "digest", F.desc("revisit"), "url"))
    dealt.mapInArrow(lambda it: _write(it, uri, roll_bytes), MANIFEST).write.parquet(f"{uri}/written")
    spark = pages.sparkSession
    spark.read.parquet(f"{uri}/written").mapInArrow(lambda it: _rename(it, uri), MANIFEST).write.parquet(f"{uri}/manifest")
    store.delete_dir(f"{root}/_tmp")  # what lost attempts left
    return spark.read.parquet(f"{uri}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file of gzip members, checked against its digest."""
    z, data, record = zlib.decompressobj(31), b"", []
    while True:
        data = data or stream.read(1 << 16)
        if not data:
            break
        record.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            whole = b"".join(record)
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[:int(fields["Content-Length"])]
            if fields["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
                raise ValueError(f"broken record {fields['WARC-Record-ID']}")
            yield fields, block
            z, record = zlib.decompressobj(31), []
    if any(record):
        raise ValueError("truncated WARC file")


def _read(batches: Iterator[pa.RecordBatch], uri: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, root = file_system(uri)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows, held = [], 0
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for fields, block in records(stream):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None:
                        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
                    page, refers = fields["WARC-Page-Id"], fields.get("WARC-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], kind, int(refers) if refers else None, size, digest, *[payload] * payloads))
                    held += 200 + len(block) * payloads
                    if held > 1 << 23:
                        yield out(rows)
                        rows, held = [], 0
            yield out(rows)


def read(spark, uri: str, payloads: bool = True) -> DataFrame:
    """Records of the archives that the manifest names, a file to a task; ``payload`` is null for revisits."""
    manifest = spark.read.parquet(f"{uri}/manifest").select("name", "bytes")
    files = manifest.count()
    spread = manifest.repartitionByRange(max(1, files), "name") if files > 1 else manifest
    return spread.mapInArrow(lambda it: _read(it, uri, payloads), RECORDS + ", payload binary" * payloads)
