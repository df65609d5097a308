"""SentencePiece encoding and decoding through a table of distinct chunks.

With a model in which no piece has the white-space marker after another character, no merge crosses from one marked
word into the next: a text is a row of chunks (markers, then other characters), each segmented alone. Every distinct
chunk is given to the library once per task, encoding and decoding alike, and the results are joined back by
position. The table is kept per task because a table of the whole corpus would move every chunk of every text through
a shuffle twice; it is emptied when it holds ``TABLE`` chunks, so memory stays bounded and results don't depend on it.

Defined results: a null text is an empty text (end id only); order, repeated rows and other columns are untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
TABLE = 1 << 18
DIGEST = ("n_tokens", "ids_sha256", "decoded_sha256")
LONG = 1 << 12
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """Segments texts with one model. ``chunk`` gives (ids, decoded text) of a marked word."""

    def __init__(self, model_file: str, end: bool = True):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.lib.get_piece_size()
        if any(MARK in self.lib.id_to_piece(i).lstrip(MARK) for i in range(size)):
            raise ValueError("a piece of this model crosses a white-space marker: chunks cannot be segmented alone")
        if self.lib.encode("a") != self.lib.encode(f"{MARK}a")[1:] and self.lib.id_to_piece(self.lib.encode("a")[0])[0] != MARK:
            raise ValueError("this model adds no leading marker")
        self.end = [self.lib.eos_id()] if end else []
        self.single = self.lib.piece_to_id(MARK)
        self.table: dict[str, tuple] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        parts = marked[1:].split(MARK)
        if "" not in parts:
            return [MARK + p for p in parts]
        return _CHUNK.findall(marked)

    def lookup(self, chunks: list[str], made) -> list:
        """made(chunk, ids) for every chunk, each distinct one segmented once."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.table]
        if len(self.table) + len(new) > TABLE:
            self.table.clear()
            new = list(dict.fromkeys(chunks))
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            # the library puts the first marker back itself
            for c, ids in zip(part, self.lib.encode([c[1:].replace(MARK, " ") for c in part], num_threads=1), strict=True):
                self.table[c] = made(c, ids if c != MARK else [self.single])
        get = self.table.__getitem__
        return [get(c) for c in chunks]

    def decoded(self, ids: list[int]) -> str:
        """Text of one chunk's ids as it stands inside a document, its leading marker included."""
        return " " + self.lib.decode(ids)


def _digest(chunk: str, ids: list[int], pieces: Pieces) -> tuple[int, str, str]:
    return len(ids), " ".join(map(str, ids)), pieces.decoded(ids)


def _rows(batches: Iterator[pa.RecordBatch], model_file: str, end: bool) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(model_file, end)
    tail = " ".join(map(str, pieces.end))
    for batch in batches:
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            chunks = pieces.chunks(text or "")
            n, ids, out = 0, hashlib.sha256(), hashlib.sha256()
            for i in range(0, len(chunks), LONG):  # long texts go through in parts
                got = pieces.lookup(chunks[i:i + LONG], lambda c, x: _digest(c, x, pieces))
                n += sum(g[0] for g in got)
                ids.update((" ".join([g[1] for g in got]) + " ").encode())
                part = "".join([g[2] for g in got])
                out.update((part[1:] if i == 0 else part).encode())
            if not pieces.end and chunks:
                raise ValueError("digests are defined with an end id")
            ids.update(tail.encode())
            counts.append(n + len(pieces.end))
            ids_sha.append(ids.hexdigest())
            text_sha.append(out.hexdigest())
        keep = [c for c in batch.schema.names if c not in ("text", *DIGEST)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                         names=[*keep, *DIGEST])


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 in place of the text. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", *DIGEST)]
    schema = T.StructType(kept + [T.StructField(n, T.LongType() if n == "n_tokens" else T.StringType()) for n in DIGEST])
    return docs.mapInArrow(lambda it: _rows(it, model_file, True), schema)


def _encoded(batches: Iterator[pa.RecordBatch], model_file: str, end: bool) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(model_file, end)
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            out.append([i for g in pieces.lookup(pieces.chunks(text or ""), lambda c, x: x) for i in g] + pieces.end)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])


def encode(docs: DataFrame, model_file: str, end: bool = True) -> DataFrame:
    """Adds ``ids`` (array of int) to the documents."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "ids"] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.drop("ids").mapInArrow(lambda it: _encoded(it, model_file, end), schema)


def _decoded(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for batch in batches:
        out = [lib.decode(x or []) for x in batch.column("ids").to_pylist()]
        keep = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "decoded"])


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """Replaces ``ids`` by ``decoded``, for ids from any source."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("ids", "decoded")] + [T.StructField("decoded", T.StringType())])
    return rows.drop("decoded").mapInArrow(lambda it: _decoded(it, model_file), schema)
