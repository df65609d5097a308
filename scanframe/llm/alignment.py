"""Alignment of two tokenizers' ids over the same bytes, by diagonal run skipping.

Every text is encoded by a byte-level BPE (A, space + text) and by a sentencepiece model (B, which adds the space). Both
give the ends of their tokens as byte offsets; where both end, a group ends. Most groups are one token to one, so the
two arrays of ends are equal along a diagonal: at the current shift between the indexes, stretches of 1, 2, 4, ... ends
are compared at once until one differs, the last stretch is halved down to the first difference, and the whole run is
jumped. An irregular group is resolved by walking on whichever side is behind until both end together; that sets the new
shift.

Links are counted corpus-wide: in how many documents an A id and a B id share a group. Documents are dealt into blocks of
a bounded number of links; a block asks once for each of its different pairs and gets their counts back, so hot pairs
travel once per block instead of once per document, and what a task holds is one block (or one text, where that is longer).

Defined results: null and empty texts, and texts that either side does not give back byte by byte (the white-space mark
U+2581 in the text, say), have no tokens: zeros and an empty digest; they count for no pair. Repeated rows are documents
of their own. Ties for the highest count are all best. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanframe.llm.common import shared_dir

MARK = "▁"
#: Different links a block holds, over all its documents.
BLOCK = 1 << 20
#: A group with more links than this is counted by its different ids.
WIDE = 4096
#: Characters that one call of the byte-level encoder gets; longer texts go to a slower one without such a bound.
LONG = 1 << 16
#: Fixed value: how byte-level BPE splits a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOC = ("n_a", "n_b", "n_groups", "n_links")


# ---- the two tokenizers ------------------------------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids and bytes of a byte-level BPE file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        self.bytes = {i: bytes(map(alphabet.__getitem__, token)) for token, i in model["vocab"].items() if all(c in alphabet for c in token)}
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        # merges in the order of their ids: then ranks alone say what is merged first, and the faster library gives the same ids
        special = {t.content for t in self.slow.get_added_tokens_decoder().values() if t.special}
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or len(text) > LONG:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Marked:
    """Ids and bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        hexed = re.compile("<0x([0-9A-Fa-f]{2})>")
        pieces = ((i, self.lib.id_to_piece(i)) for i in range(self.lib.get_piece_size()))
        self.bytes = {i: bytes([int(hexed.fullmatch(p)[1], 16)]) if self.lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces}

    def encode(self, text: str) -> list[int]:
        return self.lib.encode(text, num_threads=1)


@functools.lru_cache(2)
def _side(kind: type, path: str) -> tuple:
    """The tokenizer, its tables by id (bytes, length, decimal id with what follows it), once per worker process."""
    tokenizer = kind(path)
    size = max(tokenizer.bytes) + 1
    table = [tokenizer.bytes.get(i, b"") for i in range(size)]
    end = "|" if kind is ByteLevel else ";"
    names = np.array([[f"{i}{sign}" for i in range(size)] for sign in (end, ",")], object)
    return tokenizer, table, np.array([len(b) for b in table], np.int64), names


# ---- one text ----------------------------------------------------------------------------------------------------------

def runs(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """(from a, to a, from b, to b) in order: runs of one-to-one groups (equally long sides) and single irregular groups.

    Both lists rise and end with the same number. An irregular group has two tokens or more on one side at least; it may
    be as long on both sides, then its ends differ before the last.
    """
    i = j = 0
    n, out = len(ends_a), []
    while i < n:
        a, b = i, j
        if ends_a[i] == ends_b[j]:
            shift, step = j - i, 2
            i += 1
            while ends_a[i:i + step] == ends_b[i + shift:i + shift + step]:
                i += step
                if i >= n:
                    i = n
                    break
                step *= 2
            else:
                while step > 1:  # the stretch that differs: down to its first difference
                    step //= 2
                    if ends_a[i:i + step] == ends_b[i + shift:i + shift + step]:
                        i += step
            j = i + shift
        else:
            x, y = ends_a[i], ends_b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
            i, j = i + 1, j + 1
        out.append((a, i, b, j))
    return out


def grouped(found: list[tuple[int, int, int, int]], ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the groups on both sides."""
    a, to_a, b, to_b = np.array(found, np.int64).T
    # an irregular group's first ends differ; a run is as many groups as it has tokens on a side
    run = (to_a - a == to_b - b) & (ends_a[a] == ends_b[b])
    count = np.where(run, to_a - a, 1)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start_a, start_b = np.repeat(a, count) + nth, np.repeat(b, count) + nth
    return start_a, np.diff(start_a, append=len(ends_a)), start_b, np.diff(start_b, append=len(ends_b))


def links(ids_a: np.ndarray, ids_b: np.ndarray, groups: tuple, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different linked pairs (A id x width + B id, rising) and how often each is linked."""
    start_a, n_a, start_b, n_b = groups
    size = n_a * n_b
    narrow = np.flatnonzero(size <= WIDE)
    lengths = size[narrow]
    group = np.repeat(narrow, lengths)
    place = np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = [ids_a[start_a[group] + place // n_b[group]] * width + ids_b[start_b[group] + place % n_b[group]]]
    times = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > WIDE):
        (a, ka), (b, kb) = (np.unique(ids[s[g]:s[g] + n[g]], return_counts=True) for ids, s, n in ((ids_a, start_a, n_a), (ids_b, start_b, n_b)))
        codes.append((a[:, None] * width + b[None, :]).ravel())
        times.append((ka[:, None] * kb[None, :]).ravel())
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def written(groups: tuple, ids_a: np.ndarray, ids_b: np.ndarray, names_a: np.ndarray, names_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``; names hold every id with the sign that follows it, at the end of a side and inside one."""
    start_a, n_a, start_b, n_b = groups
    out = np.empty(len(ids_a) + len(ids_b), object)
    for ids, names, start, n, before in ((ids_a, names_a, start_a, n_a, start_b), (ids_b, names_b, start_b, n_b, start_a + n_a)):
        inside = np.ones(len(ids), np.int64)
        inside[start + n - 1] = 0
        out[np.arange(len(ids)) + np.repeat(before, n)] = names[inside, ids]
    return "".join(out.tolist())[:-1]


def aligned(text: str, path_a: str, path_b: str) -> tuple | None:
    """(n_a, n_b, n_groups, n_links, digest, codes, times) of a text, None if it has no tokens."""
    if not text:
        return None
    (a, bytes_a, lengths_a, names_a), (b, bytes_b, lengths_b, names_b) = _side(ByteLevel, path_a), _side(Marked, path_b)
    ids_a, ids_b, whole = a.encode(" " + text), b.encode(text), b" " + text.encode()
    if b"".join([bytes_a[i] for i in ids_a]) != whole or b"".join([bytes_b[i] for i in ids_b]) != whole:
        return None
    num_a, num_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    # a token of no bytes would end where the one before it does; neither kind of vocabulary has any
    ends_a, ends_b = np.cumsum(lengths_a[num_a]), np.cumsum(lengths_b[num_b])
    groups = grouped(runs(ends_a.tolist(), ends_b.tolist()), ends_a, ends_b)
    codes, times = links(num_a, num_b, groups, len(lengths_b))
    digest = hashlib.sha256(written(groups, num_a, num_b, names_a, names_b).encode()).hexdigest()
    return len(ids_a), len(ids_b), len(groups[0]), int(times.sum()), digest, codes, times


# ---- the corpus --------------------------------------------------------------------------------------------------------

def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]), kind))


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per document, and after the last of each block one with the block's different links and their documents."""
    from pyspark import TaskContext
    block, held = TaskContext.get().partitionId() << 32, []
    none = np.empty(0, np.int64)

    def rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*found, strict=True))
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), ids, *[pa.array(p, pa.int64()) for p in parts[:4]], pa.array(parts[4], pa.string()),
             _lists(parts[5], pa.int64()), _lists(parts[6], pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)

    def closing() -> pa.RecordBatch:
        codes, docs = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), *[pa.nulls(1, f.type) for f in list(schema)[1:-2]], _lists([codes], pa.int64()), _lists([docs], pa.int64())], schema=schema)

    for batch in batches:
        start, found = 0, []
        for at, text in enumerate(batch.column("text").to_pylist(), 1):
            found.append(aligned(text, path_a, path_b) or (0, 0, 0, 0, "", none, none))
            held.append(found[-1][5])
            full = sum(map(len, held)) >= BLOCK if at % 64 == 0 or len(held[-1]) > BLOCK >> 6 else False
            if full or at == len(batch):
                yield rows(batch.column("doc_id").slice(start, at - start), found)
                start, found = at, []
            if full:
                yield closing()
                block, held = block + 1, []
    if held:
        yield closing()


def _summed(docs: pa.Table, counts: pa.Table, doc_type: pa.DataType) -> pa.Table:
    """Sums over the links of a block's documents; ``value`` is twice the count, plus one where that is the A id's highest."""
    codes = counts.column("code").to_numpy()
    order = np.argsort(codes)
    codes, values = codes[order], counts.column("value").to_numpy()[order]
    best, total = [], []
    for mine, times in zip(docs.column("codes").combine_chunks(), docs.column("times").combine_chunks(), strict=True):
        mine, times = mine.values.to_numpy(), times.values.to_numpy()
        value = values[np.searchsorted(codes, mine)] if len(mine) else mine
        best.append(int(times[value & 1 == 1].sum()))
        total.append(int((times * (value >> 1)).sum()))
    return pa.table([docs.column("doc_id").cast(doc_type), *[docs.column(c) for c in DOC], pa.array(best, pa.int64()), pa.array(total, pa.int64()), docs.column("groups_sha256")],
                    names=["doc_id", *DOC, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(code, n, highest) of all linked pairs: the documents that hold each and whether no pair of its A id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("block_codes", "block_docs")).alias("p")).groupBy(F.col("p.block_codes").alias("code")).agg(F.sum("p.block_docs").alias("n"))
    pairs = pairs.withColumn("a", F.floor(F.col("code") / width))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("highest"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark, longs = docs.sparkSession, T.ArrayType(T.LongType())
    doc_id = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("block", T.LongType()), doc_id, *[T.StructField(c, T.LongType()) for c in DOC], T.StructField("groups_sha256", T.StringType()),
                           *[T.StructField(c, longs) for c in ("codes", "times", "block_codes", "block_docs")]])
    arrow = to_arrow_schema(schema)
    path = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    made = docs.select("doc_id", "text").mapInArrow(lambda it: _blocks(it, path_a, path_b, arrow), schema)
    made.write.option("compression", "zstd").parquet(path)  # stored: texts are encoded once
    stored = spark.read.schema(schema).parquet(path)
    blocks = stored.select("block", "block_codes", "block_docs").filter("block_codes is not null")
    width = len(_side(Marked, path_b)[2])
    asked = blocks.select(F.col("block").alias("home"), F.explode("block_codes").alias("code"))
    counts = asked.join(pair_counts(blocks, width), "code").select("home", "code", (2 * F.col("n") + F.col("highest").cast("int")).alias("value"))
    rows = stored.filter("codes is not null").drop("block_codes", "block_docs")
    doc_type = arrow.field("doc_id").type
    out = T.StructType([doc_id, *[T.StructField(c, T.LongType()) for c in (*DOC, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    return rows.groupBy("block").cogroup(counts.groupBy("home")).applyInArrow(lambda a, b: _summed(a, b, doc_type), out)
