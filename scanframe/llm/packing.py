"""Cost-balanced packing of token ids into sequences.

A document's cost is linear in its tokens plus quadratic attention cost over each piece. Documents are tokenised once;
whole sequences' worth of a long document are cut off at once, and its rest is dealt to a packing task by hash. A task
packs a bounded number of tokens (the number of tasks grows with the texts): it opens as many sequences as its tokens
fill, the last few as powers of two so that nothing is padded, then assigns documents in descending order to the
sequence of lowest cost that still has room for them. Only a document that fits nowhere is cut further.

Defined results: a null text is empty (its end id alone); repeated rows are packed each; an empty table gives an empty
result. Nothing is keyed by ``doc_id``, so null and repeated ids do no harm.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 4096
END = 2
#: Characters of text to a packing task. Its rests, two bytes an id, are held in memory: some tens of MB.
TASK_CHARS = 1 << 25
#: What a row counts for besides its text.
ROW_CHARS = 64
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Words in a task's table of distinct words, and characters given to the tokenizer at once.
TABLE, BATCH_CHARS = 3 << 19, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: What may follow a word's letters and is then a pre-token of its own.
MARKS = b".,;:!?*#$%&+=-~^)(]["
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "__task int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Words:
    """Ids of whole texts from a table of distinct words: this tokenizer drops white space, so words stand alone, and a
    pre-token's last id is one that ends a word. The first ``TABLE`` words stay in the table, among them all common ones."""

    def __init__(self, tokenizer_file: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.lib = Tokenizer.from_file(tokenizer_file)
        # lower-case Latin letters between spaces need no normalising and no pattern to be told apart
        self.letters = Tokenizer.from_file(tokenizer_file)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(1 << 16, bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.table: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids (the vocabulary has 49,408) of each text. New words of all are learnt at once."""
        # the tokenizer lowers letters itself; a special token's string has to stay as it is
        words = [(text if b"<|" in text else text.lower()).split() for text in texts]  # the six ASCII white-space characters
        table = self.table
        new = set().union(*words).difference(table)
        if new:
            learnt = self._learn(new)
            if len(table) + len(learnt) <= TABLE:
                table.update(learnt)
            else:
                table = ChainMap(learnt, table)
        return [b"".join(map(table.__getitem__, w)) for w in words]

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Letters alone, and what is left of them, are encoded by the thousand; other words one by one."""
        letters, rest, ended = set(), set(), {}
        for w in new:
            core = w.rstrip(MARKS)
            if not _plain(core):
                rest.add(w)
            else:
                letters.add(core)
                if len(core) < len(w):
                    ended[w] = core
                    rest.add(w[len(core):])
        found: dict[bytes, bytes] = {}
        for part in _parts(letters, 1 << 16):
            ids = np.array(self.letters.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u2")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, at = ids.tobytes(), 0
                for w, stop in zip(part, (2 * stops).tolist(), strict=True):
                    found[w], at = raw[at:stop], stop
            else:
                rest.update(part)
        for part in _parts(rest, BATCH_CHARS):
            for w, e in zip(part, self.lib.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, "<u2").tobytes()
        for w, core in ended.items():
            found[w] = found[core] + found[w[len(core):]]
        return found


def _plain(word: bytes) -> bool:
    """Lower-case letters of the Latin blocks only: one pre-token, as it stands."""
    if word.isalpha():
        return word.islower()
    text = word.decode()
    return text.isalpha() and text == text.lower() and max(text) < "\u0250"


def _parts(words: set[bytes], size: int) -> Iterator[list[bytes]]:
    part, held = [], 0
    for w in words:
        if part and held + len(w) > size:
            yield part
            part, held = [], 0
        part.append(w)
        held += len(w) + 1
    if part:
        yield part


@lru_cache(maxsize=1)
def _words(tokenizer_file: str) -> Words:
    """One table to a worker process, which Spark uses for task after task."""
    return Words(tokenizer_file)


def crc(ids: bytes) -> int:
    """Of ids as little-endian unsigned 32-bit numbers, given as 16-bit ones."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4"))


def _between_spaces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + BATCH_CHARS)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def _tokenised(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[int | None, bytes]]:
    docs, texts, held = [], [], 0
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        docs.append(doc)
        texts.append(text.as_py() or b"")
        held += len(texts[-1])
        if len(texts[-1]) > 4 * BATCH_CHARS:  # by parts that end at white space
            long = texts.pop()
            yield from zip(docs, words.ids(texts), strict=False)
            yield doc, b"".join(words.ids([part])[0] for part in _between_spaces(long))
            docs, texts, held = [], [], 0
        elif held > BATCH_CHARS:
            yield from zip(docs, words.ids(texts), strict=True)
            docs, texts, held = [], [], 0
    yield from zip(docs, words.ids(texts), strict=True)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer_file: str, tasks: int, length: int, end: int) -> Iterator[pa.RecordBatch]:
    """Whole-sequence pieces (ids left out) and rests with their ids, dealt to tasks by content."""
    words = _words(tokenizer_file)
    tail = np.array([end], "<u2").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc, ids in _tokenised(batch, words):
            ids += tail
            n = len(ids) // 2
            task = zlib.crc32(ids, (doc or 0) & 0xFFFFFFFF) % tasks
            for at in range(0, n - n % length, length):
                rows.append(((task + at // length) % tasks, doc, at, length, crc(ids[2 * at:2 * (at + length)]), n, None))
            if n % length:
                at = n - n % length
                rows.append((task, doc, at, n - at, 0, n, ids[2 * at:]))
            held += 2 * (n % length) + 64
            if held > 1 << 23:
                yield _batch(rows)
                rows, held = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _CUT.split(", ")])


def place(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int, int]]]:
    """For rests in descending order: the pieces (start, length, sequence, offset) of each.

    Sequences hold exactly all tokens: full ones, then powers of two.
    """
    total = sum(lengths)
    rooms = [length] * (total // length) + [1 << b for b in range(total.bit_length() - 1, -1, -1) if (total % length) >> b & 1]
    used = [0] * len(rooms)
    open_by_cost = [(0.0, s) for s in range(len(rooms))]  # may have room for the document at hand
    heapq.heapify(open_by_cost)
    spent = [0.0] * len(rooms)
    by_room: list[tuple[int, int]] = []  # (-room, sequence): too full for the documents so far
    out = []

    def put(start: int, n: int, s: int) -> tuple[int, int, int, int]:
        piece = (start, n, s, used[s])
        used[s] += n
        spent[s] += cost(n)
        return piece

    for n in lengths:
        while by_room and -by_room[0][0] >= n:
            s = heapq.heappop(by_room)[1]
            heapq.heappush(open_by_cost, (spent[s], s))
        pieces: list[tuple[int, int, int, int]] = []
        while open_by_cost:
            s = heapq.heappop(open_by_cost)[1]
            room = rooms[s] - used[s]
            if room >= n:
                pieces.append(put(0, n, s))
                if room > n:
                    heapq.heappush(open_by_cost, (spent[s], s))
                break
            heapq.heappush(by_room, (-room, s))
        start = 0
        while not pieces or start:  # it fits nowhere: it is cut over the roomiest ones
            room, s = heapq.heappop(by_room)
            take = min(-room, n - start)
            pieces.append(put(start, take, s))
            start += take
            if take < -room:
                heapq.heappush(by_room, (room + take, s))
            if start == n:
                break
        out.append(pieces)
    return out


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of a Spark partition come sorted by task, then by descending length."""
    at: int | None = None
    held: list[tuple] = []

    def packed() -> Iterator[pa.RecordBatch]:
        whole = [r for r in held if r[6] is None]
        rests = [r for r in held if r[6] is not None]
        base = at << 32
        rows = [(doc, start, n, c, total, base + i, 0) for i, (_, doc, start, n, c, total, _) in enumerate(whole)]
        for (_, doc, start, _, _, total, ids), pieces in zip(rests, place([r[3] for r in rests], length), strict=True):
            for first, n, s, offset in pieces:
                rows.append((doc, start + first, n, crc(ids[2 * first:2 * (first + n)]), total, base + len(whole) + s, offset))
        for i in range(0, len(rows), 1 << 16):
            part = list(zip(*rows[i:i + (1 << 16)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names=[x.split()[0] for x in PIECES.split(", ")])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != at:
                if held:
                    yield from packed()
                at, held = row[0], []
            held.append(row)
    if held:
        yield from packed()


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one shuffle of the rests' ids."""
    if length & (length - 1):
        raise ValueError("the sequence length has to be a power of two")
    chars = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + ROW_CHARS)).first()[0] or 0
    tasks = 1 + chars // TASK_CHARS
    cut = docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, tokenizer_file, tasks, length, end), _CUT)
    dealt = cut.repartition(tasks, "__task").sortWithinPartitions("__task", F.desc("length"), "doc_id", "start", "ids_crc32", "ids")
    return dealt.mapInArrow(lambda it: _pack(it, length), PIECES)
