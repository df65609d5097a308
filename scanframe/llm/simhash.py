"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Equal fingerprints are one entry. Entries are sorted by Gray rank, in which neighbours share long runs of bits, and cut
into leaves; every node of the index keeps the bits that all its members share (mask and pattern), ``FAN`` neighbours
share a parent. The search is a join of the index with itself from the top down: a pair of nodes survives while the
shared patterns differ in no more bits than allowed, so whole groups are pruned by their accumulated differences. Only
the leaves of surviving pairs are compared entry by entry. Hot buckets need no special care: leaves hold a bounded
number of different fingerprints wherever these crowd, and copies are counted once.

Defined results: null and empty texts have fingerprint zero and link like any other; rows with a null ``doc_id`` take
part, their component is the least id reachable (null if there is none); repeated rows are one entry; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanframe.llm.common import Scratch, cut, few, text_of
from scanframe.llm.links import asking, components, crossing, maybe_in, merged_in_rounds
from scanframe.llm.minhash import BITS, odd_limit, odd_sketch

#: How a table that is read again is stored.
Keep = Callable[[DataFrame], DataFrame]
SEED = 42
LEAF, FAN, SUB = 512, 8, 16
PART = 1 << 16


# ---- fingerprints --------------------------------------------------------------------------------------------------

def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    return np.array([xxh64_intdigest(b" ".join(s), seed) for s in zip(*[words[i:] for i in range(size)], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are 1 in over half of the hashes, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PART):
        part = hashes[i:i + PART].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """The documents' columns but the text, and ``fp``, the 64 bits as a long. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "fp")]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [majority(shingle_hashes(t.as_py() or b"", size)) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(np.array(out, np.uint64).view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


# ---- the index -----------------------------------------------------------------------------------------------------

def gray_rank(fp: Column) -> Column:
    """Place of the bits in Gray order, as a long that sorts as an unsigned one does."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _packed(fps: np.ndarray) -> bytes:
    """Entries in four bytes each where they fit, else in eight; the first byte says which."""
    return b"\x04" + fps.astype("<u4").tobytes() if int(fps.max()) >> 32 == 0 else b"\x08" + fps.astype("<u8").tobytes()


def _unpacked(members: bytes) -> np.ndarray:
    return np.frombuffer(members, f"<u{members[0]}", offset=1).astype(np.uint64)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a partition come sorted by table and Gray rank; leaves don't cross from one table into the next."""
    from pyspark import TaskContext
    first = TaskContext.get().partitionId() << 32
    seq, held, kind = 0, [], None

    def leaf(part: np.ndarray, table: int) -> tuple:
        shared = ~np.bitwise_or.reduce(part ^ part[0])
        return table, first + seq, int(shared.view(np.int64)), int((part[0] & shared).view(np.int64)), _packed(part)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["t", "node", "mask", "pattern", "members"])

    for batch in batches:
        tables, fps, rows = batch.column("t").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), []
        for at in [0, *(np.flatnonzero(np.diff(tables)) + 1)]:
            table = int(tables[at])
            part = fps[at:at + np.searchsorted(tables[at:], table, side="right")]
            if held and kind != table:
                rows.append(leaf(np.concatenate(held), kind))
                seq, held = seq + 1, []
            kind = table
            have = np.concatenate([*held, part])
            held = []
            for i in range(0, len(have), LEAF):
                if len(have) - i < LEAF:
                    held = [have[i:]]
                else:
                    rows.append(leaf(have[i:i + LEAF], kind))
                    seq += 1
        yield batch_of(rows)
    if held:
        yield batch_of([leaf(np.concatenate(held), kind)])


def _groups(nodes: DataFrame) -> list[str]:
    """Least and greatest group of a node's entries, where these have groups."""
    return [c for c in ("lo", "hi") if c in nodes.columns]


def _parents(nodes: DataFrame) -> DataFrame:
    """FAN neighbours to a parent: it shares the bits that are in every child's mask and equal in their patterns."""
    mask = F.expr("bit_and(mask) & ~(bit_or(pattern) ^ bit_and(pattern))")
    ends = [f(c).alias(c) for f, c in zip((F.min, F.max), _groups(nodes), strict=False)]
    return nodes.groupBy("t", "parent").agg(mask.alias("mask"), F.expr("bit_and(pattern)").alias("p"), *ends).select(
        "t", F.col("parent").alias("node"), "mask", F.col("p").bitwiseAND(F.col("mask")).alias("pattern"), *_groups(nodes))


def _levels(leaves: DataFrame, keep: Keep = cut) -> list[DataFrame]:
    """The index from its root level down to the leaves: (t, node, parent, mask, pattern)."""
    order = leaves.select("t", "node").withColumn("pid", F.shiftrightunsigned("node", 32)).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    base, at = [], 0  # a number per partition: numbers leaves through
    for pid, n in sorted(order.coalesce(1).collect()):
        base.append((pid, at - (pid << 32)))
        at += n
    shift = leaves.sparkSession.createDataFrame(base or [(0, 0)], "pid long, shift long")
    level = (leaves.drop("members").withColumn("pid", F.shiftrightunsigned("node", 32)).join(F.broadcast(shift), "pid")
             .select("t", "node", (F.col("node") + F.col("shift")).alias("at"), "mask", "pattern", *_groups(leaves)))
    level = keep(level.select("t", F.col("node").alias("leaf"), F.col("at").alias("node"), F.floor(F.col("at") / FAN).alias("parent"), "mask", "pattern", *_groups(leaves)))
    levels, n = [level], at
    while n > 1:
        up = _parents(levels[-1]).withColumn("parent", F.floor(F.col("node") / FAN))
        n = -(-n // FAN)
        levels.append(keep(few(up, n)))
    return levels[::-1]


def _differ(limit: int, grouped: bool) -> Column:
    near = F.expr(f"bit_count((a.pattern ^ b.pattern) & a.mask & b.mask) <= {limit}")
    return near & F.expr("least(a.lo, b.lo) < greatest(a.hi, b.hi)") if grouped else near


def surviving_leaves(leaves: DataFrame, limit: int, keep: Keep = cut) -> DataFrame:
    """Pairs of leaves (a, b), a <= b, of one table whose patterns differ in ``limit`` bits or fewer at every level.

    Where entries have groups, pairs that lie in one group altogether are dropped at the level that shows it.
    """
    levels, differ = _levels(leaves, keep), _differ(limit, bool(_groups(leaves)))
    top = levels[0]
    pairs = top.alias("a").join(top.alias("b"), (F.expr("a.t = b.t") & F.expr("a.parent = b.parent") & F.expr("a.node <= b.node") & differ))
    pairs = pairs.select(F.col("a.t").alias("t"), F.col("a.node").alias("x"), F.col("b.node").alias("y"))
    for level in levels[1:]:
        left = pairs.join(level.alias("a"), (pairs["t"] == F.col("a.t")) & (pairs["x"] == F.col("a.parent")))
        both = left.join(level.alias("b"), (F.col("a.t") == F.col("b.t")) & (pairs["y"] == F.col("b.parent")) & F.expr("a.node <= b.node") & differ)
        pairs = keep(both.select(F.col("a.t").alias("t"), F.col("a.node").alias("x"), F.col("b.node").alias("y")))
    names = levels[-1].select("node", "leaf")
    return (pairs.join(names.withColumnRenamed("leaf", "a"), pairs["x"] == F.col("node")).drop("node")
            .join(names.withColumnRenamed("leaf", "b"), pairs["y"] == F.col("node")).select("t", "a", "b"))


# ---- the search ----------------------------------------------------------------------------------------------------

def _shared(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of runs of SUB entries (the last entry fills up the last run)."""
    fill = np.concatenate([part, np.repeat(part[-1:], -len(part) % SUB)]).reshape(-1, SUB)
    mask = ~np.bitwise_or.reduce(fill ^ fill[:, :1], axis=1)
    return fill, mask


def close_pairs(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All (entry of a, entry of b) that differ in 1 to ``limit`` bits; runs of entries are pruned first."""
    fa, ma = _shared(a)
    fb, mb = _shared(b)
    near = np.bitwise_count((fa[:, 0][:, None] ^ fb[:, 0][None, :]) & ma[:, None] & mb[None, :]) <= limit
    i, j = np.nonzero(near)
    out = []
    for s in range(0, len(i), 1024):
        x, y = fa[i[s:s + 1024]], fb[j[s:s + 1024]]
        differ = np.bitwise_count(x[:, :, None] ^ y[:, None, :])
        k, p, q = np.nonzero((differ <= limit) & (differ > 0))
        out.append((x[k, p], y[k, q]))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (entry, least entry of its component) that connect the same entries as u - v."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = ends[:len(u)], ends[len(u):]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def outermost(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every entry's links, those to its least and its greatest neighbour; one that has more is linked with itself too."""
    x, y = np.unique(np.stack([np.concatenate([u, v]), np.concatenate([v, u])]), axis=1)
    edge = np.flatnonzero(np.diff(x)) + 1
    starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(x)]])
    ends, crowded = np.unique(np.concatenate([starts, stops - 1])), x[starts[stops - starts > 2]]
    return np.concatenate([x[ends], crowded]), np.concatenate([y[ends], crowded])


REDUCED = {"all": lambda u, v: (u, v), "connecting": spanning, "outermost": outermost}


def _search(batches: Iterator[pa.RecordBatch], limit: int, links: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            a, b = (_unpacked(batch.column(c)[i].as_py()) for c in ("ma", "mb"))
            u, v = close_pairs(a, b, limit)
            if not len(u):
                continue
            u, v = REDUCED[links](u, v)
            t = np.full(len(u), batch.column("t")[i].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["t", "u", "v"])


def near_fingerprints(entries: DataFrame, limit: int, links: str = "connecting", keep: Keep = cut) -> DataFrame:
    """Links (t, u, v) between different fingerprints ``fp`` of the same table ``t`` that differ in ``limit`` bits or fewer.

    Each surviving pair of leaves gives links enough to connect what it connects, or all (an entry has a bounded number
    of neighbours, 2,080 at 64 bits and a limit of 2), or every entry's outermost. A pair may appear more than once.
    """
    entries = entries.select("t", "fp").distinct().withColumn("rank", gray_rank(F.col("fp")))
    dealt = entries.repartitionByRange("t", "rank").sortWithinPartitions("t", "rank")
    leaves = keep(dealt.select("t", "fp").mapInArrow(_leaves, "t int, node long, mask long, pattern long, members binary"))
    pairs = surviving_leaves(leaves, limit, keep)
    part = leaves.select("node", "members")
    both = (pairs.join(part.withColumnRenamed("members", "ma"), pairs["a"] == F.col("node")).drop("node")
            .join(part.withColumnRenamed("members", "mb"), pairs["b"] == F.col("node")).select("t", "ma", "mb"))
    return both.mapInArrow(lambda it: _search(it, limit, links), "t int, u long, v long")


#: Longs of a member before its sketch: fingerprint, id, group, where its group stood at the start, and what it asked last.
HEAD = 6
#: Pairs of leaves that a task compares at least, beyond a few tasks to a core.
PAIRS_PER_TASK = 64
#: A distance past all others, for members that ask no more.
DONE = (1 << 31) - 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of entries (t, fp, id, group, start, after_d, after_v, sketch) that come sorted; many entries of one fingerprint fill several."""
    from pyspark import TaskContext
    seq, held = TaskContext.get().partitionId() << 32, None

    def leaf(part: np.ndarray) -> pa.RecordBatch:
        nonlocal seq
        fps = part[:, 1]
        shared = ~np.bitwise_or.reduce(fps ^ fps[0])
        values = [int(part[0, 0]), seq, int(shared), int(fps[0] & shared), int(part[:, 3].min()), int(part[:, 3].max()), np.ascontiguousarray(part[:, 1:]).tobytes()]
        seq += 1
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["t", "node", "mask", "pattern", "lo", "hi", "members"])

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "fp", "id", "group", "start", "after_d", "after_v")], axis=1)
        rows = np.hstack([rows, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int64).reshape(len(rows), -1)])
        have = rows if held is None else np.concatenate([held, rows])
        parts = [p[i:i + LEAF] for p in np.split(have, np.flatnonzero(np.diff(have[:, 0])) + 1) for i in range(0, len(p), LEAF)]
        held = parts.pop()
        yield from map(leaf, parts)
    if held is not None:
        yield leaf(held)


def _nearest_in(a: np.ndarray, b: np.ndarray, limit: int, far: int, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, d) between two leaves: for every member, its ``most`` nearest of groups that stood after its own, from where it stopped."""
    i, j = np.nonzero((np.bitwise_count((a[:, 0][:, None] ^ b[:, 0][None, :]).view(np.uint64)) <= limit) & (a[:, 2][:, None] != b[:, 2][None, :]))
    ask = a[i, 3] < b[j, 3]
    on = np.where(ask, a[i, 4], b[j, 4]) < DONE
    i, j, ask, out = i[on], j[on], ask[on], []
    for s in range(0, len(i), 1 << 15):
        e = slice(s, s + (1 << 15))
        x, y, first = a[i[e]], b[j[e]], ask[e, None]
        d, good = _distances(x[:, HEAD:], y[:, HEAD:], far, similarity)
        u, v = np.where(first, x[:, :HEAD], y[:, :HEAD]), np.where(first, y[:, :HEAD], x[:, :HEAD])
        new = good & ((d > u[:, 4]) | ((d == u[:, 4]) & (v[:, 1] > u[:, 5])))
        out.append(np.stack([u[new, 1], d[new], v[new, 1]]))
    found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((3, 0), np.int64)  # in order of (u, d, v)
    first = np.flatnonzero(np.diff(found[0], prepend=-1))
    keep = np.arange(found.shape[1]) - np.repeat(first, np.diff(first, append=found.shape[1])) < most
    return found[0, keep], found[2, keep], found[1, keep]


def _asked(batches: Iterator[pa.RecordBatch], limit: int, far: int, similarity: float, most: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ma, mb in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True):
            u, v, d = _nearest_in(*(np.frombuffer(m, np.int64).reshape(-1, width) for m in (ma, mb)), limit, far, similarity, most)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d, pa.int32())], names=["u", "v", "d"])


def nearest_crossing(entries: DataFrame, roots: DataFrame, after: DataFrame, most: int, limit: int, far: int, similarity: float, words: int, keep: Keep) -> DataFrame:
    """(u, v, d) of entries (t, fp, id, start, sketch) that meet in a table and are in two groups: for each u its ``most`` nearest.

    Of two groups, the members of the one with the lesser ``start`` ask. That never changes, so every pair has one that asks
    for it in every round. Sketches travel with the leaves: distances are taken, and cut down to ``most``, inside the tasks.
    """
    order = ["t", "rank", "group", "id"]
    if after is None:
        placed = asking(entries, None)
    else:  # who doesn't ask any more stays to be found
        placed = entries.join(after.withColumnRenamed("u", "id"), "id", "left").withColumns({"after_d": F.coalesce("after_d", F.lit(DONE)), "after_v": F.coalesce("after_v", F.lit(-1).cast("long"))})
    grouped = placed.join(roots.toDF("id", "group"), "id", "left").select(
        "t", "fp", "id", F.coalesce("group", "id").alias("group"), "start", "after_d", "after_v", "sketch", gray_rank(F.col("fp")).alias("rank"))
    dealt = grouped.repartitionByRange(*order).sortWithinPartitions(*order).drop("rank")
    leaves = keep(dealt.mapInArrow(_blocks, "t int, node long, mask long, pattern long, lo long, hi long, members binary"))
    pairs, part = keep(surviving_leaves(leaves, limit, keep)), leaves.select("node", "members")
    both = (pairs.join(part.withColumnRenamed("members", "ma"), pairs["a"] == F.col("node")).drop("node")
            .join(part.withColumnRenamed("members", "mb"), pairs["b"] == F.col("node")).select("ma", "mb"))
    # a leaf with very many pairs is split, in as many tasks as there are pairs to compare
    both = both.coalesce(max(4 * leaves.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS_PER_TASK))
    found = both.mapInArrow(lambda it: _asked(it, limit, far, similarity, most, HEAD + words + BITS // 64 + 1), "u long, v long, d int").distinct()
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))  # cut before the shuffle
    return found.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def groups(docs: DataFrame, size: int = 3, limit: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the least ``doc_id`` reachable."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), size))
    entries = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_fingerprints(entries.select(F.lit(0).alias("t"), "fp"), limit).select("u", "v"))
    rooted = entries.join(roots, entries["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))).drop("fp")


# ---- near duplicates by similarity ---------------------------------------------------------------------------------

def angle_share(similarity: float) -> float:
    """Share of SimHash bits in which two texts of that Jaccard similarity (and equal size) differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(n: int, similarity: float, limit: int, miss: float) -> tuple[int, int]:
    """(bits of a table's fingerprints, number of tables) for n texts.

    Bits grow with the logarithm of n, so that a text has few chance neighbours at any n; there are as many tables as
    keep the chance to meet in none, at the least similarity, below ``miss``.
    """
    p = angle_share(similarity)
    bits = min(64, max(16, math.ceil(math.log2(n + 1)) + 11))
    meet = sum(math.comb(bits, d) * p ** d * (1 - p) ** (bits - d) for d in range(limit + 1))
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 x words bits: every word mixes the shingles' hashes anew."""
    counts = np.zeros((words, 64), np.int64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1 << 13):
            part = hashes[i:i + (1 << 13)]
            for w in range(words):
                z = part + np.uint64(w + 1) * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                counts[w] += np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes))


def _sketched(batches: Iterator[pa.RecordBatch], size: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # of the set of shingles, as the Jaccard similarity is
        sets = [np.unique(shingle_hashes(t.as_py() or b"", size)) for t in batch.column("text").cast(pa.binary())]
        # the bits of the tables, then the parities that tell how far two sets are apart, then the set's size
        out = [sketch(s, words).tobytes() + odd_sketch(s).tobytes() + len(s).to_bytes(8, "little") for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, pa.binary())], names=["doc_id", "text_key", "sketch"])


def _dealt(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(t, fp, id): table t has the bits from t x bits on."""
    for batch in batches:
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            flat = np.unpackbits(np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(part), -1), axis=1)
            own = np.zeros((len(part), tables, 64), np.uint8)
            own[:, :, 64 - bits:] = flat[:, :bits * tables].reshape(len(part), tables, bits)
            fp = np.packbits(own, axis=2).reshape(-1, 8).view(">u8").ravel().astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(fp),
                                              pa.array(np.repeat(part.column("id").to_numpy(), tables))], names=["t", "fp", "id"])


def jaccard(a: bytes, b: bytes, size: int) -> float:
    """Of the sets of shingles; two texts without words are alike."""
    x, y = (np.unique(shingle_hashes(t, size)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _verified(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("ta", "tb"))
        good = [jaccard(x or b"", y or b"", size) >= similarity for x, y in zip(a, b, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, limit: int = 2, miss: float = 0.02) -> DataFrame:
    """(doc_id, text_key, copies, root) of the different texts, with their least doc_id, the number of rows that have
    them and their group; ``stays`` marks the one with the least doc_id.

    Texts are sketched by SimHash bits; several tables of fingerprints are searched through the index; pairs that meet
    in one are compared by their whole sketches and, if these come near, by the Jaccard similarity of their shingle sets.
    First come pairs between the least text of each fingerprint and the others of it or the least of a near one. Then,
    wherever that left pairs out, texts ask for their nearest sketches of other groups among all they meet, a few a round,
    until no pair that meets lies between two groups.
    """
    scratch = Scratch(docs.sparkSession, "near")
    keep = scratch.store
    n = docs.count()
    bits, tables = tables_for(n, similarity, limit, miss)
    words = max(10, -(-bits * tables // 64))
    keyed = docs.select("doc_id", F.md5(text_of()).alias("text_key"), "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("first")
    thin = keyed.mapInArrow(lambda it: _sketched(it, size, words), "doc_id long, text_key string, sketch binary")
    same = thin.groupBy("text_key").agg(first, F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    entries = keep(same.withColumn("id", F.monotonically_increasing_id()))
    dealt = keep(entries.select("id", "sketch").mapInArrow(lambda it: _dealt(it, bits, tables), "t int, fp long, id long"))
    least = keep(dealt.groupBy("t", "fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    links = keep(near_fingerprints(least.select("t", "fp"), limit, "outermost", keep))
    inside = dealt.join(least, ["t", "fp"]).filter(F.col("id") != F.col("least")).select(F.col("id").alias("u"), F.col("least").alias("v"))
    ends = least.select("t", F.col("fp").alias("f"), "least")
    across = links.filter("u <> v")
    across = (across.join(ends, (across["t"] == ends["t"]) & (across["u"] == ends["f"])).select(across["t"], F.col("v").alias("w"), F.col("least").alias("a")))
    across = across.join(ends, (across["t"] == ends["t"]) & (across["w"] == ends["f"])).select(F.greatest("a", "least").alias("u"), F.least("a", "least").alias("v"))

    sketches = entries.select("id", F.col("sketch").alias("s"))
    far = math.ceil(64 * words * min(0.5, angle_share(similarity) + 0.05))
    pairs = inside.unionByName(across).distinct()
    compared = (pairs.join(sketches.withColumnRenamed("s", "su"), pairs["u"] == F.col("id")).drop("id")
                .join(sketches.withColumnRenamed("s", "sv"), pairs["v"] == F.col("id")).drop("id"))
    near = keep(compared.mapInArrow(lambda it: _near(it, far, similarity), "u long, v long, d int"))

    def alike(pairs: DataFrame) -> DataFrame:
        wanted = keep(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(entries.select("id", "text_key"), "id"))
        texts = keep(maybe_in(keyed.select("text_key", "text"), wanted, "text_key").filter("maybe").drop("maybe").join(wanted, "text_key").groupBy("id").agg(F.first("text").alias("text")))
        beside = (pairs.join(texts.withColumnRenamed("text", "ta"), pairs["u"] == F.col("id")).drop("id")
                  .join(texts.withColumnRenamed("text", "tb"), pairs["v"] == F.col("id")).drop("id"))
        good = keep(beside.mapInArrow(lambda it: _verified(it, size, similarity), "u long, v long"))
        scratch.drop(wanted, texts)
        return good

    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = merged_in_rounds(lambda roots, after, most: crossing(near, roots, after, most), alike, roots, scratch, 64)
    # pairs were left out only within a fingerprint of several texts, between it and its neighbours, and between crowded ones
    several = least.filter("n > 1").select("t", F.col("fp").alias("u"))
    both = links.filter("u <> v").unionByName(links.filter("u <> v").select("t", F.col("v").alias("u"), F.col("u").alias("v")))
    open_ = several.unionByName(both.join(several, ["t", "u"]).select("t", F.col("v").alias("u"))).unionByName(links.filter("u = v").select("t", "u"))
    grouped = entries.select("id", "sketch").join(roots.toDF("id", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("n", "group").sortWithinPartitions("n", "group")
    stands = keep(sizes.select("group", F.monotonically_increasing_id().alias("start")))
    asked = keep(dealt.join(open_.distinct().withColumnRenamed("u", "fp"), ["t", "fp"]).join(grouped.join(stands, "group").select("id", "start", "sketch"), "id"))
    scratch.drop(dealt, least, links, near, stands)
    roots = merged_in_rounds(lambda roots, after, most: nearest_crossing(asked, roots, after, most, limit, far, similarity, words, keep), alike, roots, scratch, 4)
    named = entries.join(roots, entries["id"] == roots["node"], "left").select("text_key", "copies", "first", F.coalesce("root", "id").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct("first", "text_key")).alias("best"))
    return scratch.result(named.join(best, "root").select(F.col("first.doc_id").alias("doc_id"), "text_key", "copies", "root", (F.col("text_key") == F.col("best.text_key")).alias("stays")))


def _distances(a: np.ndarray, b: np.ndarray, far: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Differing table bits of sketches (rows of longs), and whether bits, parities and sizes allow the similarity."""
    x, odd = (a ^ b).view(np.uint64), -1 - BITS // 64
    d = np.bitwise_count(x[:, :odd]).sum(1).astype(np.int64)
    apart = np.bitwise_count(x[:, odd:-1]).sum(1)
    return d, (d <= far) & (apart <= odd_limit(a[:, -1] + b[:, -1], 100 * similarity))


def _near(batches: Iterator[pa.RecordBatch], far: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(len(batch), -1) for c in ("su", "sv"))
            d, good = _distances(a, b, far, similarity)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(d.astype(np.int32))], names=["u", "v", "d"]).filter(pa.array(good))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """For the pipeline: of each group of near duplicates, the document with the least id; repeated rows count once."""
    marked = near_duplicates(docs, **options)
    kept = marked.filter("stays").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
    keyed = docs.withColumn("__text_key", F.md5(text_of()))
    # a text that stays and stands in one row only needs no join
    doubtful = marked.filter("not stays or copies > 1").select(F.col("text_key").alias("__text_key"))
    keyed = maybe_in(keyed, doubtful, "__text_key").withColumnRenamed("maybe", "__maybe")
    clear, asked = keyed.filter("not __maybe"), keyed.filter("__maybe")
    chosen = asked.join(kept, asked["doc_id"].eqNullSafe(kept["__doc"]) & (asked["__text_key"] == kept["__key"]), "left_semi")
    return clear.unionByName(chosen.dropDuplicates(["doc_id", "__text_key"])).select(*docs.columns)
