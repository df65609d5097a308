"""MinHash near-duplicate groups: universal hash minima, banding, verification, connected components.

A document is the set of its shingles. Each of ``HASHES`` universal hash functions gives the least value of the set; the
share of equal minima estimates the Jaccard similarity of two sets. The minima are cut into bands of ``ROWS``; sets that
agree in a whole band meet in its bucket. Pairs that meet are compared by their sizes, by their signatures (one byte of each
minimum) and by their odd sketches (the parity of the hashes in each of ``BITS`` cells, whose Hamming distance tells how many
shingles only one of two sets has), then exactly by their full sets; verified pairs go to alternating large-star and
small-star rounds.

Equal sets are one entry, so copies cost nothing. A bucket doesn't give all its pairs. First every entry is compared with
the bucket's least one. Then, in buckets that hold several groups still, every entry outside the bucket's largest group
asks for its nearest entries of other groups there, in parts of bounded size; what is verified joins groups, the others
ask on from where they stopped, until no pair that meets in a bucket and may be alike lies between two groups. So the
pairs of a round are a small number per entry, and no pair that meets is left out. A pair at a similarity of 0.85 meets
in no bucket with a probability of 1e-8.

Defined results: null and empty texts, and texts without words, have an empty set, size 0, and are components of their
own; a text of fewer words than a shingle is one shingle. Rows with a null ``doc_id`` take part: their component is the
least id reachable, null if there is none. ``kept`` compares null with null as equal. Repeated rows are one entry and get
the same result. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanframe.llm.common import Scratch, cut, text_of
from scanframe.llm.links import crossing, maybe_in, merged_in_rounds

SIZE, PERCENT = 5, 85
ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
BITS = 2048
SKETCH = HASHES + BITS // 8
#: Signatures that differ in more places are not compared exactly: six deviations beyond what the least similarity gives.
FAR = int(HASHES * (1 - PERCENT / 100) + 6 * (HASHES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5) + 1
#: Entries of a bucket that a task compares with the asking ones.
PART = 2048
_SEED = np.random.default_rng(20)
MULTIPLIERS = _SEED.integers(1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _SEED.integers(1 << 63, size=HASHES, dtype=np.uint64)
BAND_FACTORS = _SEED.integers(1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = _SEED.integers(1 << 63, size=BANDS, dtype=np.uint64)


# ---- one text ----------------------------------------------------------------------------------------------------------

def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The set of shingles as rising 64-bit hashes."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(np.array([xxh64_intdigest(b" ".join(s)) for s in zip(*[words[i:] for i in range(size)], strict=False)], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of every universal hash function (multiply, add, upper half of 64 bits) over a set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 128):
            np.minimum(least, (MULTIPLIERS[:, None] * hashes[None, i:i + 128] + ADDENDS[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes in each of ``BITS`` cells, as bytes."""
    return np.packbits(np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1)


def odd_limit(shingles_of_both: np.ndarray, percent: float = PERCENT) -> np.ndarray:
    """Hamming distance that the odd sketches of a pair at the least similarity exceed once in a billion, from the sum of their sizes."""
    only_one = shingles_of_both * (100 - percent) / (100 + percent)
    two, four = only_one * np.log1p(-2 / BITS), only_one * np.log1p(-4 / BITS)
    mean = -BITS / 2 * np.expm1(two)
    variance = -BITS / 4 * np.expm1(2 * two) + BITS * (BITS - 1) / 4 * (np.exp(four) - np.exp(2 * two))
    return mean + 6 * np.sqrt(np.maximum(variance, 0)) + 3


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, HASHES) minima; the band is part of the key."""
    with np.errstate(over="ignore"):
        return (signatures.reshape(-1, BANDS, ROWS).astype(np.uint64) * BAND_FACTORS).sum(2, dtype=np.uint64) + BAND_SALTS


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


# ---- tasks -------------------------------------------------------------------------------------------------------------

def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts: what a task holds besides its batch stays small."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets too small to have a similar one that differs (6 of 7 shingles are the fewest) get no keys."""
    for batch in _slices(batches):
        sets = [shingles(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        large = [len(s) * (100 - PERCENT) >= PERCENT for s in sets]
        signatures = np.array([minima(s) if x else np.zeros(HASHES, np.uint32) for s, x in zip(sets, large, strict=True)], np.uint32).reshape(-1, HASHES)
        keys = band_keys(signatures).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([k if x else None for k, x in zip(keys, large, strict=True)], pa.list_(pa.int64())),
             pa.array([m.tobytes() + odd_sketch(s).tobytes() for m, s in zip(signatures.astype(np.uint8), sets, strict=True)], pa.binary())],
            names=["doc_id", "text_key", "set_key", "n_shingles", "keys", "signature"])


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def compared(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of the odd sketches, and whether sizes, signatures and these allow the similarity (arrays, or one of a side)."""
    d = np.bitwise_count(a[..., HASHES:] ^ b[..., HASHES:]).sum(-1, dtype=np.int32)
    fit = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
    return d, fit & (d <= odd_limit(na + nb)) & ((a[..., :HASHES] != b[..., :HASHES]).sum(-1) <= FAR)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) that may be similar, with the distance d of their odd sketches."""
    for batch in _slices(batches, 4096):
        d, good = compared(_bytes(batch.column("su")), batch.column("nu").to_numpy(), _bytes(batch.column("sv")), batch.column("nv").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(d)], names=["u", "v", "d"]).filter(pa.array(good))


def _asked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and part, a part's own entries before those that ask; ``most`` answers to each that asks.

    A pair counts in the first band that it shares only: in its bucket there one of the two asks, in this round or before.
    One part and one batch are held at a time.
    """
    place, own = None, []

    def answers(ask: pa.RecordBatch) -> pa.RecordBatch:
        n, group, ids, s = (np.concatenate([o[k] for o in own]) for k in range(4))
        column = {c: ask.column(c).to_numpy(zero_copy_only=False) for c in ("id", "band", "group", "n_shingles", "after_d", "after_v")}
        signatures = _bytes(ask.column("signature"))
        us, vs, ds = [], [], []
        for i in range(len(ask)):
            other = np.flatnonzero(group != column["group"][i])
            d, good = compared(s[other], n[other], signatures[i], column["n_shingles"][i])
            v = ids[other]
            on = np.flatnonzero(good & ((d > column["after_d"][i]) | ((d == column["after_d"][i]) & (v > column["after_v"][i]))))
            shared = (s[other[on], :HASHES].reshape(-1, BANDS, ROWS) == signatures[i, :HASHES].reshape(BANDS, ROWS)).all(2)
            on = on[shared.argmax(1) == column["band"][i]]
            on = on[np.lexsort((v[on], d[on]))[:most]]
            us.append(np.full(len(on), column["id"][i]))
            vs.append(v[on])
            ds.append(d[on])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ds), pa.int32())], names=["u", "v", "d"])

    for batch in batches:
        if not len(batch):
            continue
        key, part, asks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "part", "asks"))
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
        for start, stop in zip([0, *edges], [*edges, len(batch)], strict=True):
            rows = batch.slice(start, stop - start)
            if (key[start], part[start]) != place:
                place, own = (key[start], part[start]), []
            if not asks[start]:
                own.append((rows.column("n_shingles").to_numpy(), rows.column("group").to_numpy(), rows.column("id").to_numpy(), _bytes(rows.column("signature"))))
            elif own:
                yield answers(rows)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exactly, by full sets. Rows with one v mostly come together; its set is made once then."""
    last, made = None, None
    for batch in _slices(batches, 256):
        good = []
        for v, a, b in zip(batch.column("v").to_pylist(), batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist(), strict=True):
            if v != last:
                last, made = v, shingles(b)
            good.append(alike(shingles(a), made))
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


# ---- the corpus --------------------------------------------------------------------------------------------------------

def _entries(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, set_key, n_shingles), and the different sets that have shingles with an ``id``."""
    rows = docs.select("doc_id", F.md5(text_of()).alias("text_key"), "text").mapInArrow(
        _signed, "doc_id long, text_key string, set_key binary, n_shingles long, keys array<long>, signature binary")
    signed = scratch.store(rows)
    sets = signed.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("signature").alias("signature"))
    return signed.select("doc_id", "set_key", "n_shingles"), scratch.store(sets.withColumn("id", F.monotonically_increasing_id()))


def _members(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, band, id, least, several) of the buckets that hold two entries or more."""
    rows = sets.select("id", F.posexplode("keys").alias("band", "key"))
    shared = scratch.store(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return scratch.store(rows.join(shared, "key").select("key", "band", "id", "least", (F.col("n") > 2).alias("several")))


def _first_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Every entry with the least one of each of its buckets, as (u, v, d), those too far apart left out."""
    pairs = members.filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    side = sets.select("id", "n_shingles", "signature")
    both = (pairs.join(side.toDF("u", "nu", "su"), "u").join(side.toDF("v", "nv", "sv"), "v"))
    return both.mapInArrow(_compared, "u long, v long, d int")


def _open(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, band, id, anchor, parts, n_shingles, signature) of the buckets of three entries or more that hold several groups.

    The anchor is an entry of the bucket's largest group. It stays, whatever groups merge: who doesn't ask in a bucket is
    in the anchor's group, so who asks now has asked there in every round before.
    """
    grouped = members.filter("several").select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("group"))
    sizes = grouped.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    found = sizes.groupBy("key").agg(F.max_by("first", F.struct("n", "first")).alias("anchor"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    found = cut(found.filter("groups > 1").select("key", "anchor", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    return members.select("key", "band", "id").join(found, "key").join(sets.select("id", "n_shingles", "signature"), "id")


def _nearest(buckets: DataFrame, roots: DataFrame, after: DataFrame | None, most: int) -> DataFrame:
    """(u, v, d): for entries that are not in the group of a bucket's anchor, their ``most`` nearest of other groups, over all buckets."""
    known = roots.toDF("id", "group")
    if after is None:
        placed, known = buckets, known.withColumns({"after_d": F.lit(-1), "after_v": F.lit(-1).cast("long")})
    else:  # buckets in which nobody asks any more stay out
        keys = buckets.select("key", F.col("id").alias("u")).join(after.select("u"), "u", "left_semi").select("key").distinct()
        placed, known = buckets.join(keys, "key", "left_semi"), known.join(after.withColumnRenamed("u", "id"), "id", "full")
    grouped = placed.join(known, "id", "left").join(roots.toDF("anchor", "main"), "anchor", "left").withColumns(
        {"group": F.coalesce("group", "id"), "main": F.coalesce("main", "anchor"), "on": F.lit(True) if after is None else F.col("after_d").isNotNull()})
    # an entry lies in one part of its bucket, and asks in all of them
    own = F.array(F.struct(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: F.struct(part.alias("part"), F.lit(True).alias("asks")))
    rows = grouped.withColumn("at", F.explode(F.when(F.col("on") & (F.col("group") != F.col("main")), F.concat(own, asks)).otherwise(own)))
    dealt = rows.select("key", "at.part", "at.asks", "id", "band", "group", "n_shingles", "signature", F.coalesce("after_d", F.lit(-1)).alias("after_d"),
                        F.coalesce("after_v", F.lit(-1).cast("long")).alias("after_v")).repartition("key", "part").sortWithinPartitions("key", "part", "asks")
    found = dealt.mapInArrow(lambda it: _asked(it, most), "u long, v long, d int").distinct()
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))  # cut before the shuffle
    return found.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, sets = _entries(docs, scratch)
    members = _members(sets, scratch)
    first = scratch.store(_first_pairs(members, sets))
    keyed = docs.select(F.md5(text_of()).alias("text_key"), "text")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = scratch.store(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(sets.select("id", "text_key"), "id"))
        texts = scratch.store(maybe_in(keyed, wanted, "text_key").filter("maybe").drop("maybe").join(wanted, "text_key").groupBy("id").agg(F.first("text").alias("text")))
        both = pairs.join(texts.toDF("u", "ta"), "u").join(texts.toDF("v", "tb"), "v")
        good = scratch.store(both.mapInArrow(_verified, "u long, v long"))
        scratch.drop(wanted, texts)
        return good

    none = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = merged_in_rounds(lambda roots, after, most: crossing(first, roots, after, most), verified, none, scratch, BANDS)
    buckets = scratch.store(_open(members, sets, roots))
    scratch.drop(members, first)
    roots = merged_in_rounds(lambda roots, after, most: _nearest(buckets, roots, after, most), verified, roots, scratch, BANDS)
    named = sets.join(roots, sets["id"] == roots["node"], "left").select("set_key", F.coalesce("root", "id").alias("root"), "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = scratch.store(named.join(least, "root").select("set_key", "component_id"))
    out = rows.join(found, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return scratch.result(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
