"""The ten operators against plain versions, on small documents with null, empty, long, tied and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_fixtures import CLASHES, LABEL_SCHEMA, LABELS, SCHEMA, documents, rows, sentence, table_dir

from scanframe.llm import avi, lines, packing, pieces, pitman_yor, quality, queries, secrets, simhash, training_order, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


PAGES = [(1, "http://a/x y", "<p>one</p>"), (7, "http://b", "<p>one</p>"), (3, None, None), (4, "u", ""), (None, "http://n", "<p>one</p>"),
         (None, "http://n", "null id"), (5, "http://c", "é" * 5000), (9, "http://d", "twice"), (9, "http://d", "twice"),
         *[(i, f"http://{i}", f"page {i} " * 50) for i in range(20, 60)]]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    table_dir(spark, path, spark.createDataFrame(PAGES, "page_id long, url string, html string"), "pages")
    table_dir(spark, path, spark.createDataFrame(LABELS, LABEL_SCHEMA), "labels")
    return table_dir(spark, path, documents(spark))


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], LABEL_SCHEMA).write.parquet(f"{path}/labels.parquet")
    return table_dir(spark, path, spark.createDataFrame([], SCHEMA))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    for path in (sf_dir, SF):
        con = duckdb.connect()
        for name_ in ("documents", "pages", "labels"):
            con.execute(f"create view {name_} as select * from '{path}/{name_}.parquet{'/*.parquet' if path == sf_dir else ''}'")
        got = queries.QUERIES[name](spark, path)
        assert collected(got) == sorted(con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall(), key=repr)


# ---- 1 -------------------------------------------------------------------------------------------------------------

def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in linked:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def plain_groups(table):
    fps = [plain_fingerprint(t) for _, t, *_ in table]
    found = plain_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for (doc, *_), g in zip(table, found, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted([(t[0], f"{f:016x}", least.get(g)) for t, f, g in zip(table, fps, found, strict=True)], key=repr)


def test_simhash_groups(spark, sf_dir):
    assert collected(queries.op1_gray_simhash(spark, sf_dir)) == plain_groups(rows())


def test_simhash_index_with_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    r = random.Random(3)
    table = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(queries.op1_gray_simhash(spark, SF)) == plain_groups(table)
    # a dense ball of fingerprints: all links within two bits are found, in two tables apart
    center = r.getrandbits(63)
    fps = sorted({center ^ sum(1 << r.randrange(63) for _ in range(r.randint(0, 3))) for _ in range(300)})
    df = spark.createDataFrame([(t, f) for t in (0, 1) for f in fps], "t int, fp long")
    got = {(x["t"], *sorted((x["u"], x["v"]))) for x in simhash.near_fingerprints(df, 2, "all").collect()}
    assert got == {(t, a, b) for t in (0, 1) for i, b in enumerate(fps) for a in fps[:i] if (a ^ b).bit_count() <= 2}


def test_near_duplicates(spark):
    r = random.Random(11)
    table = []
    for g in range(25):
        words = sentence(r, 150).split()
        table.append(" ".join(words))
        for k in range(3):
            copy = list(words)
            for _ in range(k):
                copy[r.randrange(len(copy))] = f"new{r.random()}"
            table.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(table)] + [r for r in rows() if r[0] != 1], SCHEMA)
    kept = {x["doc_id"] for x in simhash.one_of_each(docs).collect()}
    assert len([i for i in kept if i is not None and i < 100 and i % 4 == 0]) == 25  # the first of each group stays
    got = simhash.near_duplicates(docs).collect()
    sets = {x["text_key"]: None for x in got}
    for t in {x["text"] or "" for x in docs.collect()}:
        sets[hashlib.md5(t.encode()).hexdigest()] = frozenset(simhash.shingle_hashes(t.encode(), 5).tolist())
    keys = sorted(sets)
    alike = [(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys[:i])
             if (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) >= 0.8]
    plain = dict(zip(keys, plain_components(len(keys), alike), strict=True))
    root = {x["text_key"]: x["root"] for x in got}
    found = sum(root[keys[i]] == root[keys[j]] for i, j in alike)
    assert found >= 0.9 * len(alike)
    for g in set(root.values()):
        assert len({plain[k] for k in keys if root[k] == g}) == 1  # nothing is joined that isn't alike
    assert collections.Counter(x["root"] for x in got if x["stays"]) == collections.Counter(set(root.values()))


def test_near_copies_that_only_the_original_joins(spark):
    """Copies are alike to the original (Jaccard 0.84), not to each other (0.71), and it is not the least id."""
    r = random.Random(17)
    words = sentence(r, 300).split()
    copies = []
    for _ in range(1000):
        copy, at = list(words), r.randrange(20)
        for k in range(5):
            copy[at + 55 * k + r.randrange(5, 40)] = f"new{r.random()}"
        copies.append(" ".join(copy))
    table = [*copies[:500], " ".join(words), *copies[500:]]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(table)], SCHEMA)).collect()
    root = {x["doc_id"]: x["root"] for x in got}
    assert len(root) == 1001 and sum(g == root[500] for g in root.values()) >= 980


def test_near_duplicates_that_differ_in_repeats(spark):
    r = random.Random(23)
    body, phrase = sentence(r, 300), sentence(r, 5)
    docs = spark.createDataFrame([(i, f"{body} {' '.join([phrase] * n)}", "en", "a", 1) for i, n in enumerate((1, 40))], SCHEMA)
    assert {x["doc_id"] for x in simhash.one_of_each(docs).collect()} == {0}


# ---- 2, 3, 9 -------------------------------------------------------------------------------------------------------

def test_line_runs_of_several_lines(spark):
    r = random.Random(5)
    run = [sentence(r, 9) for _ in range(20)]
    table = [(1, "\n".join(run)), (2, "\n".join(["own " + sentence(r, 60), *run[3:12], "", *run[12:15], "tail"])), (3, "\n".join(run[5:9])),
             (4, "\n".join(["again again"] * 100)), (5, "\n".join(run)), (5, "\n".join(run))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in table], SCHEMA)
    got = {(x["own"]["doc_id"]): (x["deleted"], x["text"]) for x in lines.without_copies(docs).collect()}
    assert got[1][0] is None and got[3][0] is None  # 36 words are too few
    assert got[2][0] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13] and got[2][1].endswith("\n\ntail")
    assert got[4][0] == list(range(1, 100))
    assert got[5] == (list(range(20)), "")
    assert lines.dedup(docs).filter("doc_id = 5").select("n_chars").distinct().collect()[0][0] == 0


def test_line_runs_are_found_to_their_end(spark):
    r = random.Random(29)
    table = []
    for lengths in ((60, 3, 5), (30, 30, 10), (2, 49, 1, 1)):
        run = [sentence(r, n) for n in lengths]
        table += [[*run, "own " + sentence(r, 9)], ["more " + sentence(r, 9), *run, "after " + sentence(r, 3)]]
    docs = spark.createDataFrame([(i, "\n".join(t), "en", "a", 1) for i, t in enumerate(table)], SCHEMA)
    got = {x["own"]["doc_id"]: x["deleted"] for x in lines.without_copies(docs).collect()}
    assert got == {0: None, 1: [1, 2, 3], 2: None, 3: [1, 2, 3], 4: None, 5: [1, 2, 3, 4]}


def plain_spans(text):
    out = []
    for k, (name, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return sorted(out)


def test_secrets(spark, sf_dir):
    for path, table in ((sf_dir, rows()), (SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])):
        got = sorted([(r[0], r[1], r[2], r[3], r[4]) for r in queries.op3_markov_secrets(spark, path).collect()], key=repr)
        want = []
        for doc, text, *_ in table:
            found = plain_spans(text)
            n = collections.Counter(f[3] for f in found)
            joined = ",".join(f"{f[3]}:{f[0]}:{f[2]}" for f in found)
            want.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_secret_models(spark):
    r = random.Random(2)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    text = [f"{sentence(r, 40)} token = {key(32)} {sentence(r, 5)}" for _ in range(60)] + [sentence(r, 200) for _ in range(60)]
    hidden, ordinary = key(26) + "9z", "abcabfed_1_" + sentence(r, 3).replace(" ", "_")
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate([*text, f"see {hidden} there", f"see {ordinary} there"])], SCHEMA)
    got = {x["doc_id"]: x["added"] for x in secrets.scan(docs).collect()}
    assert [(s["s"], s["e"]) for s in got[120]] == [(4, 32)] and not got[121]
    assert {x["doc_id"]: x["text"] for x in secrets.redact(docs).collect()}[120] == "see [secret] there"


def test_quality_keeps_plain_text(spark):
    r = random.Random(4)
    table = [(i, sentence(r, 120), "en", "a", 1) for i in range(80)] + [(90, " ".join(w + "***" for w in sentence(r, 120).split()), "en", "a", 1)]
    got = {x["doc_id"]: x["kept"] for x in quality.verdicts(spark.createDataFrame(table, SCHEMA)).collect()}
    assert not got.pop(90) and all(got.values())
    # sketches merge by adding
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 123456789]
    b = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v long").select(quality.value(quality.bucket(quality.F.col("v")))).collect()]
    assert all(0 <= v - x <= v / 32 for v, x in zip(values, b, strict=True))


# ---- 5, 8 ----------------------------------------------------------------------------------------------------------

def check_packing(table, got):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    want = collections.Counter()
    for doc, text, *_ in table:
        want[doc, (*lib.encode(text or "", add_special_tokens=False).ids, 2)] += 1
    filled = collections.defaultdict(list)
    for p in got:
        filled[p.sequence_id].append((p.offset, p.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)  # nothing is padded
    covered = collections.Counter()
    for p in got:
        covered[p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32] += 1
    assert sum(p.length for p in got) == sum(len(ids) * n for (_, ids), n in want.items())
    by_doc = collections.defaultdict(list)
    for (doc, ids), _ in want.items():
        by_doc[doc, len(ids)].append(np.array(ids, "<u4"))
    for doc, tokens, start, length, crc in covered:
        assert any(zlib.crc32(ids[start:start + length].tobytes()) == crc for ids in by_doc[doc, tokens])


def test_packing(spark, sf_dir, monkeypatch):
    check_packing(rows(), queries.op5_cost_packing(spark, sf_dir).collect())
    monkeypatch.setattr(packing, "TASK_CHARS", 1 << 14)
    check_packing([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], queries.op5_cost_packing(spark, SF).collect())


def test_feistel_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        index = np.arange(n)
        got = training_order.slots(index, n, 5)
        assert sorted(got) == list(range(n)) and (training_order.slots(got, n, 5, back=True) == index).all()
    assert (training_order.slots(np.arange(1000), 1000, 5) != training_order.slots(np.arange(1000), 1000, 6)).any()


def test_training_order(spark, tmp_path):
    from tokenizers import Tokenizer
    file = queries.tokenizer("word_bpe_49k.json")
    lib, docs = Tokenizer.from_file(file), documents(spark).repartition(3)
    uri = f"{tmp_path}/slots"
    manifest = training_order.write(docs, uri, file, key=9, length=64, per_shard=16).collect()
    got = training_order.pieces(spark, uri, per_shard=16).collect()
    every = {r.slot: np.frombuffer(r.ids, "<u2").astype("<u4") for r in training_order.read(spark, uri, per_shard=16).collect()}
    assert sorted(every) == list(range(len(every))) and sum(m.seq == 0 for m in manifest) == -(-len(every) // 16)
    want = collections.Counter()
    for doc, text, *_ in rows():
        want[doc, (*lib.encode(text or "", add_special_tokens=False).ids, 2)] += 1
    parts = collections.defaultdict(list)
    for p in got:
        assert zlib.crc32(every[p.slot][p.offset:p.offset + p.length].tobytes()) == p.ids_crc32
        parts[p.doc_id, p.doc_tokens].append((p.start, tuple(every[p.slot][p.offset:p.offset + p.length].tolist())))
    for (doc, ids), times in want.items():
        mine = collections.Counter(parts[doc, len(ids)])
        for start, piece in mine:
            assert any(piece == other[start:start + len(piece)] for d, other in want if d == doc and len(other) == len(ids))
        assert sum(len(p) * n for (_, p), n in mine.items()) == len(ids) * sum(t for (d, o), t in want.items() if d == doc and len(o) == len(ids)) and times
    resumed = [r.slot for r in training_order.read(spark, uri, 21, 45, per_shard=16).collect()]
    assert sorted(resumed) == list(range(21, 45))
    assert (every[30] == np.frombuffer(training_order.read(spark, uri, 30, 31, per_shard=16).first().ids, "<u2")).all()


def test_placing_fills_every_sequence():
    r = random.Random(1)
    for n in (0, 1, 7, 300):
        lengths = sorted((r.randint(1, 63) for _ in range(n)), reverse=True)
        placed = packing.place(lengths, 64)
        assert [sum(p[1] for p in pieces_) for pieces_ in placed] == lengths
        used = collections.Counter()
        for pieces_ in placed:
            for _, m, s, offset in pieces_:
                assert offset == used[s]
                used[s] += m
        assert all(u & (u - 1) == 0 for u in used.values())
    # equal room, balanced cost: one long document and short ones are not put together when they need not be
    assert packing.cost(64) > 2 * packing.cost(32)


def test_pieces(spark, sf_dir):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = []
    for doc, text, *_ in rows():
        ids = lib.encode(text or "", add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert collected(queries.op8_distinct_chunks(spark, sf_dir)) == sorted(want, key=repr)
    model = queries.tokenizer("piece_bpe_32k.model")
    encoded = pieces.encode(documents(spark), model)
    assert all(r["ids"] == lib.encode(r["text"] or "", add_eos=True) for r in encoded.collect())
    assert all(r["decoded"] == lib.decode(lib.encode(r["text"] or "")) for r in pieces.decode(encoded, model).collect())


# ---- 6, 7 ----------------------------------------------------------------------------------------------------------

def test_warc(spark, tmp_path):
    pages = PAGES
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    largest = {}
    for page, _, html in pages:
        largest[sha(html)] = max(page if page is not None else -1, largest.get(sha(html), -1))
    want = []
    for page, _, html in pages:
        first = largest[sha(html)]
        revisit = first >= 0 and page != first
        want.append((page, len((html or "").encode()), sha(html), "revisit" if revisit else "response", first if revisit else None))
    files = []
    for run in ("one", "two"):
        manifest = warc.write(df, f"{tmp_path}/{run}", shard_bytes=2000, roll_bytes=900).collect()
        assert len({m.shard for m in manifest}) > 3 and any(m.seq for m in manifest)
        assert all(hashlib.sha256((tmp_path / run / m.name).read_bytes()).hexdigest() == m.sha256 for m in manifest)
        files.append({(m.name, m.sha256) for m in manifest})
        read = warc.read(spark, f"{tmp_path}/{run}")
        assert collected(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sorted(want, key=repr)
        assert {bytes(r.payload).decode() for r in read.filter("record_type = 'response'").collect()} == {h or "" for _, _, h in pages}
    assert files[0] == files[1]  # the same bytes wherever it runs
    assert warc.write(df, f"{tmp_path}/long", revisit_from=1).count() == 1
    kinds = {r.page_id: r.record_type for r in warc.read(spark, f"{tmp_path}/long").collect()}
    assert kinds[3] == kinds[4] == "response" and kinds[1] == "revisit"


def test_avi_round_trip(spark, sf_dir):
    want = []
    for doc, text, *_ in rows():
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = queries.op7_avi_clips(spark, sf_dir).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    r = np.random.default_rng(1)
    for n in (0, 1, 64, 65, 4097, 50000):
        data = r.integers(0, 256, n, dtype=np.uint8).tobytes()  # any byte, 0xFF too
        (frames, _, stored), = avi.decode([avi.write_avi(data)])
        assert avi.stored_bytes(frames, stored) == avi.payload_of(data)


def test_avi_shots_and_other_media(spark):
    quiet, loud = bytes([10] * 4096), bytes([200] * 4096)
    data = quiet * 6 + loud * 5 + quiet * 3
    df = spark.createDataFrame([(1, bytearray(avi.write_avi(data)), 5), (2, None, 6), (3, bytearray(b"no media"), 7)], "doc_id long, media binary, clip int")
    got = [tuple(r) for r in avi.clips(df).orderBy("doc_id", "first_frame").collect()]
    assert got == [(1, 0, 0, 5, 0, 240, 0), (1, 1, 6, 10, 240, 440, 2000), (1, 2, 11, 13, 440, 560, 2000)]
    (frames, _, _), = avi.decode([avi.write_avi(data)])
    assert len(frames) == 14


def test_baseline_decoder_reads_variable_codes():
    """One interval of two blocks with predicted DC, runs of zeros and an early end, in tables of other lengths."""
    dc = bytes([0, 2, 1] + [0] * 13) + bytes([2, 3, 0])  # codes 00: 2 bits, 01: 3 bits, 100: 0 bits
    ac = bytes([0, 1, 2, 1] + [0] * 12) + bytes([0x01, 0x00, 0xF0, 0x12])  # 00: 1 bit, 010: end, 011: 16 zeros, 1000: a zero, 2 bits
    bits = "01" "101" + "00" "1" + "011" + "1000" "01" + "010" + "00" "01" + "00" "0" + "010"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = avi._segment
    head = (b"\xff\xd8" + seg(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00") + seg(0xC4, b"\x00" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00"))
    first, second = avi.Scan(avi._head(head)).coefficients([scan])[0]
    want = np.zeros((2, 64), int)
    want[0, 0], want[0, 1], want[0, 19] = 5, 1, -2
    want[1, 0], want[1, 1] = 3, -1
    assert (np.stack([first, second]) == want).all()


# ---- 10 ------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shares", [None, (1e-2, 2e-2)])
def test_language_model(spark, sf_dir, monkeypatch, shares):
    if shares:  # most words are rare then, and joined
        monkeypatch.setattr(pitman_yor, "TABLE_SHARE", shares[0])
        monkeypatch.setattr(pitman_yor, "SYMBOL_SHARE", shares[1])
    for path, table in ((sf_dir, rows()), (SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])):
        counts, tokens = collections.Counter(), []
        for doc, text, *_ in table:
            held = zlib.crc32(str(doc).encode() if doc is not None else b"") % 5 == 1
            words = [*(text or "").encode().lower().split(), b"\n"]
            tokens.append((doc, held, words))
            if not held:
                counts.update(words)
        n, v = sum(counts.values()), len(counts)
        got = collected(queries.op10_pitman_yor(spark, path).drop("score"))
        base = [(d, h, len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, h, w in tokens]
        base.sort(key=repr)
        assert [g[:5] for g in got] == [b[:5] for b in base]
        assert np.allclose([g[5] for g in got], [b[5] for b in base])
    held = [r for r in queries.op10_pitman_yor(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than single words on unseen texts
    model, rare = pitman_yor.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert np.allclose((10.0 ** model.contexts.astype(float)).sum(0), 1, atol=1e-5)
    listed = model.words[~model.symbols.is_symbol] if len(model.symbols.index) else np.array([])
    assert math.isclose((10 ** listed).sum() + sum(10 ** r.p for r in rare.collect()) + (10 ** model.unseen).sum(), pitman_yor.CLASSES, rel_tol=1e-6)


def plain_scores(table, model, rare):
    """Every preceding word's restaurant as a dictionary, none of them divided; seats by the sampler, a dish at a time."""
    m, s = model, model.symbols
    number = lambda w: s.index[w] if w in s.index else int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64))
    tokens, restaurants = [], collections.defaultdict(lambda: collections.defaultdict(list))
    for doc, text, *_ in table:
        before, context, own = pitman_yor.START, 0, []
        for w in [*(text or "").encode().lower().split(), pitman_yor.END]:
            i, k, n = s.index.get(w), pitman_yor.class_of(w), number(w)
            base = 10.0 ** (float(m.contexts[k if i is None else s.symbol[i], context]) + (0.0 if i is None else m.words[i]))
            own.append((before, n, None if i is not None else k, base))
            if not pitman_yor.held_out(doc):
                restaurants[before][n].append((base, None if i is not None else k))
            before, context = n, s.context[i] if i is not None and s.context[i] else context
        tokens.append((doc, own))
    found = {}
    for u, dishes in restaurants.items():
        c = {w: len(x) for w, x in dishes.items()}
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d, total, tables = min(0.95, (ones + 3) / (ones + 2 * twos + 4)), sum(c.values()), len(c)
        weight = {w: sum(b for b, _ in x) / len(x) * (1 if x[0][1] is None else min(1, len(x) / m.classes[x[0][1]])) for w, x in dishes.items()}
        a, b = collections.Counter(), 0
        for n in range(1, 6):
            t = {w: 1 if c[w] == 1 else pitman_yor.seat(np.array([c[w]]), np.array([(1 + d * tables) * weight[w]]), d, pitman_yor.dish_key(np.array([u]), np.array([w])), n)[0] for w in c}
            tables = sum(t.values())
            if n > 2:
                a.update({w: (c[w] - d * t[w]) / (1 + total) / 3 for w in c})
                b += (1 + d * tables) / (1 + total) / 3
        found[u] = a, b
    out = []
    for doc, own in tokens:
        score = 0
        for u, w, k, base in own:
            a, b = found.get(u, ({}, 1))
            score += math.log10(a.get(w, 0) + b * base * (1 if k is None else 10 ** rare.get(w, m.unseen[k])))
        out.append((doc, score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shares", [None, (1e-2, 2e-2)])
def test_every_preceding_word_has_a_restaurant(spark, sf_dir, monkeypatch, shares):
    if shares:
        monkeypatch.setattr(pitman_yor, "TABLE_SHARE", shares[0])
        monkeypatch.setattr(pitman_yor, "SYMBOL_SHARE", shares[1])
    for path in (SF, sf_dir):
        docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
        model, rare = pitman_yor.train(docs)
        want = plain_scores([tuple(r) for r in docs.collect()], model, {r.h: r.p for r in rare.collect()})
        got = collected(pitman_yor.score(docs, model, rare).select("doc_id", "score"))
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5)


def test_order_of_words_that_are_not_frequent(spark):
    # both words are under 1/256 of all tokens, so the nearest frequent word doesn't tell the two orders apart
    ids = {held: [i for i in range(700) if pitman_yor.held_out(i) == held] for held in (False, True)}
    told = [(i, "the of zebra quagga of the") for i in ids[False][:5]] + [(i, "the of quagga and zebra of the") for i in ids[False][5:10]]
    rest = [(i, f"the of w{i} and the w{i % 50} of " * 4) for i in ids[False][10:]]
    asked = [(ids[True][0], "the of zebra quagga of the"), (ids[True][1], "the of quagga zebra of the")]
    got = dict(collected(pitman_yor.scores(spark.createDataFrame(told + rest + asked, "doc_id long, text string")).select("doc_id", "score")))
    assert got[asked[0][0]] > got[asked[1][0]] + 1


def test_model_keeps_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("doc_id", "text", "doc_id as a", "cast(doc_id as string) as k", "array(doc_id) as word", "map(lang, doc_id) as bucket", "lang as tokens").cache()
    model, rare = pitman_yor.train(docs)
    got = pitman_yor.score(docs, model, rare)
    other = [c for c in docs.columns if c != "text"]
    assert collected(got.select(other)) == collected(docs.select(other)) and got.filter("score is null or base_score is null").count() == 0


def test_tokens_in_parts(monkeypatch):
    # different words are looked up once a part, however often they occur; parts end anywhere between texts
    texts = ["  The cat\tthe\x0bCAT ", "", None, "É é\x85x\xa0y", "\n", "a " * 40, "the end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    plain = [[*(t or "").encode().lower().split(), pitman_yor.END] for t in texts]
    asked = []
    monkeypatch.setattr(pitman_yor, "class_of", lambda w, of=pitman_yor.class_of: asked.append(w) or of(w))
    for size in (1, 30, 1 << 23):
        monkeypatch.setattr(pitman_yor, "PART", size)
        symbols, got = pitman_yor.Symbols([(b"the", 9), (b"a", 9), (pitman_yor.END, 9)], 27), []
        for _, t in pitman_yor._tokens(iter([batch])):
            asked.clear()
            context, symbol, at, _ = symbols.read(t)
            assert len(asked) == len({w[-3:] for w in asked})
            for start, stop in zip(t.starts, t.starts[1:]):
                words = [t.words[int(c)].as_py() for c in t.code[start:stop]]
                before = [0, *[symbols.context[symbols.index[w]] if w in (b"the", b"a") else -1 for w in words[:-1]]]
                want = [next(int(x) for x in before[i::-1] if x >= 0) for i in range(len(words))]
                assert context[start:stop].tolist() == want
                assert at[start:stop].tolist() == [symbols.index.get(w, -1) for w in words]
                got.append(words)
        assert got == plain


# ---- columns -------------------------------------------------------------------------------------------------------

def test_clashing_names(spark):
    docs = documents(spark, clashes=True)
    for stage in (quality.keep_good, lines.dedup, simhash.one_of_each, secrets.redact):
        out = stage(docs)
        assert out.columns == docs.columns
        assert out.filter(" or ".join(f"not (`{c}` <=> doc_id * 2)" for c in CLASHES)).count() == 0
    model = queries.tokenizer("piece_bpe_32k.model")
    n = docs.count()
    for op in (simhash.groups, secrets.scan, quality.verdicts, pitman_yor.scores, lambda d: pieces.digests(d, model), lambda d: pieces.encode(d, model), lambda d: avi.digests(avi.to_avi(d))):
        out = op(docs)
        assert out.count() == n and len(set(out.columns)) == len(out.columns)


