"""Tokenizer alignment against a plain version: ends by sets, links by two loops, counts by dictionaries."""

import collections
import hashlib
import random

import pytest
import sentencepiece
from llm_fixtures import SCHEMA, rows, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanframe.llm import alignment, queries

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(table):
    slow, lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    slow.encode_special_tokens = True
    alphabet = {c: bytes([b]) for c, b in alignment.byte_alphabet().items()}
    docs, held = [], collections.Counter()
    for doc, text in table:
        a, b = slow.encode(" " + (text or ""), add_special_tokens=False).ids if text else [], lib.encode(text) if text else []
        in_a = [b"".join(alphabet[c] for c in slow.id_to_token(i)) for i in a]
        pieces = [lib.id_to_piece(i) for i in b]
        in_b = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not text or b"".join(in_a) != f" {text}".encode() or b"".join(in_b) != f" {text}".encode():
            docs.append((doc, [], [], []))
            continue
        ends = [[sum(map(len, side[:k + 1])) for k in range(len(side))] if len(side) < 300 else ends_of(side) for side in (in_a, in_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, ia, ib = [], 0, 0
        for end in common:
            ja, jb = ends[0].index(end, ia) + 1, ends[1].index(end, ib) + 1
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
        docs.append((doc, a, b, groups))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc, a, b, groups in docs:
        pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append((doc, len(a), len(b), len(groups), len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def ends_of(side):
    out, at = [], 0
    for token in side:
        at += len(token)
        out.append(at)
    return out


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("block", [alignment.BLOCK, 3000])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    table = [*[(i, t) for i, t, *_ in rows()], (500, "日本語 テキスト 🙂🙂 ﬁ"), (501, " lead"), (502, "<s></s><unk> <0x0A>"), (503, "x" * 9000), (504, "a" + " " * 5000 + "b")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3).withColumns({c: F.col("doc_id") for c in ("block", "codes", "n_a", "value")})
    assert collected(alignment.align(docs, A, B)) == plain(table)


def test_given_documents(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(queries.op13_run_skipping(spark, SF)) == plain(table)


def test_runs_against_common_ends():
    r = random.Random(5)
    for _ in range(500):
        last = r.randint(1, 60)
        a, b = (sorted({*r.sample(range(1, last + 1), r.randint(0, last)), last}) for _ in range(2))
        if r.random() < 0.5:  # long equal stretches with single differences
            b = sorted(set(a) ^ set(r.sample(range(1, last + 1), min(last, 2))))
            b = sorted({*b, last})
        groups = alignment.grouped(alignment.runs(a, b), alignment.np.array(a), alignment.np.array(b))
        got = [(int(i + m), int(j + n)) for i, m, j, n in zip(*groups, strict=True)]
        assert got == [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]


def test_wide_groups(monkeypatch):
    """A group is counted by its different ids or link by link, with one result."""
    ids_a, ids_b = alignment.np.array([1, 2, 1, 3, 1]), alignment.np.array([7, 7, 8, 9])
    groups = tuple(map(alignment.np.array, ([0, 4], [4, 1], [0, 3], [3, 1])))
    wide = []
    for limit in (4096, 2):
        monkeypatch.setattr(alignment, "WIDE", limit)
        wide.append([x.tolist() for x in alignment.links(ids_a, ids_b, groups, 10)])
    assert wide[0] == wide[1] == [[17, 18, 19, 27, 28, 37, 38], [4, 2, 1, 2, 1, 2, 1]]


def test_fast_encoder_gives_the_file_s_ids():
    side = alignment.ByteLevel(A)
    assert side.fast is not None
    r = random.Random(9)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}  {chr(c)}" for c in points[i:i + 4000]) for i in range(0, len(points), 4000)]
    texts += ["".join(chr(r.choice([32, 32, 9, 10, 39, 97, 115, 116, 49, 46, 160, 8195, 233, 0x4E2D])) for _ in range(400)) for _ in range(300)]
    for text in [*texts, "<|endoftext|>", "x" * 30000, " " * 30000, sentence(r, 500)]:
        assert side.fast.encode_ordinary(text) == side.slow.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
