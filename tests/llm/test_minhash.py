"""MinHash groups against all pairs of plain sets."""

import random

import pytest
from llm_fixtures import SCHEMA, documents, rows, sentence
from pyspark.sql import functions as F
from test_operators import plain_components

from scanframe.llm import links, minhash, queries
from scanframe.llm.common import Scratch
from scanframe.llm.links import crossing, merged_in_rounds

SF = "/root/testdata/sf0.001"


def plain(table):
    sets = []
    for _, text, *_ in table:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set()))
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    found, least = plain_components(len(sets), linked), {}
    for (doc, *_), g in zip(table, found, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    out = []
    for (doc, *_), s, g in zip(table, sets, found, strict=True):
        component = least.get(g) if s else doc
        out.append((doc, len(s), component, doc == component))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_odd_rows(spark):
    docs = documents(spark, clashes=True).withColumns({c: F.col("doc_id") for c in ("set_key", "keys", "signature", "u", "v", "text_key")})
    assert collected(minhash.near_groups(docs)) == plain(rows())


def test_given_documents(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(queries.op11_minhash_bands(spark, SF)) == plain(table)


def edited(r, words, share):
    return [f"new{r.random()}" if r.random() < share else w for w in words]


def test_crowded_buckets(spark, monkeypatch):
    """Chains of edits, copies around one text that isn't the least, texts that share much and are not alike; in small parts."""
    monkeypatch.setattr(minhash, "PART", 16)
    r, texts = random.Random(1), []
    base = sentence(r, 300).split()
    texts += [edited(r, base, 0.02) for _ in range(150)] + [base]
    chain = sentence(r, 300).split()
    for _ in range(40):
        chain = edited(r, chain, 0.01)
        texts.append(chain)
    common = sentence(r, 200).split()
    texts += [common + sentence(r, 25 + 2 * k).split() for k in range(60)]
    r.shuffle(texts)
    table = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = collected(minhash.near_groups(spark.createDataFrame(table, "doc_id long, text string")))
    assert got == plain(table)


def test_rounds_ask_for_every_pair(spark, tmp_path):
    """All pairs of a small table are asked for, in order, whatever is rejected; few at a time."""
    pairs = [(u, v, (u * v) % 7) for u in range(20) for v in range(u)]
    table, asked = spark.createDataFrame(pairs, "u long, v long, d int"), []

    def verified(found):
        got = [tuple(x) for x in found.collect()]
        asked.extend(got)
        return spark.createDataFrame([p for p in got if (p[0] - p[1]) % 5 == 0], "u long, v long")

    none = spark.createDataFrame([], "node long, root long")
    roots = merged_in_rounds(lambda roots, after, most: crossing(table, roots, after, most), verified, none, Scratch(spark, "rounds"), 2)
    group = {x["node"]: x["root"] for x in roots.collect()}
    assert all(group.get(i, i) == i % 5 for i in range(20))
    assert len(asked) == len(set(asked))
    assert {(u, v) for u, v, _ in pairs if (u - v) % 5} <= set(asked)


def test_signatures_estimate_similarity():
    r = random.Random(2)
    words = sentence(r, 2000).split()
    for share in (0.0, 0.01, 0.05):
        a, b = (minhash.shingles(" ".join(t).encode()) for t in (words, edited(r, words, share)))
        both = len(minhash.np.intersect1d(a, b))
        assert abs((minhash.minima(a) == minhash.minima(b)).mean() - both / (len(a) + len(b) - both)) < 0.15


def test_sketches_never_reject_similar_pairs():
    """Pairs just at the least similarity pass, whatever their size; those well below don't."""
    r = minhash.np.random.default_rng(4)
    for n in (40, 300, 3000, 30000):
        for share, limit in ((15 / 185, True), (0.3, False)):
            passed = 0
            for _ in range(20):
                common, own = int(n * (1 - share)), int(n * share)
                made = [minhash.np.unique(x) for x in (r.integers(1 << 63, size=common + 2 * own, dtype=minhash.np.uint64),)][0]
                r.shuffle(made)
                a, b = minhash.np.sort(made[:common + own]), minhash.np.sort(minhash.np.concatenate([made[:common], made[common + own:]]))
                sides = [minhash.np.concatenate([minhash.minima(x).astype(minhash.np.uint8), minhash.odd_sketch(x)]) for x in (a, b)]
                passed += bool(minhash.compared(sides[0], len(a), sides[1], len(b))[1])
            assert passed == 20 if limit else passed <= 2


def test_empty_table(spark):
    assert minhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rounds_ask_only_who_has_more(spark, tmp_path, monkeypatch):
    # 1 has as many pairs as it can be given, 2 has fewer: in the second round 1 alone asks; rounds that link nothing leave the groups alone
    monkeypatch.setattr(links, "components", lambda found: pytest.fail("no links"))
    scratch, rounds = Scratch(spark, "rounds"), []
    pairs = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (1, 12, 7), (2, 10, 9)], "u long, v long, d int")
    roots = spark.createDataFrame([(7, 3)], "node long, root long")

    def nearest(roots, after, most):
        rounds.append(after and sorted(map(tuple, after.collect())))
        return links.crossing(pairs, roots, after, most)

    got = links.merged_in_rounds(nearest, lambda asked: scratch.store(asked.filter("u < 0").select("u", "v")), roots, scratch, 2)
    assert rounds == [None, [(1, 6, 11)]]
    assert [tuple(r) for r in got.collect()] == [(7, 3)]


def test_components_of_few_links_take_few_tasks(spark):
    pairs = [(i, i - 1) for i in range(1, 40)] + [(100, 50), (100, 60), (7, 3)]
    had = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = links.components(spark.createDataFrame(pairs, "u long, v long"))
        tasks, got = found.rdd.getNumPartitions(), {tuple(r) for r in found.collect()}
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert tasks == 1
    assert got == {(i, 0) for i in range(1, 40)} | {(60, 50), (100, 50)}
