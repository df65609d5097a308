"""The corpus pipeline against plain versions of its stages, each on what its predecessor kept."""

import hashlib

import duckdb
import numpy as np
import pytest
from llm_fixtures import SCHEMA, documents, rows, table_dir
from test_operators import check_packing, plain_spans

import corpus_pipeline
from scanframe.llm import queries, simhash


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    extra = [(100 + r[0], r[1] * 3, r[2], r[3], r[4]) for r in rows()[:6]]
    docs = spark.createDataFrame([*[tuple(r) for r in documents(spark).collect()], *extra], SCHEMA)
    sf_dir, out = table_dir(spark, path, docs), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{path}/{i}")
        out.append(spark.read.parquet(f"{path}/{i}"))
        assert i == 4 or out[-1].columns == docs.columns
    return sf_dir, out


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_against_plain_versions(spark, stages):
    sf_dir, (docs, good, lined, single, clean, packed) = stages
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    kept = con.execute(f"select doc_id from ({queries.ORACLES['op9_adaptive_quality']}) where kept").fetchall()
    assert sorted(map(repr, kept)) == sorted(repr((r[0],)) for r in table_of(good))

    con.register("good", good.toArrow())
    con.execute("create or replace view documents as select * from good")
    want = con.execute(f"select doc_id, text_sha256 from ({queries.ORACLES['op2_line_runs']})").fetchall()

    assert sorted(map(repr, want)) == sorted(repr((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in table_of(lined))
    assert all(n == len(text) for _, text, _, _, n in table_of(lined) if text is not None and n is not None and text == "")

    sets = [(doc, frozenset(simhash.shingle_hashes((text or "").encode(), 5).tolist())) for doc, text, *_ in table_of(single)]
    for i, (_, a) in enumerate(sets):
        for _, b in sets[:i]:
            assert (len(a & b) / len(a | b) if a | b else 1) < 0.8
    assert {r[0] for r in table_of(single)} <= {r[0] for r in table_of(lined)}

    for (doc, before, *_), (same, after, _, _, n) in zip(table_of(single), table_of(clean), strict=True):
        assert doc == same and (after == before or plain_spans(before)) and not plain_spans(after)
        assert after == before or n == len(after)
    check_packing([tuple(r) for r in clean.collect()], packed.collect())


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_members_that_ask_no_more_are_still_found():
    width = simhash.HEAD + 10 + simhash.BITS // 64 + 1
    member = lambda i, group, start, after: [0, i, group, start, after, -1, *[0] * (width - simhash.HEAD - 1), 100]
    a, b = (np.array(x, np.int64) for x in ([member(1, 1, 1, simhash.DONE), member(2, 1, 1, -1)], [member(3, 3, 5, simhash.DONE)]))
    u, v, d = simhash._nearest_in(a, b, 2, 100, 0.8, 4)
    assert (u.tolist(), v.tolist(), d.tolist()) == ([2], [3], [0])
