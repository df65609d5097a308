"""Filter interactions against a plain replay of every order."""

import itertools
import re

import pytest
from llm_fixtures import LABEL_SCHEMA, LABELS, documents, rows
from pyspark.sql import functions as F

from scanframe.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def replayed(table, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for doc, text, lang, *_ in table:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and any(o[0] is not None and o[0] < doc and (o[1] or "") == text for o in table)}
        docs.append((lang or "", {f for f in fails if fails[f]}, doc in good, doc in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        values, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in docs if d[0] == part)
                left = [d for d in left if f not in d[1]]
                values[f] += len(gone)
                steps.append(("".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in docs if d[0] == part),
                              sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(part, s[0], s[1]): (*s[2:], values[s[0][s[1] - 1]]) for s in steps}
    return out


@pytest.mark.parametrize("clashes", [False, True])
def test_replay_of_every_order(spark, clashes):
    docs = documents(spark, clashes)
    if clashes:
        for name in ("part", "mask", "digest", "good", "toxic", "n", "state", "f"):
            docs = docs.withColumn(name, docs["doc_id"])
    labels = spark.createDataFrame(LABELS, LABEL_SCHEMA).withColumn("good", F.lit(7)).withColumn("n", F.lit(1))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.interactions(docs, labels).collect()}
    assert got == replayed(rows(), LABELS)


def test_path_counts():
    ahead, back = audit.forward(4), audit.backward(4)
    orders = list(itertools.permutations(range(4)))
    for state in range(16):
        members = {f for f in range(4) if state >> f & 1}
        assert ahead[state] * back[state] == sum(set(o[:len(members)]) == members for o in orders)


def test_shapley_values_add_up(spark):
    """What all filters remove together is the sum of their values over the number of orders."""
    table = spark.createDataFrame([("x", 0b011, 5, 1, 0), ("x", 0b110, 2, 0, 1), ("x", 0, 9, 0, 0), ("", 0b111, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = audit.report(table, "PQR").collect()
    assert len(got) == 2 * 6 * 3
    for part, removed in (("x", 7), ("", 1)):
        assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in got if r["part"] == part}.values()) == 6 * removed
    first = next(r for r in got if (r["part"], r["filter_order"], r["step"]) == ("x", "QRP", 1))
    assert (first["kept"], first["removed"], first["redundant"], first["unique_fails"], first["good_lost"], first["toxic_lost"]) == (9, 7, 0, 0, 1, 1)
