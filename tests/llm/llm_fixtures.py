"""Small documents with everything that is odd about rows."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABEL_SCHEMA = "doc_id long, quality int, toxic int"
#: Twice labelled, in contradiction, without a value, without an id, without a document.
LABELS = [*[(i, i % 2, int(i % 5 == 0)) for i in range(0, 30, 2)], (3, 1, 0), (3, 0, 1), (3, None, None), (5, None, 1), (None, 1, 1), (999, 1, 1)]
#: Names that operators use themselves.
CLASHES = ["kept", "base", "spans", "rank", "pos", "line", "deleted", "lines", "own", "id", "fp", "h", "c", "p", "n", "score", "rare", "media", "ids", "n_words",
           "n_tokens", "component_id", "root", "stays", "new", "text_key", "sequence_id", "feature", "__place"]


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def rows() -> list[tuple]:
    r = random.Random(7)
    body = ["\n".join(sentence(r, 30) for _ in range(4)) for _ in range(12)]
    passage = sentence(r, 70)
    near = body[0].replace(" ", " x", 2)
    texts = [*body, body[0], body[0], near, near.upper(), f"{body[1]}\n{passage}", f"{passage}\n{body[2]}", "", "   \n\t", None,
             "one", "two words", "Übér ſtraße K word", "a\x0bb\x0cc\rd e", "\n\n\n", "same line here\n" * 40,
             "token = \"abcdef0123456789abcdef0123456789\" and AKIA" + "Q7Z" * 8 + " x", "password: abc, secret=token:abcdefgh",
             "Zq9Xk2Lm8Wv4Rt6Yb1Nc3 hides here", "### $$$ *** " * 30, "▁marked  double  space ", sentence(r, 6000), "x" * 30000, "\U0001F600 <|endoftext|> İ é don't"]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "a", "a", None, "b"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, body[5], "en", "a", 1), (None, None, None, None, None), (1, body[6] + " more", "en", "a", None)]


def documents(spark, clashes: bool = False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clashes:
        for name in CLASHES:
            df = df.withColumn(name, df["doc_id"] * 2)
    return df


def table_dir(spark, path, df, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
