"""Quality rules with adaptive thresholds from mergeable quantile sketches [native].

Every document gets whole-number measures. A quantile sketch of each measure is kept per language and source: a
histogram with 32 steps to each power of two (relative error 1/32), so that sketches merge by adding counts, in any
order and with the same result. Fences follow from the quartiles of a document's own group; a group of fewer than
``MIN_GROUP`` documents is judged by the merged sketch of its language, and a language that small by that of all.

Defined results: a null text has no words; null languages and sources are groups of their own; repeated rows are
judged alike; an empty table gives an empty result; ``keep_good`` hands on all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanframe.llm.common import cut, text_of, without_spaces, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 30
#: measure -> (low fence too, spreads from the median, slack in the measure's unit). Slack keeps a group without any
#: spread (no symbols at all, say) from rejecting a document for a trace.
FENCES = {"word_len": (True, 16, 60), "symbols": (False, 10, 150), "dup_lines": (False, 10, 400), "repeats": (False, 10, 450)}
PLACE = "__place"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"q_{m}" for m in FENCES)]


def _shifted(pairs: Column, n: Column, fn) -> Column:
    """fn(this, next) over neighbours of an array of n elements."""
    return F.zip_with(F.slice(pairs, F.lit(1), n - 1), F.slice(pairs, F.lit(2), n - 1), fn)


def measured(docs: DataFrame) -> DataFrame:
    """Adds the measures; one pass over each text, no shuffle."""
    text = text_of()
    df = (docs.withColumn("__words", words_of(text))
          .withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: without_spaces(x) != ""))
          .withColumn("n_words", F.size("__words").cast("bigint"))
          .withColumn("word_chars", F.length(without_spaces(text)).cast("bigint"))
          .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
          .withColumn("__n_lines", F.size("__lines"))
          .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint")))
    # windows of three words, as hashes
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    m = F.greatest(F.size("__h") - 2, F.lit(0))
    pair = F.zip_with(F.slice("__h", F.lit(1), m), F.slice("__h", F.lit(2), m), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = df.withColumn("__win", F.zip_with(pair, F.slice("__h", F.lit(3), m), lambda p, c: F.xxhash64(p["a"], p["b"], c)))
    # sorted with their places, equal windows stand side by side; those of a text without repeats need no sorting
    some = F.size("__win") > F.size(F.array_distinct("__win"))
    df = df.withColumn("__s", F.when(some, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__eq", F.when(F.col("__s").isNotNull(), _shifted(F.col("__s"), F.size("__s"), lambda a, b: a["h"] == b["h"])))
    before, after = F.concat(F.array(F.lit(False)), F.col("__eq")), F.concat(F.col("__eq"), F.array(F.lit(False)))
    hit = F.zip_with(F.zip_with(before, after, lambda a, b: a | b), F.col("__s"), lambda f, s: F.when(f, s["i"]))
    df = df.withColumn("__at", F.when(F.col("__s").isNotNull(), F.sort_array(F.filter(hit, lambda x: x.isNotNull()))))
    spans = _shifted(F.col("__at"), F.size("__at"), lambda a, b: F.least(b - a, F.lit(3)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(3), lambda acc, x: acc + x), F.lit(0)).cast("bigint"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    df = (df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
          .withColumn("q_word_len", F.floor(100 * F.col("word_chars") / n).cast("bigint"))
          .withColumn("q_symbols", F.floor(1000 * F.col("n_symbols") / n).cast("bigint"))
          .withColumn("q_dup_lines", F.floor(1000 * F.col("n_dup_lines") / F.greatest("__n_lines", F.lit(1))).cast("bigint"))
          .withColumn("q_repeats", F.floor(1000 * F.col("n_repeat_words") / n).cast("bigint")))
    # a column that isn't deterministic: no filter on the measures is pushed below them, which would write each measure
    # out in terms of the text, over and over
    return df.select(*docs.columns, *MEASURES, F.spark_partition_id().alias(PLACE))


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number from 0: itself below 64, then 32 buckets to each power of two."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(e * 32 + F.floor(v / F.pow(F.lit(2), e))).cast("bigint")


def value(b: Column) -> Column:
    """Least whole number of a bucket."""
    e = F.floor(b / 32) - 1
    return F.when(b < 64, b).otherwise((b - 32 * e) * F.pow(F.lit(2), e)).cast("bigint")


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that the base rules keep. Merging is adding n."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"q_{m}")).alias("bucket")) for m in FENCES]))
    return (measures.select("lang", "source", "base_failed", stacked.alias("s"))
            .groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).filter("n > 0"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row (lang, source, low_*, high_*) per group: fences from the quartiles of the smallest large-enough level."""
    levels = F.explode(F.array(F.lit(2), F.lit(1), F.lit(0)))
    merged = (sketch.withColumn("level", levels)
              .withColumn("k_lang", F.when(F.col("level") > 0, F.col("lang"))).withColumn("k_source", F.when(F.col("level") > 1, F.col("source")))
              .groupBy("level", "k_lang", "k_source", "measure", "bucket").agg(F.sum("n").alias("n")))
    group = Window.partitionBy("level", "k_lang", "k_source", "measure")  # bounded: a row per bucket
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))

    def quantile(q: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= q * F.col("all"), value(F.col("bucket"))))

    fences = (ranked.groupBy("level", "k_lang", "k_source", "measure").agg(quantile(1).alias("q1"), quantile(2).alias("q2"), quantile(3).alias("q3"), F.max("all").alias("docs"))
              .groupBy("level", "k_lang", "k_source").agg(F.max("docs").alias("docs"), *[
                  c for m, (low, spreads, slack) in FENCES.items() for c in (
                      F.max(F.when(F.col("measure") == m, F.col("q2") + spreads * (F.col("q3") - F.col("q2")) + slack)).alias(f"high_{m}"),
                      F.max(F.when(F.col("measure") == m, F.col("q2") - spreads * (F.col("q2") - F.col("q1")) - slack if low else F.lit(0))).alias(f"low_{m}"))]))
    names = [f"{side}_{m}" for m in FENCES for side in ("low", "high")]
    packed = fences.select("level", "k_lang", "k_source", "docs", F.struct(*names).alias("f"))
    groups = sketch.select("lang", "source").distinct().withColumn("level", levels)
    groups = groups.withColumn("w_lang", F.when(F.col("level") > 0, F.col("lang"))).withColumn("w_source", F.when(F.col("level") > 1, F.col("source")))
    on = (groups["level"] == packed["level"]) & groups["w_lang"].eqNullSafe(packed["k_lang"]) & groups["w_source"].eqNullSafe(packed["k_source"])
    fit = (packed["docs"] >= MIN_GROUP) | (packed["level"] == 0)
    best = groups.join(packed, on).groupBy("lang", "source").agg(F.max_by("f", F.when(fit, packed["level"])).alias("f"))
    return best.select("lang", "source", *[F.col(f"f.{n}").alias(n) for n in names])


def judged(measures: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds ``kept``. The fences join by value; they are one row per language and source, and Spark broadcasts them
    only if they are small, else it splits the large groups."""
    right = fences.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    joined = measures.join(right, measures["lang"].eqNullSafe(right["__lang"]) & measures["source"].eqNullSafe(right["__source"]), "left")
    inside = F.lit(True)
    for m in FENCES:
        inside = inside & F.col(f"q_{m}").between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True)) & (F.col(PLACE) >= 0)
    return joined.withColumn("kept", kept).select(*[c for c in measures.columns if c != PLACE], "kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source), the measures and ``kept``. Texts are measured once."""
    thin = cut(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(thin, cutoffs(sketches(thin)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Texts are read twice rather than shuffled."""
    own = docs.select(F.struct(*docs.columns).alias("__own"), "lang", "source", "text")
    fences = cut(cutoffs(sketches(measured(docs.select("lang", "source", "text")))))
    return judged(measured(own), fences).filter("kept").select("__own.*")
