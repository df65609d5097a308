"""Secret scans: fixed patterns, and character Markov models for what they miss [native].

Base spans come from three patterns (``KINDS``). A candidate is a token of ``MIN_TOKEN`` or more characters with a letter
and a digit that overlaps no base span. Two first-order character models, of random strings and of ordinary
identifiers, are trained on labelled samples of the scanned texts: the values of all base spans are random strings; the
tokens, other than candidates, of about ``SAMPLE_DOCS`` documents without a base span, chosen by hash, are ordinary. A candidate whose
log-likelihood ratio exceeds ``MIN_RATIO`` a character is a secret of kind ``markov``.

Defined results: a null text is empty and has no spans; rows are scanned each on their own, so null and repeated ids do
no harm; without a base span anywhere there is no sample of random strings and nothing is added; an empty table gives an
empty result. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanframe.llm.common import cut, text_of

#: The patterns of the contract, in its order, and the least length of (group of the match that counts).
KINDS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
_SPEEDED = {"hex": "[0-9a-f]{24,}+"}  # a run shorter than that fails as a whole, and no part of it can pass
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1
MIN_TOKEN = 20
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ORDINARY = "[A-Za-z0-9+/_=-]{6,}+"
SAMPLE_DOCS = 4096
MIN_RATIO = 0.3
SMOOTHING, PRIOR = 0.5, 8
_SPAN = "struct<s:int,k:int,e:int,v:string>"


def _located(text: Column, pattern: str, kind: int, good) -> Column:
    """Sorted (s, k, e, v) of the leftmost non-overlapping matches m with good(m)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("v"))
        return F.struct(end.alias("at"), F.when(good(x["m"]), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(f"array<{_SPAN}>")
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _base(text: Column) -> list[Column]:
    out = []
    for k, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        def good(m: Column, pattern=pattern, group=group, least=least) -> Column:
            return F.length(F.regexp_extract(m, pattern, group) if group else m) >= least
        out.append(_located(text, _SPEEDED.get(name, pattern), k, good))
    return out


def _mixed(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def scanned(docs: DataFrame) -> DataFrame:
    """Adds ``base`` and ``candidates`` (arrays of s, k, e, v); one pass over each text, no shuffle."""
    text = text_of()
    base = F.sort_array(F.concat(*_base(text)))
    mixed = _located(text, TOKEN, len(KINDS), _mixed)
    df = docs.withColumn("base", base).withColumn("__mixed", mixed)
    apart = F.filter("__mixed", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return df.withColumn("candidates", apart).drop("__mixed")


def _codes(token: Column) -> Column:
    """State numbers of a token's characters, 0 before the first."""
    return F.transform(F.concat(F.array(F.lit("")), F.split(token, "")), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _steps(codes: Column) -> Column:
    n = F.size(codes) - 1
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * STATES + b)


def train(scan: DataFrame, sample: Column) -> list[int] | None:
    """Thousandths of the log ratio of each step (state x next state), or None without random strings.

    ``sample`` marks the documents whose ``ordinary`` tokens count. What reaches the driver has a row per step.
    """
    value = F.transform("base", lambda b: F.when(b["k"] == 0, F.regexp_extract(b["v"], KINDS["assign"][0], 2)).otherwise(b["v"]))
    random = scan.select(F.lit(1).alias("label"), F.explode(value).alias("t"))
    plain = scan.filter(sample & (F.size("base") == 0)).select(F.lit(0).alias("label"), F.explode("ordinary").alias("t"))
    plain = plain.filter(~((F.length("t") >= MIN_TOKEN) & _mixed(F.col("t"))))  # candidates have no label
    steps = random.unionByName(plain).select("label", F.explode(_steps(_codes(F.col("t")))).alias("step"))
    counts = {(r["label"], r["step"]): r["n"] for r in steps.groupBy("label", "step").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not any(label for label, _ in counts):
        return None
    rows = {(label, i): sum(counts.get((label, i * STATES + j), 0) for j in range(STATES)) for label in (0, 1) for i in range(STATES)}
    to = {(label, j): sum(counts.get((label, i * STATES + j), 0) for i in range(STATES)) for label in (0, 1) for j in range(STATES)}
    all_steps = {label: sum(rows[label, i] for i in range(STATES)) for label in (0, 1)}

    def log_p(label: int, step: int) -> float:
        """A step's share after its state, drawn to the share of the next character anywhere."""
        i, j = divmod(step, STATES)
        anywhere = (to[label, j] + SMOOTHING) / (all_steps[label] + SMOOTHING * STATES)
        return math.log((counts.get((label, step), 0) + PRIOR * anywhere) / (rows[label, i] + PRIOR))

    return [round(1000 * (log_p(1, s) - log_p(0, s))) for s in range(STATES * STATES)]


def _ratio(token: Column, model: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded into a literal
    return F.aggregate(_steps(_codes(token)), F.lit(0).cast("bigint"), lambda acc, step: acc + F.element_at(table, step + 1))


def _with_model(scan: DataFrame, model: list[int] | None) -> DataFrame:
    """Adds ``added``, the candidates that the models call random, and ``spans``, all of them sorted."""
    none = F.array().cast(f"array<{_SPAN}>")
    added = none if model is None else F.filter("candidates", lambda c: _ratio(c["v"], model) > 1000 * MIN_RATIO * F.length(c["v"]))
    return scan.withColumn("added", added).withColumn("spans", F.sort_array(F.concat("base", "added"))).drop("candidates")


def _sample(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", text_of()), F.lit(max(1, n // SAMPLE_DOCS))) == 0


def _ordinary(n: int) -> Column:
    return F.when(_sample(n), F.regexp_extract_all(text_of(), F.lit(ORDINARY), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added, spans). Texts are read once."""
    n = docs.count()
    thin = cut(scanned(docs.select("doc_id", "text", _ordinary(n).alias("ordinary"))).drop("text"))
    model = train(thin, F.col("ordinary").isNotNull())
    return _with_model(thin, model).drop("ordinary")


def count_of(kind: int) -> Column:
    """Base spans of a kind, by its number."""
    return F.size(F.filter("base", lambda b: b["k"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "markov"]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """For the pipeline: every span (overlapping ones as one) gives way to ``mark``; texts without one stay as they are.

    Texts are scanned twice, once to train and once to cut, rather than shuffled.
    """
    n = docs.count()
    thin = cut(scanned(docs.select("doc_id", "text", _ordinary(n).alias("ordinary"))).select("base", "ordinary"))
    own = docs.select(F.struct(*docs.columns).alias("own"), "text")
    found = _with_model(scanned(own), train(thin, F.col("ordinary").isNotNull()))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).alias("out"))
    cut_out = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                          lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    some = F.size("spans") > 0
    text = F.when(some, cut_out).otherwise(F.col("text"))
    changed = {"text": F.col("new"), "n_chars": F.when(some, F.length("new").cast("bigint")).otherwise(F.col("own.n_chars"))}
    return found.withColumn("new", text).select(*[changed.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
