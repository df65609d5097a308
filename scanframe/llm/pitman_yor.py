"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Symbols are the common words (``SYMBOL_SHARE`` of all training tokens or more), the end, and for all other words
``CLASSES`` classes by their last characters. A position's context is the nearest common word before it that makes up
``CONTEXT_SHARE`` or more (or the start): every context has a Chinese restaurant over symbols, all of them share the
restaurant of all positions as parent, whose base is uniform. A class is a restaurant over its words, with one more dish
for words never seen. Shares of all tokens bound the number of contexts (256), symbols (65,536 and the classes) and of
words that are looked up in a broadcast table (2^20); all other words are counted and looked up by joins.

On top of these every word that precedes another, and the start, has a restaurant over all words, rare ones too. Its base is
what the contexts and classes say at the customer's place (``base_of``); a dish's seats take the mean over its customers. All
tokens, each with the word before it, go to the task of that word, packed, where its restaurants are seated and its
tokens scored at once. Words that are contexts follow too many tokens for one task: theirs are dealt out by the following
word as well, and only the totals of their tables pass through the driver. A rare word's share of its class isn't known
there: its seats take its own customers for all of the word's, and its probability is handed on as a + b x share.
Each restaurant has a discount of its own, from its dishes with one and two customers and a prior (``PRIOR``).

A sweep seats all customers of a dish anew, given the tables of all others as the sweep before left them: one after
another for the first ``EXACT``, then in blocks of doubling length that open their expected number of tables, rounded
at random. Draws are hashes of dish, sweep and customer, so a repeated task draws the same. Only table totals (one per
restaurant) pass from sweep to sweep through the driver. Predictive probabilities are averaged over the sweeps after
burn-in.

Defined results: a null text is empty (its end alone); null ids count as the empty text for the split and are scored
like any other; repeated rows train and are scored each; without training documents everything is an unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanframe.llm.common import cut

FOLDS, HELD_OUT = 5, 1
CONTEXT_SHARE, SYMBOL_SHARE, TABLE_SHARE = 1 / 256, 1 / (1 << 16), 1 / (1 << 20)
CLASSES = 64
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
EXACT = 64
END = b"\n"
#: Bytes of text that are cut into words at a time.
PART = 1 << 23
#: The word before the first, as a number.
START = -(1 << 62)
#: Added to the ones, and to ones and twice the twos, where a restaurant's discount is their ratio.
PRIOR = 3, 4
#: Tokens of a task that scores them, about, and the parts it holds one of at a time.
TASK_TOKENS, BUCKETS = 1 << 21, 4


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def class_of(word: bytes) -> int:
    """By the last characters, which tell word forms and languages apart."""
    return zlib.crc32(word[-3:]) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_of`` of each of an array of words; equal endings are hashed once."""
    ends = pc.binary_slice(words, -3).dictionary_encode()
    return np.array([class_of(w) for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


# ---- counts --------------------------------------------------------------------------------------------------------

class Tokens:
    """The lower-cased tokens of some texts: the different words with the end as the last, each token's number among them,
    and where each text starts."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, own = lists.flatten(), pc.list_parent_indices(lists)
        some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
        coded, own = words.filter(some).cast(pa.binary()).dictionary_encode(), own.filter(some).to_numpy()
        self.words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)) + 1)]).astype(np.int64)
        self.code = np.full(self.starts[-1], len(self.words) - 1, np.int64)
        self.code[np.arange(len(own)) + own] = coded.indices.to_numpy()
        self.last = self.starts[1:] - 1

    def __len__(self) -> int:
        return len(self.starts) - 1


def _tokens(batches: Iterator[pa.RecordBatch], train: bool = False) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Batches in parts of bounded text with their tokens; for training without the held-out documents."""
    for batch in batches:
        if train:
            batch = batch.filter(pa.array([not held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_()))
        texts = pc.fill_null(batch.column("text"), "")
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        part = np.cumsum(sizes) // PART
        edges = np.flatnonzero(np.diff(part)) + 1
        for start, stop in zip([0, *edges], [*edges, len(batch)], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start), Tokens(texts.slice(start, stop - start))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, t in _tokens(batches, train=True):
        yield pa.RecordBatch.from_arrays([t.words, pa.array(np.bincount(t.code, minlength=len(t.words)))], names=["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents, the end among the words."""
    rows = docs.select("doc_id", "text").mapInArrow(_counted, "word binary, c long")
    return cut(rows.groupBy("word").agg(F.sum("c").alias("c")))


class Symbols:
    """Numbers of contexts, symbols and table words. Classes come first among the symbols."""

    def __init__(self, common: list[tuple[bytes, int]], total: int):
        self.total = total
        words = sorted(common)
        self.index = {w: i for i, (w, _) in enumerate(words)}
        self.count = np.array([c for _, c in words] or [0], np.int64)
        symbol = np.array([w == END or c >= SYMBOL_SHARE * total for w, c in words] or [False])
        self.symbol = np.where(symbol, CLASSES + np.cumsum(symbol) - 1, [class_of(w) for w, _ in words] or [0])
        self.is_symbol = symbol
        self.size = CLASSES + int(symbol.sum())
        context = np.array([w != END and c >= CONTEXT_SHARE * total for w, c in words] or [False])
        self.context = np.where(context, np.cumsum(context), 0)
        self.contexts = 1 + int(context.sum())
        self._listed = None

    def read(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, symbol, table index or -1) of every token, and the classes of the different words that aren't in the table (-1: it is)."""
        at = pc.fill_null(pc.index_in(t.words, self.listed()), -1).to_numpy().astype(np.int64)
        classes = np.full(len(at), -1)
        rare = np.flatnonzero(at < 0)
        classes[rare] = classes_of(t.words.take(pa.array(rare)))
        symbol, context = np.where(at < 0, classes, self.symbol[at])[t.code], np.where(at < 0, 0, self.context[at])[t.code]
        # the nearest token before it of the same text that is a context
        place = np.arange(len(t.code))
        place = np.maximum.accumulate(np.where(context > 0, place, -1))
        before = np.concatenate([[-1], place[:-1]])
        first = np.repeat(t.starts[:-1], np.diff(t.starts))
        return np.where(before >= first, context[before], 0), symbol, at[t.code], classes

    def listed(self) -> pa.Array:
        if self._listed is None:
            self._listed = pa.array(list(self.index), pa.binary())
        return self._listed


def _pairs(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Customers of the context restaurants: (symbol, context, c)."""
    s = model.value
    counts = np.zeros(s.contexts * s.size, np.int64)
    for _, t in _tokens(batches, train=True):
        context, symbol, _, _ = s.read(t)
        np.add.at(counts, context * s.size + symbol, 1)
    some = np.flatnonzero(counts)
    for i in range(0, len(some), 1 << 16):
        part = some[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part % s.size), pa.array(part // s.size), pa.array(counts[part])], names=["symbol", "context", "c"])


# ---- seating -------------------------------------------------------------------------------------------------------

def _uniform(key: np.ndarray, sweep: int, customer: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = key + np.uint64((sweep << 40) + customer + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def seat(c: np.ndarray, weight: np.ndarray, discount: float | np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of every dish after c customers. ``weight`` is (strength + discount x tables of the restaurant) x base
    probability; a customer after m others at t tables opens a new one with probability weight / (weight + m - discount t)."""
    t = np.minimum(c, 1).astype(np.float64)
    discount = np.broadcast_to(discount, c.shape)
    rows, m = np.flatnonzero(c > 1), 1
    while len(rows):
        block = 1 if m < EXACT else m
        take = np.minimum(block, c[rows] - m)
        w, middle = weight[rows], m + (take - 1) / 2
        new = w / (w + np.maximum(middle - discount[rows] * t[rows], 1e-9))
        u = _uniform(key[rows], sweep, m)
        t[rows] += np.minimum(np.floor(take * new + u), take)
        m += block
        rows = rows[c[rows] > m]
    return t


def discount_of(ones: int, twos: int) -> float:
    """From the dishes with one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))


class Contexts:
    """Gibbs state of the context restaurants and their parent, for the symbols of a task."""

    def __init__(self, symbols: int, contexts: int, customers: list[int], discount: float):
        self.symbols, self.contexts, self.customers, self.d = symbols, contexts, np.array(customers, np.float64), discount
        self.totals: list[tuple[list[float], float]] = []  # by sweep: tables of every context, tables of the parent

    def sweep(self, symbol: np.ndarray, context: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For every sweep so far and one more: tables (by row, and of the parent by symbol) and the parent's
        probability of each symbol. Rows come grouped by symbol."""
        names, group = np.unique(symbol, return_inverse=True)
        key = (symbol.astype(np.uint64) << np.uint64(20)) ^ context.astype(np.uint64)
        t, t0 = np.ones(len(c)), np.ones(len(names))
        for n in range(len(self.totals) + 1):
            if n:
                tables, parent = np.array(self.totals[n - 1][0]), self.totals[n - 1][1]
                p0 = self.parent(np.bincount(group, t, len(names)), t0, tables.sum(), parent)
                t = seat(c, (STRENGTH + self.d * tables[context]) * p0[group], self.d, key, n)
                t0 = seat(np.bincount(group, t, len(names)), np.full(len(names), (STRENGTH + self.d * parent) / self.symbols), self.d, names.astype(np.uint64), n)
            yield names, group, t, t0

    def parent(self, c0: np.ndarray, t0: np.ndarray, total: float, tables: float) -> np.ndarray:
        return (c0 - self.d * t0 + (STRENGTH + self.d * tables) / self.symbols) / (STRENGTH + total)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    got = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches]
    return [np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in range(len(names))]


def _context_totals(batches: Iterator[pa.RecordBatch], state: Contexts) -> Iterator[pa.RecordBatch]:
    symbol, context, c = _columns(batches, ["symbol", "context", "c"])
    for *_, group, t, t0 in state.sweep(symbol, context, c):  # the last sweep counts
        pass
    tables = np.concatenate([[t0.sum()], np.bincount(context, t, state.contexts)])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tables))), pa.array(tables)], names=["restaurant", "tables"])


def _context_probabilities(batches: Iterator[pa.RecordBatch], state: Contexts) -> Iterator[pa.RecordBatch]:
    """(symbol, its log10 probability in every context), averaged over the sweeps after burn-in."""
    symbol, context, c = _columns(batches, ["symbol", "context", "c"])
    names, p = np.unique(symbol), 0
    for n, (_, group, t, t0) in enumerate(state.sweep(symbol, context, c)):
        if n > BURN_IN and n < len(state.totals):
            tables, parent = np.array(state.totals[n][0]), state.totals[n][1]
            p0 = state.parent(np.bincount(group, t, len(names)), t0, tables.sum(), parent)
            dense = np.outer(p0, STRENGTH + state.d * tables)
            np.add.at(dense, (group, context), c - state.d * t)
            p = p + dense / (STRENGTH + state.customers)
    if len(names):
        logs = np.log10(p / SAMPLES).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(logs), pa.list_(pa.float32()))], names=["symbol", "logs"])


class Words:
    """Gibbs state of the class restaurants over words. Totals by class: customers, dishes, and tables by sweep."""

    def __init__(self, discount: float):
        self.d = discount
        self.customers, self.dishes, self.tables = np.zeros(CLASSES), np.zeros(CLASSES), []

    def seated(self, k: np.ndarray, c: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Tables of every word after sweep n, which needs the totals of the one before only; at 0 every word has one."""
        if not n:
            return np.ones(len(c))
        return seat(c, (STRENGTH + self.d * self.tables[n - 1][k]) / (self.dishes[k] + 1), self.d, key, n)

    def unseen(self) -> np.ndarray:
        """Averaged probability, by class, of each word never seen."""
        used = self.tables[BURN_IN + 1:BURN_IN + 1 + SAMPLES]
        return sum((STRENGTH + self.d * t) / (self.dishes + 1) / (STRENGTH + self.customers) for t in used) / SAMPLES


def _listed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(word, h, c, k) of the words that aren't symbols: hash, count and class."""
    from xxhash import xxh64_intdigest
    for batch in batches:
        batch = batch.filter(pc.and_(pc.less(batch.column("c").cast(pa.float64()), least), pc.not_equal(batch.column("word"), pa.scalar(END, pa.binary()))))
        words = batch.column("word")
        h = np.array([*map(xxh64_intdigest, words.to_pylist())], np.uint64)
        yield pa.RecordBatch.from_arrays([words, pa.array(h.view(np.int64)), batch.column("c"), pa.array(classes_of(words))], names=["word", "h", "c", "k"])


def _dishes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, count and key."""
    return batch.column("k").to_numpy(), batch.column("c").to_numpy(), batch.column("h").to_numpy().view(np.uint64)


def _word_totals(batches: Iterator[pa.RecordBatch], state: Words) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, CLASSES))
    for batch in batches:
        k, c, key = _dishes(batch)
        t = state.seated(k, c, key, len(state.tables))
        total += [np.bincount(k, x, CLASSES) for x in (c, np.ones(len(c)), t)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *[pa.array(x) for x in total]], names=["class", "c", "dishes", "tables"])


def _word_probabilities(batches: Iterator[pa.RecordBatch], state: Words) -> Iterator[pa.RecordBatch]:
    """(word, h, c, p): the log10 probability of a word in its class."""
    for batch in batches:
        k, c, key = _dishes(batch)
        p = np.zeros(len(c))
        for n in range(BURN_IN + 1, BURN_IN + SAMPLES + 1):
            p += (c - state.d * state.seated(k, c, key, n) + (STRENGTH + state.d * state.tables[n][k]) / (state.dishes[k] + 1)) / (STRENGTH + state.customers[k])
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("h"), batch.column("c"), pa.array(np.log10(p / SAMPLES))], names=["word", "h", "c", "p"])


# ---- restaurants of preceding words -------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.int64).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(29))


def dish_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(before) ^ word.astype(np.int64).view(np.uint64)


def discounts(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    return np.minimum(0.95, (ones + PRIOR[0]) / (ones + 2 * twos + PRIOR[1]))


def numbers_of(t: Tokens, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A number for each of the different words: its place in the table, or its hash."""
    from xxhash import xxh64_intdigest
    out, rare = np.empty(len(classes), np.int64), np.flatnonzero(classes >= 0)
    out[t.code] = at
    out[rare] = np.array([*map(xxh64_intdigest, t.words.take(pa.array(rare)).to_pylist())], np.uint64).view(np.int64)
    return out


def followed(t: Tokens, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every token and of the one before it in its text."""
    word = numbers[t.code]
    before = np.concatenate([[START], word[:-1]])
    before[t.starts[:-1]] = START
    return before, word


class Frequent:
    """Gibbs state of the restaurants of context words and the start, by number of the context."""

    def __init__(self, contexts: int):
        self.customers, self.d, self.tables = np.zeros(contexts), np.full(contexts, 0.5), []


class Model:
    """What scoring tasks get: bounded tables. ``rare`` is the table (h, c, p) of all other words."""

    def __init__(self, symbols: Symbols, contexts: np.ndarray, words: np.ndarray, unseen: np.ndarray, distinct: int, classes: np.ndarray):
        self.symbols, self.contexts, self.words, self.unseen, self.distinct, self.classes = symbols, contexts, words, unseen, distinct, classes
        self.base = np.log10((symbols.count + 0.5) / (symbols.total + 0.5 * (distinct + 1)))
        self.frequent = Frequent(symbols.contexts)

    def context_of(self, number: np.ndarray) -> np.ndarray:
        """Number of a preceding word's context, -1 of a word that isn't one."""
        listed = (number >= 0) & (number < len(self.symbols.index))
        return np.where(number == START, 0, np.where(listed & (self.symbols.context[np.where(listed, number, 0)] > 0), self.symbols.context[np.where(listed, number, 0)], -1))

    def base_of(self, context: np.ndarray, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Probability of a word where the nearest context is this one; of a rare one (k: its class) that of its class."""
        own = np.where(k < 0, word, 0)
        return 10.0 ** (self.contexts[np.where(k < 0, self.symbols.symbol[own], k), context].astype(np.float64) + np.where(k < 0, self.words[own], 0.0))

    def weights(self, base: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Base of a dish's seats: rare words count as if all their customers sat here."""
        return np.where(k < 0, base, base * np.minimum(1.0, c / np.maximum(self.classes[k], 1)))


def _frequent_pairs(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(context, word, k, c): words that follow a context or the start at once, in the training documents."""
    m: Model = model.value
    for _, t in _tokens(batches, train=True):
        _, _, at, classes = m.symbols.read(t)
        numbers = numbers_of(t, at, classes)
        before, _ = followed(t, numbers)
        context = m.context_of(before)
        some = context >= 0
        pair, c = np.unique(context[some] * len(numbers) + t.code[some], return_counts=True)
        context, code = np.divmod(pair, len(numbers))
        yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(numbers[code]), pa.array(classes[code]), pa.array(c)], names=["context", "word", "k", "c"])


def _frequent_totals(batches: Iterator[pa.RecordBatch], model, state: Frequent, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tables of every restaurant after one more sweep, which needs the totals of the one before only."""
    m: Model = model.value
    total = np.zeros(len(state.customers))
    for batch in batches:
        context, word, k, c = (batch.column(n).to_numpy() for n in ("context", "word", "k", "c"))
        t = np.ones(len(c))
        if n := len(state.tables):
            base = m.weights(m.base_of(context, word, k), c, k)
            t = seat(c, (STRENGTH + state.d[context] * state.tables[n - 1][context]) * base, state.d[context], dish_key(numbers[context], word), n)
        total += np.bincount(context, t, len(total))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["context", "tables"])


def seat_frequent(docs: DataFrame, model: Model) -> Frequent:
    spark, s = docs.sparkSession, model.symbols
    sent = spark.sparkContext.broadcast(model)
    pairs = docs.select("doc_id", "text").mapInArrow(lambda it: _frequent_pairs(it, sent), "context long, word long, k long, c long")
    customers = cut(pairs.groupBy("context", "word", "k").agg(F.sum("c").alias("c")))
    state, numbers = Frequent(s.contexts), np.full(s.contexts, START)
    numbers[s.context[s.context > 0]] = np.flatnonzero(s.context > 0)
    ones, twos = np.zeros(s.contexts), np.zeros(s.contexts)
    for r in customers.groupBy("context").agg(F.sum("c").alias("c"), *[F.count(F.when(F.col("c") == n, 1)).alias(f"n{n}") for n in (1, 2)]).collect():
        state.customers[r["context"]], ones[r["context"]], twos[r["context"]] = r["c"], r["n1"], r["n2"]
    state.d = discounts(ones, twos)
    for _ in range(BURN_IN + SAMPLES + 1):
        found = customers.mapInArrow(lambda it: _frequent_totals(it, sent, state, numbers), "context long, tables double").groupBy("context").agg(F.sum("tables").alias("t")).collect()
        tables = np.zeros(s.contexts)
        for r in found:
            tables[r["context"]] = r["t"]
        state.tables.append(tables)
    return state


def shares(m: Model, before: np.ndarray, word: np.ndarray, k: np.ndarray, base: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of tokens, all of whose preceding words have all their customers of these words among them: a token's
    probability after the word before it is a + b x base, averaged over the sweeps after burn-in."""
    order = np.lexsort((word, before))
    before, word = before[order], word[order]
    other = np.concatenate([[True], before[1:] != before[:-1]])
    of, dish = np.cumsum(other) - 1, np.cumsum(other | np.concatenate([[True], word[1:] != word[:-1]])) - 1
    at = np.flatnonzero(np.concatenate([[True], dish[1:] != dish[:-1]]))  # a token of each dish
    g, first, here = of[at], np.flatnonzero(other), train[order]
    c = np.bincount(dish[here], minlength=len(at))
    mean = np.bincount(dish[here], base[order][here], len(at)) / np.maximum(c, 1)
    weight, key = m.weights(mean, c, k[order][at]), dish_key(before[at], word[at])
    context = m.context_of(before[first])
    often, f = context >= 0, m.frequent
    own = lambda x: np.bincount(g, x, len(first))
    given = lambda x, all_: np.where(often, all_[np.maximum(context, 0)], x)  # noqa: E731  context words have rows elsewhere too
    d, customers, tables = given(discounts(own(c == 1), own(c == 2)), f.d), given(own(c), f.customers), given(own(c > 0), f.tables[0])
    a, b = np.zeros(len(at)), np.zeros(len(first))
    for n in range(1, BURN_IN + SAMPLES + 1):
        t = seat(c, (STRENGTH + d[g] * tables[g]) * weight, d[g], key, n)
        tables = given(own(t), f.tables[n])
        if n > BURN_IN:
            a += (c - d[g] * t) / (STRENGTH + customers[g]) / SAMPLES
            b += (STRENGTH + d * tables) / (STRENGTH + customers) / SAMPLES
    out = np.empty((2, len(order)))
    out[0, order], out[1, order] = a[dish], b[of]
    return out[0], out[1]


# ---- the model -----------------------------------------------------------------------------------------------------

def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    spark = docs.sparkSession
    counts = word_counts(docs)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = sums[0], sums[1]
    common = counts.filter((F.col("c") >= TABLE_SHARE * total) | (F.col("word") == F.lit(bytearray(END)))).collect()
    symbols = Symbols([(bytes(r["word"]), r["c"]) for r in common], total)
    sent = spark.sparkContext.broadcast(symbols)

    # contexts over symbols
    pairs = docs.select("doc_id", "text").mapInArrow(lambda it: _pairs(it, sent), "symbol long, context long, c long")
    customers = cut(pairs.groupBy("symbol", "context").agg(F.sum("c").alias("c")).repartition("symbol").sortWithinPartitions("symbol", "context"))
    per = {r["context"]: r["c"] for r in customers.groupBy("context").agg(F.sum("c").alias("c")).collect()}
    few = customers.agg(*[F.count(F.when(F.col("c") == n, 1)) for n in (1, 2)]).first()
    state = Contexts(symbols.size, symbols.contexts, [per.get(i, 0) for i in range(symbols.contexts)], discount_of(*few))
    for _ in range(BURN_IN + SAMPLES + 1):
        found = customers.mapInArrow(lambda it: _context_totals(it, state), "restaurant long, tables double").groupBy("restaurant").agg(F.sum("tables").alias("t")).collect()
        tables = {r["restaurant"]: r["t"] for r in found}
        state.totals.append(([tables.get(i + 1, 0.0) for i in range(symbols.contexts)], tables.get(0, 0.0)))
    tables, parent = np.mean([t for t, _ in state.totals[BURN_IN + 1:]], axis=0), np.mean([p for _, p in state.totals[BURN_IN + 1:]])
    # a symbol without customers (a class without words) has its share of the base in every context
    none = (STRENGTH + state.d * parent) / symbols.size / (STRENGTH + tables.sum()) * (STRENGTH + state.d * tables) / (STRENGTH + state.customers)
    logs = np.tile(np.log10(none).astype(np.float32), (symbols.size, 1))
    for r in customers.mapInArrow(lambda it: _context_probabilities(it, state), "symbol long, logs array<float>").collect():
        logs[r["symbol"]] = r["logs"]

    # classes over words
    few = counts.agg(*[F.count(F.when(F.col("c") == n, 1)) for n in (1, 2)]).first()
    words = Words(discount_of(*few))
    least = SYMBOL_SHARE * total
    listed = cut(counts.mapInArrow(lambda it: _listed(it, least), "word binary, h long, c long, k long"))
    for _ in range(BURN_IN + SAMPLES + 1):
        found = listed.select("h", "c", "k").mapInArrow(lambda it: _word_totals(it, words), "class long, c double, dishes double, tables double").groupBy("class").agg(*[F.sum(n).alias(n) for n in ("c", "dishes", "tables")]).collect()
        tables = np.zeros(CLASSES)
        for r in found:
            words.customers[r["class"]], words.dishes[r["class"]], tables[r["class"]] = r["c"], r["dishes"], r["tables"]
        words.tables.append(tables)
    scored = listed.mapInArrow(lambda it: _word_probabilities(it, words), "word binary, h long, c long, p double")
    p = np.zeros(len(symbols.count))
    for r in scored.filter(F.col("c") >= TABLE_SHARE * total).select("word", "p").collect():
        p[symbols.index[bytes(r["word"])]] = r["p"]
    rare = scored.filter(F.col("c") < TABLE_SHARE * total).select("h", "c", "p")
    model = Model(symbols, logs, p, np.log10(words.unseen()), distinct, words.customers)
    model.frequent = seat_frequent(docs, model)
    return model, rare


#: Columns of packed tokens.
PACKED = {"before": np.int64, "word": np.int64, "row": np.int64, "context": np.int16, "k": np.int8, "held": np.bool_}


def _packed(columns: dict[str, np.ndarray], i: int, j: int) -> bytes:
    return (j - i).to_bytes(4, "little") + pa.compress(b"".join(columns[n][i:j].tobytes() for n in PACKED), "zstd", asbytes=True)


def _unpacked(parts: list[bytes]) -> dict[str, np.ndarray]:
    width, found = sum(np.dtype(kind).itemsize for kind in PACKED.values()), {n: [] for n in PACKED}
    for part in parts:
        n = int.from_bytes(part[:4], "little")
        data, at = pa.decompress(part[4:], n * width, "zstd", asbytes=True), 0
        for name, kind in PACKED.items():
            found[name].append(np.frombuffer(data, kind, n, at))
            at += found[name][-1].nbytes
    return {n: np.concatenate(v) for n, v in found.items()}


def _dealt(batches: Iterator[pa.RecordBatch], model, kept: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row per document with what needs no preceding word, and its tokens as packed rows by bucket of the preceding word."""
    m: Model = model.value
    s, base = m.symbols, np.append(m.base, 0.0)  # a rare word's index, -1, adds nothing here
    for batch, t in _tokens(batches):
        context, symbol, at, classes = s.read(t)
        del symbol
        row, held = batch.column("__row").to_numpy(), np.array([held_out(d) for d in batch.column("doc_id").to_pylist()], bool)
        total = lambda x, kind: pa.array(np.add.reduceat(x, t.starts[:-1], dtype=kind))  # noqa: E731  every text has its end
        columns = [pa.array(row % buckets), pa.nulls(len(t), pa.binary()), *[batch.column(n) for n in ["__row", *kept]],
                   pa.array(held), pa.array(np.diff(t.starts)), total(at >= 0, np.int64), total(base[at], np.float64)]
        names = ["__bucket", "__tokens", "__row", *kept, "held_out", "n_tokens", "n_known", "base_score"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        before, word = followed(t, numbers_of(t, at, classes))
        del at
        bucket = _mixed(before) ^ np.where(m.context_of(before) >= 0, _mixed(word + 1), np.uint64(0))
        bucket = ((bucket >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((before, bucket))
        found, edges = np.unique(bucket[order], return_index=True)
        own = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(t.starts))[order]
        sent = {"before": before[order], "word": word[order], "row": row[own], "context": context.astype(np.int16)[order], "k": classes.astype(np.int8)[t.code][order], "held": held[own]}
        del before, word, context, bucket, order, own
        packed = [_packed(sent, i, j) for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(sent["row"])], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(packed, pa.binary()), *[pa.nulls(len(found), c.type) for c in columns[2:]]], names=names)


def _followed(batches: Iterator[pa.RecordBatch], model, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are; their tokens' log probabilities summed by document, those of rare words one by one as
    (word, k, a, b). Rows come sorted by bucket."""
    m: Model = model.value
    same = ["__row", *kept, "held_out", "n_tokens", "n_known", "base_score"]
    types: list[pa.DataType] = []
    rows, sums = [], []  # of documents, so far

    def out(n: int, **columns) -> pa.RecordBatch:
        more = {"score": pa.float64(), "__word": pa.int64(), "__k": pa.int32(), "__a": pa.float32(), "__b": pa.float32()}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kind)) for c, kind in [*zip(same, types, strict=True), *more.items()]], names=[*same, *more])

    def merged() -> None:
        own, at = np.unique(np.concatenate(rows), return_inverse=True)
        rows[:], sums[:] = [own], [np.bincount(at, np.concatenate(sums), len(own))]

    def flushed() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows[0]) if rows else 0, 1 << 16):
            part = slice(i, i + (1 << 16))
            yield out(len(rows[0][part]), __row=pa.array(rows[0][part]), score=pa.array(sums[0][part]))
        rows.clear(), sums.clear()

    def bucket(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = _unpacked(parts)
        word, row, k = x["word"], x["row"], x["k"].astype(np.int64)
        base = m.base_of(x["context"].astype(np.int64), word, k)
        a, b = shares(m, x["before"], word, k, base, ~x["held"])
        del x
        b *= base
        common = k < 0
        rows.append(row[common]), sums.append(np.log10(a[common] + b[common]))
        merged()
        if len(rows[0]) > 1 << 20:
            yield from flushed()
        rare = np.flatnonzero(~common)
        for i in range(0, len(rare), 1 << 16):
            r = rare[i:i + (1 << 16)]
            yield out(len(r), __row=pa.array(row[r]), __word=pa.array(word[r]), __k=pa.array(k[r], pa.int32()), __a=pa.array(a[r], pa.float32()), __b=pa.array(b[r], pa.float32()))

    now, parts = None, []
    for batch in batches:
        types = types or [batch.schema.field(c).type for c in same]
        docs = batch.filter(pc.is_null(batch.column("__tokens")))
        if len(docs):
            yield out(len(docs), **{c: docs.column(c) for c in same})
        tokens = batch.filter(pc.is_valid(batch.column("__tokens")))
        for n, part in zip(tokens.column("__bucket").to_pylist(), tokens.column("__tokens"), strict=True):
            if n != now and parts:
                yield from bucket(parts)
                parts = []
            now = n
            parts.append(part.as_py())
    if parts:
        yield from bucket(parts)
    yield from flushed()


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """The documents' columns but the text, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    new = ["held_out", "n_tokens", "n_known", "base_score", "score"]
    kept = [f for f in docs.schema.fields if f.name != "text" and f.name not in new]
    own = ", ".join(["__row long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "held_out boolean, n_tokens long, n_known long, base_score double"])
    sent, names = spark.sparkContext.broadcast(model), [f.name for f in kept]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.symbols.total // TASK_TOKENS))
    dealt = docs.drop(*new).withColumn("__row", F.monotonically_increasing_id()).mapInArrow(
        lambda it: _dealt(it, sent, names, BUCKETS * tasks), f"__bucket long, __tokens binary, {own}")
    found = dealt.repartitionById(tasks, F.floor(F.col("__bucket") / BUCKETS).cast("int")).sortWithinPartitions("__bucket").mapInArrow(
        lambda it: _followed(it, sent, names), f"{own}, score double, __word long, __k int, __a float, __b float")
    # rows without a rare word find none, each at a place of its own
    words = rare.select(F.col("h").alias("__h"), F.col("c").alias("__c"), F.col("p").alias("__p"))
    joined = found.join(words, F.coalesce("__word", "__row") == F.col("__h"), "left")
    is_rare = F.col("__word").isNotNull()
    known = F.when(is_rare & (F.col("__c") > 0), 1).otherwise(0)
    base = F.when(is_rare, F.log10((F.coalesce("__c", F.lit(0)) + 0.5) / F.lit(model.symbols.total + 0.5 * (model.distinct + 1))))
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in model.unseen]), F.col("__k") + 1)
    rare_score = F.when(is_rare, F.log10(F.col("__a").cast("double") + F.col("__b").cast("double") * F.pow(F.lit(10.0), F.coalesce("__p", unseen))))
    return joined.groupBy("__row").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in [*names, "held_out"]], F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(known)).alias("n_known"), (F.sum("base_score") + F.coalesce(F.sum(base), F.lit(0.0))).alias("base_score"),
        (F.coalesce(F.sum("score"), F.lit(0.0)) + F.coalesce(F.sum(rare_score), F.lit(0.0))).alias("score")).withColumn(
        "train_tokens", F.lit(model.symbols.total).cast("bigint")).drop("__row")


def scores(docs: DataFrame) -> DataFrame:
    """Trains on the documents outside the held-out fold and scores all; perplexity is 10 ^ (-score / n_tokens)."""
    docs = docs.select("doc_id", "text")
    model, rare = train(docs)
    return score(docs, model, rare)
