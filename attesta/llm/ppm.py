"""Language-model scores by prediction by partial matching over byte contexts."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_ROWS, written
from .common import map_batches, shared

END = 10  # the byte that ends a document; words are followed by a space
LANE = 256
HELD = 1 << 17
PIECE = 1 << 19  # bytes of text scored at once: a string of 8 bytes, a number and their temporaries for each


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lowered, split at ASCII white space."""
    return (raw or b"").lower().split()


def stream(words: list[bytes], order: int) -> bytes:
    """What the model reads of a document: `order` ends before it as first context, then its words and an end."""
    return bytes([END]) * order + b"".join([w + b" " for w in words]) + bytes([END])


@dataclass
class Trie:
    """A context trie as an automaton: log10 probability and next state by (state, symbol).

    States are contexts of up to `order` bytes; the state after some text is the longest context kept
    that the text ends in. Symbols are the training bytes, and one more for all others.
    """

    order: int
    symbols: np.ndarray  # byte -> symbol
    logp: np.ndarray  # flat, state * width + symbol
    step: np.ndarray  # flat, the next state times width
    width: int

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each stream (its leading context not counted).

        All streams form one line, cut into lanes that start `order` symbols early to find their state.
        """
        d = self.order
        line = self.symbols[np.frombuffer(b"".join(streams), np.uint8)]
        n = len(line)
        lanes = -(-n // LANE)
        padded = np.full(d + lanes * LANE, self.symbols[END], line.dtype)
        padded[d : d + n] = line
        views = np.lib.stride_tricks.sliding_window_view(padded, d + LANE)[::LANE]
        state = np.zeros(len(views), np.int64)
        out = np.empty((LANE, len(views)), np.float32)
        for t in range(d + LANE):
            at = state + views[:, t]
            if t >= d:
                out[t - d] = self.logp[at]
            state = self.step[at].astype(np.int64)
        values = out.T.reshape(-1)[:n].astype(np.float64)
        ends = np.cumsum([len(s) for s in streams])
        starts = ends - [len(s) for s in streams]
        for i in range(d):
            values[starts + i] = 0.0
        return np.add.reduceat(values, starts)


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the symbols counted in each row, and of escape (1 for a row without any)."""
    total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    some = np.maximum(total, np.float32(1))
    return np.maximum(counts - np.float32(0.5), 0) / some, np.where(total > 0, kinds / (2 * some), 1.0).astype(np.float32)


def build(order: int, codes: list[np.ndarray], symbols: list[np.ndarray], counts: list[np.ndarray]) -> Trie:
    """The automaton of the contexts kept: per order, packed context, following byte and count.

    Escape by method D: a context with N occurrences and T different followers gives T / 2N to what it
    has not seen (half a count from each follower), which the context a byte shorter then shares out, without the symbols the
    longer one has seen (exclusion); below order 0 all bytes left are equally likely.
    """
    seen_bytes = np.unique(symbols[0])
    a = len(seen_bytes)
    width = a + 1
    lookup = np.full(256, a, np.int16)
    lookup[seen_bytes] = np.arange(a)
    names = [np.unique(c) for c in codes]
    base = np.concatenate(([0], np.cumsum([len(n) for n in names])))
    logp = np.empty((base[-1], width), np.float32)
    step = np.zeros((base[-1], width), np.int32)
    table_below = lower_below = None
    for k, keys in enumerate(names):
        table = np.zeros((len(keys), width), np.float32)
        np.add.at(table, (np.searchsorted(keys, codes[k]), lookup[symbols[k]]), counts[k])
        lower = np.full((len(keys), width), 1.0 / max(1, 256 - a), np.float32)
        parent = np.zeros(len(keys), np.int64) if k == 0 else np.searchsorted(names[k - 1], keys & np.uint64((1 << 8 * (k - 1)) - 1))
        here = slice(base[k], base[k + 1])
        for lo in range(0, len(keys), 4096):  # rows at a time, to bound the memory
            rows = slice(lo, lo + 4096)
            seen = table[rows] > 0
            if k:
                below = parent[rows]
                left = np.where(seen, np.float32(0), table_below[below])
                shares, escape = _shares(left)
                lower[rows] = np.where(left > 0, shares, np.where(table_below[below] > 0, 0, escape * lower_below[below]))
            shares, escape = _shares(table[rows])
            logp[here][rows] = np.log10(np.maximum(np.where(seen, shares, escape * lower[rows]), 1e-30))
        if k:
            step[here] = step[base[k - 1] + parent]
        if k < order and len(names) > k + 1 and len(names[k + 1]):
            longer = names[k + 1]
            mine = np.searchsorted(keys, longer >> np.uint64(8))
            ok = mine < len(keys)
            ok[ok] = keys[mine[ok]] == (longer[ok] >> np.uint64(8))
            step[base[k] + mine[ok], lookup[(longer[ok] & np.uint64(255)).astype(np.int64)]] = base[k + 1] + np.flatnonzero(ok)
        table_below, lower_below = table, lower
    return Trie(order, lookup, logp.ravel(), (step * width).ravel(), width)


def _grams(streams: list[bytes], order: int) -> np.ndarray:
    """The strings of order + 1 bytes that end in each symbol read, packed, first byte highest; stream after stream."""
    line = np.frombuffer(b"".join(streams), np.uint8)
    n = len(line) - order
    own = np.zeros(n, np.uint64)
    for lo in range(0, n, HELD):
        g = own[lo : lo + HELD]
        for i in range(order + 1):
            g <<= np.uint64(8)
            g |= line[lo + i : lo + i + len(g)]
    # strings that end in the leading context of a document are not part of it
    ends = np.cumsum([len(x) for x in streams])
    keep = np.ones(n, bool)
    for i in range(order):
        keep[ends[:-1] + i - order] = False
    return own[keep]


def _gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(gram, n, times): how often each string of order + 1 bytes occurs in the rows `learned`, and in all."""

    def run(cols, _):
        out: list[list[np.ndarray]] = [[], [], []]
        for learned in (True, False):
            streams = [stream(words_of(t), order) for t, own in zip(*cols) if own is learned]
            if streams:
                values, times = np.unique(_grams(streams, order), return_counts=True)
                for column, part in zip(out, (values.astype(np.int64), times * learned, times)):
                    column.append(part)
        return [np.concatenate(column) for column in out]

    counted = map_batches(texts.select("text", "learned"), run, "gram bigint, n bigint, times bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def _context(k: int) -> Column:
    """The last `k` bytes of context of `gram`, packed."""
    return F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("ctx")


def _context_counts(grams: DataFrame, order: int) -> DataFrame:
    """(k, ctx, sym, n): how often each byte follows each context of up to `order` bytes in the rows learned."""
    symbol = F.col("gram").bitwiseAND(F.lit(255)).alias("sym")
    parts = [F.struct(F.lit(k).alias("k"), _context(k), symbol) for k in range(order + 1)]
    return grams.filter("n > 0").select("n", F.inline(F.array(*parts))).groupBy("k", "ctx", "sym").agg(F.sum("n").alias("n"))


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """(gram, times, logp): the log10 probability of the last byte of each string after the bytes before it.

    All contexts that occur in the rows learned count, however rare; nothing of the model is kept in
    one place. A string that was learned takes its share of its own context. The others escape to
    shorter contexts, one length after the other and by joins: what is looked up of a length is
    distinct, so a key has at most 256 rows. Escapes and exclusion are those of `build`.
    """
    ctx = F.shiftrightunsigned("gram", 8)
    of_context = grams.filter("n > 0").groupBy(ctx).agg(F.sum("n").alias("total"), F.collect_list(F.struct("gram", "times", "n")).alias("own"))
    known = of_context.select("total", F.inline("own")).select("gram", "times", F.log10((F.col("n") - 0.5) / F.col("total")).alias("logp"))

    counts = written(_context_counts(grams, order))
    above = counts.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("up"), "sym", F.col("n").alias("n_up"))
    up = F.expr("ctx & (shiftleft(1L, cast(8 * (k - 1) as int)) - 1)")
    # what the context a byte shorter counts of the bytes that this one has seen
    met = counts.filter("k > 0").withColumn("up", up).join(above, ["k", "up", "sym"]).groupBy("k", "ctx").agg(F.sum("n_up").alias("met"))
    sums = counts.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    contexts = written(sums.join(met, ["k", "ctx"], "left"))
    bytes_seen = counts.filter("k = 0").count()

    new = written(grams.filter("n = 0").select("gram", "times"))
    below = None
    for k in range(order + 1):
        asked = new.select(_context(k), F.col("gram").bitwiseAND(F.lit(255)).alias("sym"))
        rows = asked.distinct() if k < order else asked  # whole strings are distinct already
        rows = rows.join(counts.filter(F.col("k") == k).drop("k"), ["ctx", "sym"], "left")
        rows = rows.join(contexts.filter(F.col("k") == k).drop("k"), "ctx", "left")
        if below is None:
            lower = shorter = F.lit(1.0 / max(1, 256 - bytes_seen))
        else:
            rows = rows.withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, ["up", "sym"])
            left = F.col("total_up") - F.col("met")
            some = F.greatest(left, F.lit(1))
            escape = F.when(left > 0, (F.col("kinds_up") - F.col("kinds")) / (2 * some)).otherwise(1.0)
            lower = F.when(F.col("n_up").isNotNull(), (F.col("n_up") - 0.5) / some).otherwise(escape * F.col("lower_up"))
            shorter = F.col("p_up")
        p = (
            F.when(F.col("n").isNotNull(), (F.col("n") - 0.5) / F.col("total"))
            .when(F.col("total").isNotNull(), F.col("kinds") / (2 * F.col("total")) * lower)
            .otherwise(shorter)
        )
        rows = rows.select("ctx", "sym", "n", "total", "kinds", lower.alias("lower"), p.alias("p"))
        below = rows.select(F.col("ctx").alias("up"), "sym", *[F.col(c).alias(f"{c}_up") for c in ("n", "total", "kinds", "lower", "p")])
    gram = F.shiftleft("ctx", 8).bitwiseOR(F.col("sym")).alias("gram")
    return known.unionByName(new.join(rows.select(gram, F.log10("p").alias("logp")), "gram"))


EMPTY = np.uint64((1 << 64) - 1)  # not UTF-8


@dataclass
class Hot:
    """Log probabilities of a bounded number of strings, in a hash table with linear probing."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def place(grams: np.ndarray, size: int) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    @classmethod
    def of(cls, grams: np.ndarray, logp: np.ndarray) -> Hot:
        size = 1 << max(2, (2 * len(grams)).bit_length())
        out = cls(np.full(size, EMPTY), np.full(size, np.nan))
        for lo in range(0, len(grams), HELD):
            out._put(grams[lo : lo + HELD], logp[lo : lo + HELD])
        return out

    def _put(self, grams: np.ndarray, logp: np.ndarray) -> None:
        at = self.place(grams, len(self.keys))
        while len(grams):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            spots, first = np.unique(at[free], return_index=True)
            took = free[first]
            self.keys[spots], self.values[spots] = grams[took], logp[took]
            rest = np.ones(len(grams), bool)
            rest[took] = False
            grams, logp, at = grams[rest], logp[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The values of the strings, NaN for those not held."""
        out = np.full(len(grams), np.nan)
        for lo in range(0, len(grams), HELD):
            g, part = grams[lo : lo + HELD], out[lo : lo + HELD]
            at, rows = self.place(g, len(self.keys)), np.arange(len(g))
            while len(rows):
                key = self.keys[at]
                hit = key == g
                part[rows[hit]] = self.values[at[hit]]
                on = ~hit & (key != EMPTY)
                g, rows, at = g[on], rows[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


def _hot_of(rows: DataFrame) -> Hot:
    """The table of rows(gram, logp); what is collected for it is let go with the call."""
    top = rows.toArrow()
    return Hot.of(top["gram"].to_numpy().view(np.uint64), top["logp"].to_numpy())


def fit(texts: DataFrame, order: int = 5, cells: int = 5_000_000) -> Trie | None:
    """A trie from all texts (column text) of a table; None without rows.

    Counts are over the whole table and are added up in Spark. The contexts that occur most often are
    kept, as many as fit into `cells` (contexts times different bytes): 8 bytes each is the size of the
    model, which does not grow with the corpus, unlike what is counted for it. `score` does not use it:
    it keeps every context.
    """
    counts = written(_context_counts(_gram_counts(texts.withColumn("learned", F.lit(True)), order), order))
    totals = written(counts.groupBy("k", "ctx").agg(F.sum("n").alias("total")))
    width = counts.filter("k = 0").count() + 1
    # the least total kept, from a histogram of bounded size (64 steps per doubling)
    step = F.floor(F.log2("total") * 64)
    histogram = totals.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bin").desc()).collect()
    room, least = cells // width, None
    for r in histogram:
        room -= r["n"]
        if room < 0 and least is not None:
            break
        least = r["bin"]
    if least is None:
        return None
    kept = totals.filter((step >= F.lit(least)) | (F.col("k") == 0)).select("k", "ctx")
    model = written(counts.join(kept, ["k", "ctx"]))
    columns: list[list[np.ndarray]] = [[], [], []]
    for k in range(order + 1):
        own = model.filter(F.col("k") == k).select("ctx", F.col("sym").cast("short").alias("sym"), F.col("n").cast("float").alias("n")).toArrow()
        for column, name, kind in zip(columns, ("ctx", "sym", "n"), (np.uint64, np.int16, np.float32)):
            column.append(own[name].to_numpy().astype(kind))
    return build(order, *columns)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word: binary, n) of all words of a table."""

    def run(cols, _):
        counts: Counter = Counter()
        for t in cols[0]:
            counts.update(words_of(t))
        return [list(counts), list(counts.values())]

    return map_batches(texts.select("text"), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = 5, frequent: int = 100_000,
    hot: int = 1_000_000,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Tokens are the words and one end per document. `base_score` is the add-one unigram log10
    probability with counts from the rows where `train` holds, `score` that of byte contexts of up to
    `order` bytes, all that occur in the same rows (`gram_scores`). The counts of the `frequent` most
    frequent words and the probabilities of at most `hot` strings of order + 1 bytes, those that occur
    most (fixed numbers), are broadcast; the other tokens and strings are joined with the counts of all
    words and the probabilities of all strings. A null text counts as empty; repeated rows
    stay; without any training row every byte and token is equally likely.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learn = docs.filter(train).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = written(word_counts(learn))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learn.count()
    total, kinds = sums["n"] + ends, sums["v"] + (ends > 0)
    floor = np.log10(total + kinds + 1)
    rank = counts.orderBy(F.col("n").desc(), "word").limit(frequent).toArrow()
    common = dict(zip(rank["word"].to_pylist(), (np.log10(rank["n"].to_numpy() + 1.0) - floor).tolist()))
    learned = F.coalesce(train, F.lit(False)).alias("learned")
    counted = written(_gram_counts(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), learned), order), BATCH_ROWS)
    grams = written(gram_scores(counted, order))
    # the least number of occurrences broadcast, from a histogram of bounded size (64 steps per doubling)
    step = F.floor(F.log2("times") * 64)
    room, least = hot, None
    for r in grams.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bin").desc()).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["bin"]
    often = F.lit(False) if least is None else step >= F.lit(least)
    words = docs.sparkSession.sparkContext.broadcast(common)
    held = shared(docs, _hot_of(grams.filter(often).select("gram", "logp")))
    end_score = float(np.log10(ends + 1) - floor)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(cols, own):
        look, model = own[0].get, own[1]
        out: list[list] = [cols[0], cols[2], [], [], [], [], [], [], []]
        streams = []
        for raw in cols[1]:
            words = words_of(raw)
            found = list(map(look, words))
            rare = Counter([w for w, f in zip(words, found) if f is None])
            out[2].append(len(words) + 1)
            out[3].append(len(words) - rare.total() + (ends > 0))
            out[4].append(sum([f for f in found if f is not None]) + end_score)
            out[6].append([{"word": w, "times": n} for w, n in rare.items()])
            streams.append(stream(words, order))
        found = _grams(streams, order)
        logp = model.find(found)
        stops = np.cumsum([len(s) - order for s in streams])
        missed = np.flatnonzero(np.isnan(logp))
        logp[missed] = 0.0
        out[5] = np.add.reduceat(logp, np.concatenate(([0], stops[:-1]))).tolist()
        for rest in np.split(found[missed].astype(np.int64), np.searchsorted(missed, stops[:-1])):
            values, times = np.unique(rest, return_counts=True)
            out[7].append(values)
            out[8].append(times)
        return out

    schema = (
        f"doc_id {kind}, text_key bigint, n_tokens bigint, n_known bigint, base double, hot double, rare array<struct<word: binary, times: bigint>>, "
        "grams array<bigint>, gram_times array<bigint>"
    )
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    scored = written(map_batches(keyed, run, schema, lambda: (words.value, held()), PIECE), BATCH_ROWS)
    keys = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    tokens = scored.select(*keys, F.inline("rare"))
    strings = scored.select(*keys, F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("gram_times").alias("seen"))))
    known = tokens.join(counts, "word", "left").select(
        "_id", "_key", "times", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.lit(float(floor)))).alias("part"),
    )
    told = strings.join(grams.filter(~often).select("gram", "logp"), "gram").select("_id", "_key", "seen", (F.col("seen") * F.col("logp")).alias("logp"))
    both = known.unionByName(told, allowMissingColumns=True)
    # equal rows (same id, same text) have equal sums: their joint sum is shared
    per = both.groupBy("_id", "_key").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("times", "known", "part", "seen", "logp")])
    rare = F.aggregate("rare", F.lit(0).cast("bigint"), lambda acc, r: acc + r["times"])
    unseen = F.aggregate("gram_times", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    share = F.when(F.col("times") > 0, F.col("_rare") / F.col("times")).otherwise(F.lit(0.0))
    part_of = F.when(F.col("seen") > 0, F.col("_unseen") / F.col("seen")).otherwise(F.lit(0.0))
    sized = scored.withColumns({"_rare": rare, "_unseen": unseen}).drop("rare", "grams", "gram_times")
    joined = sized.join(per, sized["doc_id"].eqNullSafe(per["_id"]) & (sized["text_key"] == per["_key"]), "left")
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce(F.round(F.col("known") * share), F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce(F.col("part") * share, F.lit(0.0))).alias("base_score"),
        (F.col("hot") + F.coalesce(F.col("logp") * part_of, F.lit(0.0))).alias("score"),
    )
