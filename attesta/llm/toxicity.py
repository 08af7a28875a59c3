"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matches, exception phrases, length-normalised."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared

# fixed values: letters of other scripts, digits and signs that stand for Latin letters; l counts as i, as 1 stands for both
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ԛ": "q", "ԝ": "w", "ӏ": "i", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "i", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i", "_": " ",
}
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | {c: None for c in range(0x300, 0x370)} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF])
_WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def folded(raw: bytes | None) -> list[str]:
    """The words of a text after case, accents, look-alike letters and digit substitutions are folded."""
    text = (raw or b"").decode("utf-8", "replace").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
    return _WORDS.findall(text.translate(_TABLE))


def patterns(words: set[str]) -> set[str]:
    """What a lexicon may hold of these words: ' word ', and ' beginning' of longer words."""
    out = {f" {w} " for w in words if 3 <= len(w) <= 40}
    for n in PREFIXES:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


@dataclass
class Lexicon:
    """Weights of terms, phrases in which a term does not count, and the calibration of the density."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found

    def hits(self, words: list[str], matcher) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms found that no exception phrase covers."""
        if not self.terms or not words:
            return []
        terms, spared = [], []
        for end, (n, weight) in matcher.iter(f" {' '.join(words)} "):
            (spared if weight is None else terms).append((end - n + 1, end, weight))
        if not spared:
            return terms
        return [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b, _ in spared)]

    def score(self, density: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.slope * density, -60, 60))))


def density(weights: float, n_words: int) -> float:
    """Weight found, normalised by length: divided by the root of the words (20 more, for short texts)."""
    return float(np.log1p(weights / np.sqrt(n_words + 20)))


def _counter(kind: str):
    """Counts of (pattern, label) pairs per task, handed on in parts of bounded size."""

    def run(cols, state):
        lexicon, matcher = state or (None, None)
        counts: Counter = Counter()
        for raw, label in zip(*cols):
            words = folded(raw)
            if kind == "terms":
                counts.update((p, label) for p in patterns(set(words)))
                continue
            text, seen = f" {' '.join(words)} ", set()
            for a, b, _ in lexicon.hits(words, matcher):
                end = text.index(" ", max(b, a + 1))
                word = text[a : end + 1]
                if text[a : b + 1] != word:
                    seen.add(word)
                before = text.rfind(" ", 0, a) if a else -1
                after = text.find(" ", end + 1)
                seen |= {text[before : end + 1]} if before >= 0 else set()
                seen |= {text[a : after + 1]} if after >= 0 else set()
            counts.update((p, label) for p in seen if len(p) <= 100)
        return [[p for p, _ in counts], [y for _, y in counts], list(counts.values())]

    return run


def _by_label(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pattern").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )


def pruned(weights: dict[str, float]) -> dict[str, float]:
    """Without the terms that a shorter one, of about the same weight, finds already."""
    out: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t), t)):
        shorter = (term[:n] for n in range(2, len(term)))
        if not any(s in out and out[s] >= weights[term] - 1.0 for s in shorter):
            out[term] = weights[term]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by Newton steps with a small ridge."""
    a = np.column_stack([x, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (w * (y - p)) - 0.05 * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", per_class: int = 20_000,
    min_docs: int = 4, min_weight: float = 2.0, sureness: float = 1.5, max_terms: int = 20_000, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """A lexicon learned from the documents that `labels` (doc_id, toxic) marks and `train` admits.

    Of each class the `per_class` rows with the least hashed ids are the sample, a bound that does not
    grow with the data; their whole texts are used, of a repeated id the least one. The lexicon holds at most
    `max_terms` words of 3 to 40 letters or beginnings of words, those of most toxic documents, and as many
    exceptions of at most 100 letters. A term weighs the logarithm of how many times
    likelier it is in toxic documents, and has to be sure of `min_weight` (`sureness` standard errors off); phrases around a term that only clean documents hold become
    exceptions, beside those given. Null labels, ids and texts are left out; without both classes the
    lexicon is empty and scores say so (0.5 at the most).
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("_id"))
    classes = [marked.withColumnRenamed("_id", doc_id).filter(train & (F.col("toxic") == y)).orderBy("h", doc_id).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(classes[0].union(classes[1]).select(F.col(doc_id).alias("_id"), "toxic"))
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).filter("text is not null").join(sample, F.col("_doc") == F.col("_id"))
    # one row of each id: a repeated one could be any share of the table
    rows = rows.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    sizes = {r.toxic: r.n for r in marked.withColumnRenamed("_id", doc_id).filter(train).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "pattern string, toxic int, n bigint"
    both = min(sizes.get(0, 0), per_class), min(sizes.get(1, 0), per_class)
    weight = F.log((F.col("bad") + 0.5) / (both[1] + 1)) - F.log((F.col("good") + 0.5) / (both[0] + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    found = (
        _by_label(map_batches(rows, _counter("terms"), schema)).filter(F.col("bad") >= min_docs).withColumn("weight", weight)
        .filter(F.col("weight") - sureness * error >= min_weight).orderBy(F.col("bad").desc(), "pattern").limit(max_terms)
    )
    lexicon = Lexicon(pruned({r["pattern"]: r["weight"] for r in found.select("pattern", "weight").collect()}), [f" {' '.join(folded(e.encode()))} " for e in exceptions])
    held = shared(docs, lexicon)

    def state():
        own = held()
        return own, own.matcher()

    spared = _by_label(map_batches(rows, _counter("phrases"), schema, state))
    spared = spared.filter((F.col("good") >= min_docs) & (F.col("bad") == 0)).orderBy(F.col("good").desc(), "pattern").limit(max_terms)
    lexicon.exceptions += [r["pattern"] for r in spared.select("pattern").collect() if r["pattern"] not in lexicon.terms]
    told = shared(docs, lexicon)

    def features(cols, own):
        texts = [folded(raw) for raw in cols[0]]
        return [[density(sum(h[2] for h in own[0].hits(w, own[1])), len(w)) for w in texts], cols[1]]

    points = map_batches(rows, features, "density double, toxic int", lambda: ((own := told()), own.matcher())).toPandas()
    y = points["toxic"].to_numpy(float)
    if len(set(y)) == 2:
        share = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
        lexicon.slope, lexicon.offset = _logistic(points["density"].to_numpy(float), y, share / share.mean())
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, hits, n_words): one row per input row, whole texts.

    Null and empty texts have no hits and the score of a clean text; other columns are left out.
    """
    held = shared(docs, lexicon)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(cols, own):
        scores, hits, sizes = [], [], []
        for raw in cols[1]:
            words = folded(raw)
            found = own[0].hits(words, own[1])
            scores.append(own[0].score(density(sum(h[2] for h in found), len(words))))
            hits.append(len(found))
            sizes.append(len(words))
        return [cols[0], scores, hits, sizes]

    return map_batches(
        docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, score double, hits bigint, n_words bigint",
        lambda: ((own := held()), own.matcher()),
    )
