"""Language identification by nearest centroid: TF-IDF of hashed byte n-grams, several centroids per language."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import map_batches, shared

WIDTH = 4096  # hashed n-gram dimensions
BLOCK = 1 << 20
LENGTHS = [16 << i for i in range(8)]  # bytes of letters from which a rejection limit of its own holds
LEAST = 20  # texts of a language and length that a limit is derived from
OTHER = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def letters(raw: bytes | None) -> bytes | None:
    """Lower-cased words of letters, single spaces between and around them; None without any letter."""
    text = (raw or b"").decode("utf-8", "replace")
    if not LETTER.search(text):
        return None
    return f" {OTHER.sub(' ', text.lower()).strip()} ".encode()


def counts(raw: bytes | None) -> np.ndarray | None:
    """Counts of byte n-grams of 1 to 3, hashed to WIDTH; whole text, taken in blocks."""
    text = letters(raw)
    if text is None:
        return None
    out = np.zeros(WIDTH, np.float32)
    for i in range(0, len(text), BLOCK):
        b = np.frombuffer(text, np.uint8, min(BLOCK + 2, len(text) - i), i).astype(np.uint32)
        n = min(BLOCK, len(b))
        two = (b[:-1] << 8 | b[1:])[:n]
        three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[:n]
        for gram, salt in ((b[:n], 1), (two, 2), (three, 3)):
            # multiplicative hashing: the upper 12 of 32 bits
            out += np.bincount((gram + np.uint32(salt << 25)) * np.uint32(2654435761) >> np.uint32(20), minlength=WIDTH)
    return out


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    m = np.log1p(np.stack(rows)) * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Centroids (unit rows), their languages, the idf, and the least cosine that is not rejected.

    `reject` holds for every text, `limits` (row per centroid) for texts of at least each of LENGTHS.
    """

    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]
    reject: float
    limits: np.ndarray

    def predict(self, raws: list[bytes | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected); without a letter ('und', 0.0, True). Score: cosine, 0 to 1."""
        rows = [counts(r) for r in raws]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(raws)
        have = [i for i, r in enumerate(rows) if r is not None]
        for i in range(0, len(have), 256):
            part = have[i : i + 256]
            if not self.names:
                continue
            cosines = vectors([rows[j] for j in part], self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for j, b, c in zip(part, best.tolist(), cosines.max(axis=1).tolist()):
                size = (float(rows[j].sum(dtype=np.float64)) + 3) / 3  # n bytes have 3n - 3 n-grams
                at = sum(size >= n for n in LENGTHS)
                limit = max(self.reject, float(self.limits[b, at - 1])) if at else self.reject
                out[j] = (self.names[b], min(1.0, max(0.0, c)), c < limit)
        return out


def clustered(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart first centres; the same result for the same rows in any order."""
    m = m[np.lexsort(m.T[:8])]
    centres = [m.mean(axis=0)]
    while len(centres) < min(k, len(m)):
        centres.append(m[(m @ np.stack(centres).T).max(axis=1).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (m @ c.T).argmax(axis=1)
        c = np.stack([m[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = 300, clusters: int = 3, reject: float = 0.05, share: float = 0.01, slack: float = 0.8,
) -> Model:
    """A model from the rows where `train` holds and the language is not null.

    Of each language the `per_language` rows whose hashed id is least are the sample: a bound that
    does not grow with the data (times the number of languages). Of a repeated id one row counts. Texts are used whole; only their
    hashed counts (16 KB each) come to the driver. Without any such row every text is 'und'.

    The rejection limits are `slack` times the `share` quantile of the cosines of the sample's texts, cut
    at each of LENGTHS, to centroids of the other half of their language. Lengths with fewer than LEAST
    texts take the limit of the next shorter one; below the first only `reject` holds.
    """
    labelled = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = (
        labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"))
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select(F.col("doc_id").alias("_picked")).distinct()
    )
    sample = labelled.select(doc_id, lang, text).join(F.broadcast(picked), F.col(doc_id).eqNullSafe(F.col("_picked")))
    # one row of each id: a repeated one could be any share of the table
    sample = sample.groupBy("_picked").agg(F.min(F.struct(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))).alias("_s"))
    sample = written(sample.select("_s.lang", "_s.text"))

    def run(cols, _):
        rows = [(name.decode(), zlib.crc32(t) & 1, counts(t)) for name, t in zip(*cols)]
        rows = [r for r in rows if r[2] is not None]
        return [[n for n, _, _ in rows], [h for _, h, _ in rows], [c.tobytes() for _, _, c in rows]]

    found = map_batches(sample, run, "lang string, half int, counts binary").toPandas()
    if found.empty:
        return Model(np.ones(WIDTH, np.float32), np.zeros((0, WIDTH), np.float32), [], reject, np.zeros((0, len(LENGTHS))))
    raw = np.stack([np.frombuffer(c, np.float32) for c in found["counts"]])
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 1
    unit, names, centroids = vectors(list(raw), idf), [], []
    halves = {}
    for name in sorted(found["lang"].unique()):
        mine = (found["lang"] == name).to_numpy()
        own = clustered(unit[mine], clusters)
        centroids.append(own)
        names += [name] * len(own)
        for half in (0, 1):
            other = mine & (found["half"] != half).to_numpy()
            if other.any():
                halves[name, half] = clustered(unit[other], clusters)
    held = sample.sparkSession.sparkContext.broadcast((idf, halves))

    def cosines(cols, own):
        weights, of = own
        out: list[list] = [[], [], []]
        for name, t in zip(*cols):
            body, centres = letters(t), of.get((name.decode(), zlib.crc32(t) & 1))
            if body is None or centres is None:
                continue
            for i, n in enumerate(LENGTHS):
                if n <= len(body):
                    part = counts(body[:n].decode("utf-8", "ignore").encode())
                    for column, value in zip(out, (name.decode(), i, float((vectors([part], weights) @ centres.T).max()))):
                        column.append(value)
        return out

    told = map_batches(sample, cosines, "lang string, at int, cosine double", lambda: held.value).toPandas()
    limits = np.zeros((len(names), len(LENGTHS)))
    for row, name in enumerate(names):
        for i in range(len(LENGTHS)):
            values = told.cosine[(told.lang == name) & (told["at"] == i)].to_numpy()
            limits[row, i] = slack * np.quantile(values, share) if len(values) >= LEAST else limits[row, i - 1] if i else 0.0
    return Model(idf, np.concatenate(centroids).astype(np.float32), names, reject, limits)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default, the text included) with lang_pred, score and rejected (boolean).

    A null text or one without a letter is 'und' and rejected; so is every text of a model without
    languages. Otherwise lang_pred is the language of the nearest centroid, and `rejected` says that
    even this one is too far. Repeated rows stay; input columns of those names are replaced.
    """
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "rejected")]
    held = shared(docs, model)
    src = docs.select(*[F.col(c) for c in names], F.col(text).alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def run(cols, own):
        got = own.predict(cols[-1])
        rest = [[v.decode() if isinstance(v, bytes) and k else v for v in c] for c, k in zip(cols[:-1], strings)]
        return [*rest, [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]]

    strings = [f.dataType.simpleString() == "string" for f in docs.select(*names).schema]
    return map_batches(src, run, f"{types}, lang_pred string, score double, rejected boolean", held)
