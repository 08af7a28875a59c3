"""Top-k of many queries against all rows, block by block: products inside the task, k rows a query leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_ROWS, written

CHUNK_ROWS, QUERY_ROWS = 512, 256
ENTRIES = 100_000  # list entries of a block, unless a single row has more
PASS_ROWS, PASS_ENTRIES = 8192, 500_000  # queries, and their list entries, that a task holds
DIGITS = 6


def cuts(sizes: np.ndarray, rows: int, entries: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of at most `rows` rows with `entries` entries together, unless a single row has more."""
    start, filled = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (i - start >= rows or filled + size > entries):
            yield start, i
            start, filled = i, 0
        filled += size
    if len(sizes) > start:
        yield start, len(sizes)


def entry_counts(column: pa.Array) -> np.ndarray:
    """Entries of each list; none in a null."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(df: DataFrame, rows: int, by_size: str | None = None, entries: int = ENTRIES) -> DataFrame:
    """Blocks of `df`: one row of arrays for at most `rows` rows, and `entries` entries of the list column `by_size`."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = entry_counts(batch.column(names.index(by_size))) if by_size else np.zeros(batch.num_rows, np.int64)
            for start, end in cuts(sizes, rows, entries):
                ends = pa.array([0, end - start], pa.int32())
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], names=names)

    schema = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in df.schema)
    return df.mapInArrow(run, schema)


def in_passes(
    corpus: DataFrame, queries: DataFrame, by_size: str, rows: int, start: Callable, step: Callable, schema: str
) -> DataFrame:
    """Every row of `corpus` against every query, a pass over the corpus for each PASS_ROWS queries.

    A task holds the queries of one pass, `start(batch, columns)`, and gives `step(state, part)` its rows in
    parts of CHUNK_ROWS rows and ENTRIES entries of the list column `by_size`. Rows go to Python one by one,
    not as blocks: Spark cuts its batches by rows, so their size has to be that of a row; BATCH_ROWS at once, so
    the hits are written here. Only the first row of a partition carries the queries.
    """
    # written: each pass reads its own block
    asked = written(packed(queries, rows, by_size, PASS_ENTRIES).withColumn("block", F.monotonically_increasing_id()))
    names = queries.columns
    width = len(corpus.columns)
    at = corpus.columns.index(by_size)
    numbered = corpus.withColumn("_no", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kind = None
        for batch in batches:
            if state is None and batch.num_rows:
                kind = batch.schema.field("chunk_id").type
                state = start([batch.column(width + i)[0].values for i in range(len(names))])
            own = batch.select(range(width))
            for lo, hi in cuts(entry_counts(batch.column(at)), CHUNK_ROWS, ENTRIES):
                step(state, own.slice(lo, hi - lo))
        if state is not None:
            yield from _hits(state, kind)

    out = None
    for block in sorted(r[0] for r in asked.select("block").collect()):  # a number for each PASS_ROWS queries
        one = asked.filter(F.col("block") == block).select(*[F.col(c).alias(f"q_{c}") for c in names])
        first = [F.when(F.col("_no") == 0, F.col(f"q_{c}")).alias(f"q_{c}") for c in names]
        hits = numbered.join(F.broadcast(one)).select(*corpus.columns, *first).mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return corpus.sparkSession.createDataFrame([], schema) if out is None else written(out, BATCH_ROWS)


class Best:
    """The k best (score, id) of each query of one block: score first, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.hits: list[list[tuple]] = [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)  # scores below cannot enter any more

    def add(self, query: int, scores: np.ndarray, ids: list, rows: np.ndarray | None = None) -> None:
        """Offer the scores of one query; `rows` are their places in `ids` (all by default)."""
        at = np.flatnonzero(scores >= self.least[query])
        if len(at) > self.k:
            values = scores[at]
            at = at[values >= np.partition(values, len(values) - self.k)[len(values) - self.k]]
        if not len(at):
            return
        new = [(-float(scores[i]), ids[i if rows is None else rows[i]]) for i in at]
        kept = sorted([*self.hits[query], *new], key=lambda h: (h[0], h[1] is not None, h[1]))[: self.k]
        self.hits[query] = kept
        if len(kept) == self.k:
            self.least[query] = -kept[-1][0]


class Queries:
    """A block of sparse queries. `slices`: source, members, and their entries (term, place among the members, weight)."""

    def __init__(self, columns: list[pa.Array], k: int):
        self.ids, sources, norms, terms, weights = columns
        self.sources, self.norms = sources.to_pylist(), norms.to_numpy(zero_copy_only=False)
        flat = terms.flatten()
        self.vocabulary = pc.unique(flat)
        code = pc.index_in(flat, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        weight = weights.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(self.ids)), np.diff(terms.offsets.to_numpy()))
        by_source: dict = {}
        for i, s in enumerate(self.sources):
            by_source.setdefault(s, []).append(i)
        place = np.empty(len(self.ids), np.int64)  # slice of QUERY_ROWS members, and the place in it
        self.slices: dict = {}
        count = 0
        for source, members in by_source.items():
            parts = [np.array(members[lo : lo + QUERY_ROWS]) for lo in range(0, len(members), QUERY_ROWS)]
            for i, part in enumerate(parts):
                place[part] = (count + i) * QUERY_ROWS + np.arange(len(part))
            self.slices[source] = [(count + i, part) for i, part in enumerate(parts)]
            count += len(parts)
        order = np.argsort(place[of] // QUERY_ROWS, kind="stable")
        code, weight, spot = code[order], weight[order], place[of][order]
        edges = np.searchsorted(spot // QUERY_ROWS, np.arange(count + 1))
        for source, parts in self.slices.items():
            self.slices[source] = [
                (part, code[edges[i] : edges[i + 1]], spot[edges[i] : edges[i + 1]] % QUERY_ROWS, weight[edges[i] : edges[i + 1]]) for i, part in parts
            ]
        self.best = Best(len(self.ids), k)


def sparse_topk(
    corpus: DataFrame, queries: DataFrame, k: int, value: Callable[[np.ndarray, np.ndarray, float], np.ndarray],
    all_source: str | None = None,
) -> DataFrame:
    """corpus(source, chunk_id, norm, terms, values), queries(query_id, source, norm, terms, weights)
    -> (query_id, source, chunk_id, score): at least the k best of each query and source, scores above 0.

    A score is the sum over common terms of the query's weight times value(values, norm of the row, norm of
    the query). Rows and queries meet if their sources are equal; a query of `all_source` meets all rows.
    Parts of rows meet blocks of queries inside the tasks (`in_passes`). A part's largest value of each term
    bounds what its rows can score: queries whose k-th score is above that bound are left out of the part's
    product. Each task gives k rows a query.
    """
    id_type, chunk_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (corpus, "chunk_id")))
    return in_passes(
        corpus.select("source", "chunk_id", "norm", "terms", "values"), queries.select("query_id", "source", "norm", "terms", "weights"),
        "terms", PASS_ROWS, lambda columns: Queries(columns, k), lambda block, part: _block_scores(part, block, value, all_source),
        f"query_id {id_type}, source string, chunk_id {chunk_type}, score double",
    )


def _block_scores(batch: pa.RecordBatch, block: Queries, value, all_source: str | None) -> None:
    terms, values = batch.column("terms"), batch.column("values")
    code = pc.index_in(terms.flatten(), value_set=block.vocabulary)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    if not known.any():
        return
    of = np.repeat(np.arange(len(terms)), entry_counts(terms))[known]
    code = code.drop_null().to_numpy(zero_copy_only=False)
    amount = values.flatten().to_numpy(zero_copy_only=False)[known].astype(np.float64)
    norms = batch.column("norm").to_numpy(zero_copy_only=False)
    least = block.best.least
    sources = ids = None
    for source, slices in block.slices.items():
        if source != all_source or source is None:
            sources = np.array(batch.column("source").to_pylist(), dtype=object) if sources is None else sources
            own = np.array([s == source for s in sources])
            if not own.any():
                continue
            here = own[of]
        else:
            here = slice(None)
        r, c, a = of[here], code[here], amount[here]
        present, c = np.unique(c, return_inverse=True)
        rows, r = np.unique(r, return_inverse=True)
        if not len(rows):
            continue
        # queries of one source have the same norm
        table = np.zeros((len(rows), len(present)))
        table[r, c] = value(a, norms[rows][r], float(block.norms[slices[0][0][0]]))
        most = table.max(axis=0)
        column = np.full(len(block.vocabulary), -1)
        column[present] = np.arange(len(present))
        for members, term, place, weight in slices:
            col = column[term]
            met = col >= 0
            cell = col[met] * len(members) + place[met]
            weights = np.bincount(cell, weight[met], len(present) * len(members)).reshape(len(present), len(members))
            live = np.flatnonzero(most @ np.maximum(weights, 0) >= least[members] - 1e-5)
            if not len(live):
                continue
            scores = np.round(table @ weights[:, live], DIGITS)
            top = scores.max(axis=0)
            for j in np.flatnonzero((top > 0) & (top >= least[members[live]])):
                ids = batch.column("chunk_id").to_pylist() if ids is None else ids
                good = np.flatnonzero(scores[:, j] > 0)
                block.best.add(members[live[j]], scores[good, j], ids, rows[good])


def _hits(block, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    counts = [len(h) for h in block.best.hits]
    if sum(counts):
        of = np.repeat(np.arange(len(counts)), counts)
        yield pa.RecordBatch.from_arrays(
            [
                block.ids.take(pa.array(of)), pa.array([block.sources[i] for i in of], pa.string()),
                pa.array([i for h in block.best.hits for _, i in h], kind), pa.array([-s for h in block.best.hits for s, _ in h], pa.float64()),
            ],
            names=["query_id", "source", "chunk_id", "score"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column -> float64 matrix with rows of unit length; no nulls, all of one width."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = set(np.diff(column.offsets.to_numpy()))
    if len(widths) > 1:
        raise ValueError("vectors of different widths")
    m = m.reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class VectorQueries:
    """A block of query vectors."""

    def __init__(self, columns: list[pa.Array], k: int):
        self.ids, sources, vectors = columns
        self.sources = sources.to_pylist()
        self.matrix = _matrix(vectors)
        self.by_source: dict = {}
        for i, s in enumerate(self.sources):
            self.by_source.setdefault(s, []).append(i)
        self.best = Best(len(self.ids), k)


def vector_topk(
    corpus: DataFrame, queries: DataFrame, k: int, all_source: str | None = None, query_rows: int = PASS_ROWS
) -> DataFrame:
    """corpus(source, chunk_id, vector), queries(query_id, source, vector) -> (query_id, source, chunk_id, score).

    Cosine of array vectors, rounded; otherwise like `sparse_topk`, in passes of at most `query_rows` queries.
    Rows with a null id or vector, or with a null in the vector, take no part.
    """

    def whole(df: DataFrame, key: str) -> DataFrame:
        v = F.col("vector")
        return df.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & F.col(key).isNotNull()).select(key, "source", "vector")

    def step(block: VectorQueries, part: pa.RecordBatch) -> None:
        ids, matrix = part.column("chunk_id").to_pylist(), _matrix(part.column("vector"))
        sources = np.array(part.column("source").to_pylist(), dtype=object)
        for source, members in block.by_source.items():
            rows = np.arange(len(ids)) if source == all_source and source is not None else np.flatnonzero(sources == source)
            if not len(rows):
                continue
            for lo in range(0, len(members), QUERY_ROWS):
                some = np.array(members[lo : lo + QUERY_ROWS])
                scores = np.round(block.matrix[some] @ matrix[rows].T, DIGITS)
                for j in np.flatnonzero(scores.max(axis=1) >= block.best.least[some]):
                    block.best.add(some[j], scores[j], ids, rows)

    id_type, chunk_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (corpus, "chunk_id")))
    return in_passes(
        whole(corpus, "chunk_id"), whole(queries, "query_id"), "vector", query_rows, lambda columns: VectorQueries(columns, k), step,
        f"query_id {id_type}, source string, chunk_id {chunk_type}, score double",
    )
