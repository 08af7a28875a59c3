"""Okapi BM25: one row per chunk with its term counts, corpus statistics, exact top-k of many queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, value_counts
from ..functions.vectors import HASH_DIGITS
from ..session import BATCH_ROWS, written
from .blocks import cuts, entry_counts, sparse_topk

K1, B, FLOOR = 1.5, 0.75, 0.25


@dataclass
class LexicalIndex:
    """rows(source, chunk_id, dl, terms, tfs, dims, weights); terms(source, term, df, cf); stats(source, n_docs, n_words, avgdl, mean_idf).

    Queries of `all_source` search the rows of all sources, by the sources' statistics added up.
    """

    rows: DataFrame
    terms: DataFrame
    stats: DataFrame
    all_source: str | None = None


def raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def idf(n: Column, df: Column, mean_idf: Column) -> Column:
    """Okapi idf; negative values are replaced by a quarter of the vocabulary mean."""
    raw = raw_idf(n, df)
    return F.when(raw < 0, F.lit(FLOOR) * mean_idf).otherwise(raw)


def _counted(column: pa.ListArray, digits: int) -> list[pa.Array]:
    """dl, terms, tfs, dims and weights of each row of token lists; terms and dimensions ascend."""
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    n = len(sizes)
    of = np.repeat(np.arange(n, dtype=np.int64), sizes)
    coded = pc.dictionary_encode(flat)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    names = names.take(pa.array(order))
    width = max(1, len(names))
    key, count = np.unique(of * width + (place[coded.indices.to_numpy()] if len(flat) else 0), return_counts=True)
    row, code = key // width, key % width

    def lists(row: np.ndarray, values: pa.Array) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values)

    hashed = np.array([int(hashlib.md5(t.encode()).hexdigest()[:digits], 16) for t in names.to_pylist()], np.int64)
    span = 16**digits
    cell, at = np.unique(row * span + hashed[code] if len(code) else code, return_inverse=True)
    weight = np.bincount(at, count, len(cell)) if len(cell) else np.empty(0)
    owner = cell // span
    length = np.sqrt(np.bincount(owner, weight * weight, n)) if len(cell) else np.ones(n)
    return [
        pa.array(sizes.astype(np.int32)), lists(row, names.take(pa.array(code))), lists(row, pa.array(count.astype(np.int32))),
        lists(owner, pa.array((cell % span).astype(np.int32))), lists(owner, pa.array(weight / length[owner] if len(cell) else weight)),
    ]


def term_rows(chunks: DataFrame, text: Column | None = None, digits: int = HASH_DIGITS) -> DataFrame:
    """(source, chunk_id, dl, terms, tfs, dims, weights) of chunks(source, chunk_id, text), in one tokenising pass.

    `dims` and `weights` are the hashed vector of the words, of unit length (16^digits dimensions). A null
    text has no words. No shuffle.
    """
    kept = [f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in ("source", "chunk_id")]
    toks = chunks.select("source", "chunk_id", tokens(F.col("text") if text is None else text).alias("toks"))
    names = ["source", "chunk_id", "dl", "terms", "tfs", "dims", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in cuts(entry_counts(batch.column(2)), 1000, 500_000):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_counted(part.column(2), digits)], names=names)

    lists = "dl int, terms array<string>, tfs array<int>, dims array<int>, weights array<double>"
    return toks.mapInArrow(run, ", ".join([*kept, lists]))


def term_counts(rows: DataFrame) -> DataFrame:
    """(source, term, df, cf) of `term_rows`; the row without a term has the number of chunks and words of the source."""
    # no pair is built per word: the count is looked up by the word's place
    each = rows.select("source", "tfs", F.posexplode("terms").alias("at", "term"))
    counted = each.groupBy("source", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.get("tfs", F.col("at"))).alias("cf"))
    whole = rows.groupBy("source").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("cf"))
    return counted.unionByName(whole.select("source", F.lit(None).cast("string").alias("term"), "df", "cf"))


def add_up(counts: DataFrame, all_source: str | None) -> DataFrame:
    """Term counts of all sources added up as one more source, if it has a name."""
    if all_source is None:
        return counts
    every = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return counts.unionByName(every.withColumn("source", F.lit(all_source)))


def statistics(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, stats) of term counts that were written."""
    terms = counts.filter(F.col("term").isNotNull())
    sizes = counts.filter(F.col("term").isNull()).select(
        "source", F.col("df").alias("n_docs"), F.col("cf").alias("n_words"), (F.col("cf") / F.col("df")).alias("avgdl")
    )
    # mean idf over the vocabulary, from the small histogram of document frequencies
    histogram = terms.groupBy("source", "df").agg(F.count(F.lit(1)).alias("n_terms"))
    stats = (
        sizes.join(histogram, "source")
        .groupBy("source", "n_docs", "n_words", "avgdl")
        .agg((F.sum(F.col("n_terms") * raw_idf(F.col("n_docs"), F.col("df"))) / F.sum("n_terms")).alias("mean_idf"))
    )
    return terms, stats


def lexical_index(chunks: DataFrame, text: Column | None = None, all_source: str | None = None, digits: int = HASH_DIGITS) -> LexicalIndex:
    """Index of chunks(source, chunk_id, text): texts are read and tokenised once, the rest reads what was written.

    With `all_source` the statistics of all sources are added up under that name, and nothing is stored twice;
    chunk ids then have to differ between sources.
    """
    rows = written(term_rows(chunks, text, digits), BATCH_ROWS)
    terms, stats = statistics(written(add_up(term_counts(rows), all_source)))
    return LexicalIndex(rows, terms, stats, all_source)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id[, source], term, qtf): repeated query words count repeatedly."""
    keep = [c for c in ("query_id", "source") if c in queries.columns]
    return queries.select(*keep, F.explode(value_counts(tokens(F.col("text")))).alias("t")).select(
        *keep, F.col("t.term").alias("term"), F.col("t.n").alias("qtf")
    )


def term_weights(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, source, norm, terms, weights): the terms of each query that its source knows, with their idf.

    A query is one row per source it searches: its own, or every source of the index if it names none.
    """
    terms = query_terms(queries)
    on = [c for c in ("source", "term") if c in terms.columns]
    weight = F.col("qtf") * idf(F.col("n_docs"), F.col("df"), F.col("mean_idf"))
    found = index.terms.join(terms, on).join(index.stats, "source").select(
        "query_id", "source", "avgdl", F.struct("term", weight.alias("weight")).alias("t")
    )
    return found.groupBy("query_id", "source", F.col("avgdl").alias("norm")).agg(F.collect_list("t").alias("t")).select(
        "query_id", "source", "norm", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")
    )


def _saturated(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_candidates(queries: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Positive BM25 scores of at least the k best chunks per (query_id, source): k rows per query and task."""
    rows = index.rows.select("source", "chunk_id", F.col("dl").cast("double").alias("norm"), "terms", F.col("tfs").alias("values"))
    return sparse_topk(rows, term_weights(queries, index), k, _saturated, index.all_source)


def top_k(hits: DataFrame, k: int, by: list[str], order: list[str] | None = None) -> DataFrame:
    """First k rows per `by`: score first, then a total order. Spark cuts to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *(order or ["chunk_id"]))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_search(queries: DataFrame, index: LexicalIndex, k: int = 10) -> DataFrame:
    """queries(query_id, text[, source]) -> hits(query_id, source, chunk_id, score, rank).

    All chunks are scored, in blocks of rows and queries inside the tasks (`blocks.sparse_topk`): no row per
    pair of query and chunk leaves a task, and blocks that cannot reach a query's k-th score are left out.
    """
    return top_k(bm25_candidates(queries, index, k), k, ["query_id", "source"])
