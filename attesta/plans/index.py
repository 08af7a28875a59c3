"""Search indices as plain tables: one row per chunk, built once, extended and reduced without a rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import LexicalIndex, add_up, lexical_index, statistics, term_counts, term_rows
from ..session import BATCH_ROWS, row_batches, written


@dataclass
class SearchIndex:
    """chunks(source, chunk_id, text, …), lexical rows and statistics, and optional given vectors.

    `vectors`(source, chunk_id, vector) replace the hashed text vectors of the lexical rows; `embed` turns a
    text column into such a vector and is applied to the queries.
    """

    chunks: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame | None = None
    embed: Callable[[Column], Column] | None = None


def search_index(
    chunks: DataFrame, lexical_text: Column | None = None, all_source: str | None = None,
    vector: str | None = None, embed: Callable[[Column], Column] | None = None,
) -> SearchIndex:
    """An index over chunks(source, chunk_id, text, …).

    `lexical_text` is what the lexical side reads instead of the text, such as `text.chunk_text` (metadata in
    front). The dense side has hashed text vectors, or the array column `vector` of the chunks, or what
    `embed` makes of their text. `all_source` names a source that stands for all of them.
    """
    vectors = None
    if vector is not None or embed is not None:
        vectors = chunks.select("source", "chunk_id", (F.col(vector) if vector is not None else embed(F.col("text"))).alias("vector"))
        vectors = written(vectors)
    return SearchIndex(chunks, lexical_index(chunks, lexical_text, all_source), vectors, embed)


def with_all_source(chunks: DataFrame) -> DataFrame:
    """The chunks once under their own source and once under 'all'."""
    return chunks.withColumn("source", F.explode(F.array(F.col("source"), F.lit("all"))))


class StoredIndex:
    """An index in a folder: chunks and lexical rows by version, term counts and statistics of the last version.

    `add` and `remove` read the rows they change and the vocabulary, never the other rows: counts are added
    and taken away. Removed chunks are listed by version and left out on reading.
    """

    def __init__(self, spark: SparkSession, path: str, all_source: str | None = None):
        self.spark, self.path, self.all_source = spark, path, all_source

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def version(self) -> int:
        """The last complete version: `stats` are written last."""
        try:
            return self._read("stats").agg(F.max("version")).first()[0] or 0
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def _save(self, df: DataFrame, name: str, version: int) -> None:
        # a version that was not finished is written again
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def _finish(self, change: DataFrame, version: int) -> None:
        """Add a change of term counts to those of the version before."""
        counts = change
        if version > 1:
            before = self._read("counts").filter(F.col("version") == version - 1).drop("version")
            counts = before.unionByName(change).groupBy("source", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")
        self._save(counts.repartitionByRange("source", "term").sortWithinPartitions("source", "term"), "counts", version)
        saved = self.spark.read.schema(change.schema).parquet(f"{self.path}/counts/version={version}")
        terms, stats = statistics(written(add_up(saved, self.all_source)) if self.all_source is not None else saved)
        if self.all_source is not None:
            self._save(terms.filter(F.col("source") == self.all_source), "all_terms", version)
        self._save(stats, "stats", version)

    def add(self, chunks: DataFrame, lexical_text: Column | None = None) -> None:
        """Add chunks(source, chunk_id, text, …); their ids must not be in the index."""
        version = self.version() + 1
        self._save(chunks, "chunks", version)
        with row_batches(self.spark, BATCH_ROWS):
            self._save(term_rows(chunks, lexical_text), "rows", version)
        rows = self.spark.read.parquet(f"{self.path}/rows/version={version}")
        self._finish(term_counts(rows).select("source", "term", "df", "cf"), version)

    def remove(self, ids: DataFrame) -> None:
        """Remove the chunks with the given (source, chunk_id); others of the ids are ignored."""
        version = self.version() + 1
        # written: few ids are sent to the rows, by their size, and the rows stay where they are
        named = written(ids.select("source", "chunk_id").distinct())
        counted = self._current("rows").select("source", "chunk_id", "dl", "terms", "tfs")
        gone = written(counted.join(named, ["source", "chunk_id"], "left_semi"))
        self._save(gone.select("source", "chunk_id"), "removed", version)
        less = term_counts(gone).select("source", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        self._finish(less, version)

    def _current(self, name: str) -> DataFrame:
        last = self.version()
        rows = self._read(name).filter(F.col("version") <= last)
        try:
            removed = self._read("removed").filter(F.col("version") <= last).select(
                F.col("source").alias("_s"), F.col("chunk_id").alias("_c"), F.col("version").alias("_v")
            )
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return rows.drop("version")
        gone = F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk_id") == F.col("_c")) & (F.col("_v") > F.col("version"))
        return rows.join(removed, gone, "left_anti").drop("version")

    def read(self) -> SearchIndex:
        last = self.version()

        def now(name: str) -> DataFrame:
            return self._read(name).filter(F.col("version") == last).drop("version")

        terms = now("counts").filter(F.col("term").isNotNull())
        if self.all_source is not None:
            terms = terms.unionByName(now("all_terms"))
        return SearchIndex(self._current("chunks"), LexicalIndex(self._current("rows"), terms, now("stats"), self.all_source))


def write_index(index: SearchIndex, path: str, mode: str = "overwrite") -> None:
    """Parquet tables of an index; terms are range-sorted, so a query reads only the row groups of its own."""

    def save(df: DataFrame, name: str) -> None:
        df.write.mode(mode).parquet(f"{path}/{name}")

    save(index.chunks, "chunks")
    save(index.lexical.rows, "rows")
    save(index.lexical.terms.repartitionByRange("source", "term").sortWithinPartitions("source", "term"), "terms")
    save(index.lexical.stats, "stats")
    if index.vectors is not None:
        save(index.vectors, "vectors")


def read_index(
    spark: SparkSession, path: str, all_source: str | None = None, vectors: bool = False, embed: Callable[[Column], Column] | None = None
) -> SearchIndex:
    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    lexical = LexicalIndex(load("rows"), load("terms"), load("stats"), all_source)
    return SearchIndex(load("chunks"), lexical, load("vectors") if vectors else None, embed)
