"""Helpers that several operators of this package share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def remainder_of(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def map_batches(
    df: DataFrame, fn: Callable[..., list], schema: str, state: Callable | None = None, piece_bytes: int | None = None
) -> DataFrame:
    """Apply `fn(columns, state)` to Arrow batches; texts arrive as UTF-8 bytes, results are column lists.

    `state` is called once per task. Row counts may differ between input and output. `fn` gets at most
    `piece_bytes` (PIECE_BYTES) of text at once.
    """
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state() if state else None
        for batch in batches:
            cols = [
                (c.cast(pa.binary()) if pa.types.is_string(c.type) else c.cast(pa.large_binary()) if pa.types.is_large_string(c.type) else c).to_pylist()
                for c in batch.columns
            ]
            for part in _pieces(cols, piece_bytes or PIECE_BYTES):
                out = fn(part, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse(df.sparkSession, schema))
    return df.mapInArrow(run, schema)


def shared(df: DataFrame, value) -> Callable:
    """Broadcast the fields of a dataclass object; tasks call the result to get it back.

    Plain data only is sent, so that tasks need no installed copy of this package to unpack it.
    """
    kind, plain = type(value), tuple(getattr(value, f.name) for f in fields(value))
    held = df.sparkSession.sparkContext.broadcast(plain)
    return lambda: kind(*held.value)


def _parse(spark: SparkSession, schema: str):
    return spark.createDataFrame([], schema).schema


PIECE_BYTES = 3 << 20


def _pieces(cols: list[list], limit: int = PIECE_BYTES) -> Iterator[list[list]]:
    """Runs of rows with at most `limit` bytes of text in one column each, or a single longer row."""
    n, start, held = len(cols[0]) if cols else 0, 0, 0
    for i in range(n):
        size = max((len(c[i]) for c in cols if isinstance(c[i], bytes)), default=0)
        if held + size > limit and i > start:
            yield [c[start:i] for c in cols]
            start, held = i, 0
        held += size
    if n > start:
        yield [c[start:] for c in cols]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)
