"""Session settings and the few places where the library acts eagerly."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem "
    "events documents embeddings pages benchmark labels conversations"
).split()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# parts into which text tables are dealt on reading; unset (the default) they are read in place
INPUT_PARTITIONS = "spark.attesta.inputPartitions"


def build_session(master: str | None = None, cores: int = 8, app: str = "attesta") -> SparkSession:
    """A session with the settings the operators are planned for. On a cluster, leave master unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        # states of many keys lie on disk, not in the heap (streaming.ingest.latest_scores)
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.sql.files.openCostInBytes", "65536")
            .config("spark.sql.files.maxPartitionBytes", "2m")
            .config(INPUT_PARTITIONS, str(4 * cores))
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Only a session that asks for it (tests, bench: files of one row group) has texts dealt out."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts), TEXT_TABLES[name]) if parts and name in TEXT_TABLES else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by the cluster. Only a local master may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


# rows of text or lists of words that a Python worker gets at once, and their bytes (a longer row comes alone)
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
ARROW_ROWS, ARROW_BYTES = (f"spark.sql.execution.arrow.{c}" for c in ("maxRecordsPerBatch", "maxBytesPerBatch"))


@contextlib.contextmanager
def row_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside give Python workers at most `rows` rows and BATCH_BYTES at once; then the session has its own settings back.

    For rows of some length: 10,000 rows or 64 MB (Spark's defaults) of texts with their words fill a worker,
    and so would `rows` long texts without a bound in bytes.
    """
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {ARROW_ROWS: spark.conf.get(ARROW_ROWS), ARROW_BYTES: spark.conf.get(ARROW_BYTES)}
    if not 0 < int(before[ARROW_ROWS]) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    if to_bytes(before[ARROW_BYTES]) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write df once as Parquet in the shared checkpoint folder and read it back.

    For results that several later steps read: each of them scans only its own columns, a lost executor
    costs no recomputation, and joins are planned by the size of the files. The tables of a session are
    removed when the driver's Python ends, or by `remove_written`. `batch_rows`: see `row_batches`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with row_batches(df.sparkSession, batch_rows) if batch_rows else contextlib.nullcontext():
        df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    """Remove the tables that `written` made; results that still read them must be done."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


atexit.register(remove_written)
