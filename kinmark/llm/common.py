"""Shared helpers of the training-data operators: checkpoints, Arrow batches, word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinmark.workers import let_workers_import

#: Rows per Arrow batch handed to Python. Text rows reach 100 KB and more, so the default of
#: 10,000 rows would let one batch of long texts outgrow a worker.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one set on the context, as in tests."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(known)
        return known
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinmark-"))  # one process: its own folder is shared
    return sc.getCheckpointDir()


_made: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. Tables are removed by :func:`drop_table` or at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._kinmark_path = path
    return back


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`cut`; nothing may read it afterwards."""
    _remove(df.sparkSession, df._kinmark_path)
    _made[:] = [x for x in _made if x[1] != df._kinmark_path]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended before this hook
            return


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS, size: int = TEXT_BATCH_BYTES) -> None:
    """Keep batches of texts small where they are read and where they go to Python, in rows and in bytes (never
    raises a smaller setting), and let workers that share this folder import the package whatever their working
    folder is."""
    let_workers_import(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, f"{size}b")


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns columns by name."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a batch's texts, null as the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def blocks(all_texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts with at most ``limit`` characters together, or a single longer text."""
    block, size = [], 0
    for text in all_texts:
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def unused(columns: list[str], n: int) -> list[str]:
    """Names for ``n`` further columns that none of ``columns`` has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    return [x for x in (f"__k{i}" for i in range(n + len(columns))) if x not in taken][:n]


_claimed: dict = {}


def claim(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches and tasks, made by ``make``. A worker serves one operator after
    the other, so it keeps one such thing: another key releases the last one and returns its memory."""
    if key not in _claimed:
        if _claimed:
            _claimed.clear()
            gc.collect()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)
        _claimed[key] = make()
    return _claimed[key]
