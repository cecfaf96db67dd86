"""What the operators share: inputs, the shared folder, batches, hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task looks at in one go; its working memory is a few dozen times that.
SLICE = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once; without a bound a batch is 10 000 rows, however long their texts.
BATCH = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a session in one machine (tests) may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="cinderlog-llm-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and a lost executor takes nothing along.

    The shuffle files of the job go when it has ended; what it wrote is read instead. Python workers get batches of bounded size.
    """
    spark = df.sparkSession
    settings = {_CLEANUP: "true", _BATCH_BYTES: str(BATCH)}
    path, before = shared_path(spark, label), {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` gave and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hand the memory that this worker has freed back to the system. Workers live on between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function over batches that gives its memory back when the task ends."""

    @functools.wraps(run)
    def work(parts: Batches) -> Batches:
        try:
            yield from run(parts)
        finally:
            give_back()

    return work


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of a batch's column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(texts: list[str], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters each; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a public finalizer); one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def batches(columns: dict[str, Iterable], schema: pa.Schema, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Hand out columns as batches of bounded size."""
    out = pa.table({f.name: pa.array(columns[f.name], type=f.type) for f in schema}, schema=schema)
    yield from out.to_batches(max_chunksize=rows)


def columns_of(df: DataFrame) -> str:
    """The columns as a schema string."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
