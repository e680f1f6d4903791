"""What the operators of this subpackage share: the shared folder, lineage cuts, columns and tokenizer paths."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import ship

T = TypeVar("T")


def prepared(spark: SparkSession) -> SparkSession:
    """A session whose workers find this package and get texts in Arrow batches of a few MB, unless the session has a smaller limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, "64m") in ("64m", "67108864b", "67108864", "256m", "268435456b"):
        spark.conf.set(limit, "8m")
    return ship(spark)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A driver table by a path that Spark's readers open."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns never clash with its own."""
    return df.select(*[df[f"`{column}`"].alias(own) for own, column in names.items()])


def shared_uri(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one that is set on the session's context.

    A cluster without spark.checkpoint.dir raises an error, as its nodes have no folder in common.
    """
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        uri = getattr(shared_uri, "own", None)
        if not uri or not os.path.isdir(urlparse(uri).path):
            folder = tempfile.mkdtemp(prefix="spindrift-")
            atexit.register(shutil.rmtree, folder, True)
            uri = shared_uri.own = f"file://{folder}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(uri)
    return uri.rstrip("/")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared one, as a path that Python opens on every node (for files that executors map into memory).

    The cluster's spark.checkpoint.dir must be mounted on all nodes; a store that only Spark can read raises ValueError.
    """
    parts = urlparse(shared_uri(spark))
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted spark.checkpoint.dir, not {parts.scheme}://")
    path = os.path.join(parts.path, f"spindrift-{tag}-{uuid.uuid4().hex[:12]}")
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, True)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder, where they outlive any executor.

    Spark's cleaner deletes the files when the frame is no longer referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_uri(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, size: F.Column, most: int) -> DataFrame:
    """A settled table, to be broadcast if the sizes of its rows, in bytes, add up to at most `most`."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, or if the table has such a column, the name with the first number that is free."""
    taken, n = {c.lower() for c in df.columns}, 0
    while (found := f"{name}_{n}" if n else name).lower() in taken:
        n += 1
    return found


def delete(spark: SparkSession, uri: str) -> None:
    """Delete a folder in any file system that Spark opens; nothing if it, or the session, is gone."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(uri)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def publish(path: str, data: bytes) -> None:
    """Write a file in one step: a retried or speculative task replaces it by equal bytes, a reader never sees a part."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def scan_partitions(df: DataFrame) -> int:
    """Number of partitions that a scan has; plans nothing else when the frame is a scan."""
    return max(1, df.rdd.getNumPartitions())


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column; nulls are empty."""
    return [x or "" for x in column.to_pylist()]


def frames(batches: Iterable[pa.RecordBatch], step: int = 2000, most_bytes: float = 8e6) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows and about 8 MB (`most_bytes`) at most, whatever Spark sends; a single long text stays whole."""
    try:
        for batch in batches:
            done, each = 0, batch.get_total_buffer_size() / max(1, batch.num_rows)
            most = max(1, min(step, int(most_bytes / max(1.0, each))))
            while done < batch.num_rows:
                yield batch.slice(done, most)
                done += most
    finally:
        give_back()


def give_back() -> None:
    """Return free memory to the system: a worker lives on after its task, and what it keeps counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


_held: dict[str, tuple] = {}


def hold(kind: str, key: object, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task, made when it isn't there. One thing at a time: another operator's is dropped."""
    if kind not in _held or _held[kind][0] != key:
        _held.clear()
        _held[kind] = key, make()
    return _held[kind][1]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; it is read in place on each node and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def null_key(column) -> F.Column:
    """A join key for a column that may be null: equal values, and nulls among themselves, get equal structs."""
    return F.struct(F.coalesce(column.cast("string"), F.lit("")), column.isNull())
