"""Shared plumbing of the training-data operators: scratch tables, words, bounds."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import hinted, shared_folder  # noqa: F401

#: The six ASCII white-space characters that separate words: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Code points U+0041-U+005A; only these are folded by :func:`ascii_lower`.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: The same mapping for ``bytes.translate``.
LOWER_TABLE = bytes.maketrans(_UPPER.encode(), _LOWER.encode())

#: Rows and bytes that one Arrow batch may carry to a Python worker.
BATCH_ROWS = 1024


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns freed pages, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def release() -> None:
    """Give memory that is free back to the system: workers live on, from batch to batch and stage to stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def named(column: str) -> Column:
    """A column by its plain name, whatever signs stand in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def shielded(docs: DataFrame, used: dict[str, str], outputs: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(inner table, restore): an operator's steps see the columns they use, under names of their own, and no other's names.

    ``used``: inner name to the name in ``docs``. All other columns are carried as
    ``_x0``, ``_x1``, ... and ``restore`` gives them their names back, in their places,
    with ``outputs`` behind. A column of ``docs`` that has the name of an output is
    replaced by it; used ones come back as the inner steps leave them.
    """
    replaced = {c.lower() for c in outputs}
    back = {name: inner for inner, name in reversed(used.items())}
    places = [(c, back.get(c, f"_x{k}")) for k, c in enumerate(docs.columns) if c in back or c.lower() not in replaced]
    inner = docs.select(*(named(c).alias(inner) for inner, c in used.items()), *(named(c).alias(x) for c, x in places if c not in back))

    def restore(done: DataFrame) -> DataFrame:
        return done.select(*(F.col(x).alias(c) for c, x in places), *(F.col(o) for o in outputs))

    return inner, restore


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; works for any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, so that very long texts do not pile up in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """Tables written into the shared folder to cut lineage.

    A written table survives the loss of any executor and is never computed
    twice. ``keep`` writes and rereads; ``drop`` deletes a table that later
    steps no longer read. What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        # A written table replaces the shuffles it came from: their files go when its query ends.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        self.root = f"{shared_folder(spark)}/glyphmill-{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:02d}-{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._fs.delete(self._path(path), True)

    def clear(self) -> None:
        """Delete all tables."""
        self._fs.delete(self._path(self.root), True)


def blocks(spark: SparkSession) -> int:
    """Number of hash blocks for two-level ranking: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: from ``folder``, else from the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
