"""Intermediate tables in the folder that driver and executors share.

A table that several steps of a plan read is written once and reread: it is not
computed again for each of them, the plan stays small, and a lost executor
costs nothing that is already written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The set of bits by which rows are picked before a join has this power of two.
HINT_BITS = 26


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where that is not set, a temporary folder of this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="glyphmill-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path.rstrip("/")


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """The same rows, written and reread; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/glyphmill-{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``_maybe``: true for every row whose ``by`` is among ``keys``, and by chance for a few others.

    What an exact join then has to shuffle are these rows, not all of them with
    their texts. The keys become bits of a set of 2**26, broadcast in words of 64:
    2**20 rows at most, however many keys there are; their share of the bits is
    the share of other rows that pass.
    """
    kinds = rows.select(*by).union(keys.select(*by)).schema  # equal values of two types must hash alike
    key = F.xxhash64(*(F.col(c).cast(kinds[c].dataType) for c in by))
    word, bit = F.shiftrightunsigned("_h", 64 - HINT_BITS + 6).alias("_word"), F.expr("shiftleft(1L, cast(_h & 63 AS int))")
    marks = keys.select(key.alias("_h")).select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mark"))
    met = rows.withColumn("_h", key).withColumn("_bit", bit).withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    return met.select(*rows.columns, F.coalesce(F.col("_mark").bitwiseAND(F.col("_bit")) != 0, F.lit(False)).alias("_maybe"))
