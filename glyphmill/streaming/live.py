"""Live checking: a stream of document versions, each checked whole.

Checking holds no state: every version is tokenized and its words anti-joined
with a dictionary that each micro-batch reads anew, so an overlay's changes show
from the next batch on. The latest version of a document within a batch counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize, words
from ..operators.membership import misspellings


def latest(batch: DataFrame) -> DataFrame:
    """(doc_id, text) of each document's newest version (columns doc_id, version, text)."""
    return batch.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"))


def check_batch(batch: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Misspellings of the newest versions, with byte ranges."""
    return misspellings(tokenize(latest(batch)), dictionary)


def check_stream(stream: DataFrame, dictionary: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start checking: ``dictionary`` is called for each batch, ``sink`` gets the findings and the batch's number."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(check_batch(rows, dictionary()), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(stream: DataFrame, dictionary: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """An addition of this library: unrecognized words per event-time window, with a watermark (columns ts, text)."""
    spelled = stream.withWatermark("ts", late).select("ts", F.explode(words(F.col("text"))).alias("word"))
    known = dictionary.select("word").distinct().withColumn("_known", F.lit(True))
    wrong = spelled.join(known, "word", "left").where("_known is null")
    return wrong.groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("unrecognized"))
