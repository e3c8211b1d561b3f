"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of ``documents``; the last returns the packed pieces.
``run`` writes each stage's result to the shared folder and rereads it, so a lost
executor costs one stage at most and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, linededup, packing, quality, simhash
from glyphmill.llm.common import Scratch, hinted, read_table, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    bands = quality.sample_bands(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, bands).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many of them share; one may be left empty."""
    return linededup.drop_common_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Five-word shingles and a similarity of 0.8, as for every near-duplicate stage
    without a contract of its own: long fingerprints, candidates by the Gray-order
    hierarchical index within buckets, links confirmed exactly. Null ids come last; of rows that repeat both id and
    text one stays; rows that share an id but are no near duplicates all stay.
    Only texts of rows that may go, or repeat, are shuffled.
    """
    small_batches(spark)
    groups = simhash.similar_groups(docs, 0.8, width=5)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "sig")
    first = groups.groupBy("root").agg(F.min(order).alias("k")).select("k.rid", "k.sig", F.lit(True).alias("_first"))
    times = groups.groupBy("rid", "sig").agg(F.count(F.lit(1)).alias("_times")).join(first, ["rid", "sig"], "left")
    doubted = times.where("_times > 1 OR _first IS NULL").select("rid", "sig", F.col("_first").isNotNull().alias("_first"))
    doubted = Scratch(spark, "doubted").keep(doubted, "doubted")
    whole = F.coalesce("text", F.lit(""))
    keyed = hinted(docs.withColumn("rid", F.xxhash64("doc_id", whole)).withColumn("sig", F.xxhash64(whole)), doubted, ["rid", "sig"])
    kept = keyed.where("_maybe").join(doubted, ["rid", "sig"], "left").where(F.coalesce("_first", F.lit(True)))
    same = Window.partitionBy("rid", "sig").orderBy("lang", "source", "n_chars")  # repeats of one row; the join has dealt them so
    once = kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*COLUMNS)
    return keyed.where("NOT _maybe").select(*COLUMNS).union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    found = decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, digest=True).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenisers, SimHash components and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            scratch.drop(docs)
        docs = done
    return docs
