"""Recognition by word list: semi- and anti-joins over distinct words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import normalize
from ..tables import hinted


def union_of(sources: list[DataFrame]) -> DataFrame:
    """Words that any source has."""
    return reduce(DataFrame.union, (s.select("word") for s in sources)).distinct()


def keys(words: DataFrame) -> DataFrame:
    """(word, key): every spelling that a word may be found by, itself and its NFC form."""
    both = F.array_distinct(F.array(F.col("word"), normalize(F.col("word"), "nfc")))
    return words.select("word", F.explode(both).alias("key"))


def recognized(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, recognized) for the distinct words of ``words``."""
    distinct = words.select("word").distinct()
    hit = keys(distinct).join(dictionary.select(F.col("word").alias("key")).distinct().withColumn("_hit", F.lit(True)), "key", "left")
    return hit.groupBy("word").agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("recognized"))


def unrecognized(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The distinct words that the dictionary lacks."""
    return recognized(words, dictionary).where("not recognized").select("word")


def among(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """The tokens whose ``word`` is in ``wanted``. Bits leave out most others before the exact join, so that these are not shuffled for it.

    ``wanted`` is read twice: let it be a written table.
    """
    return hinted(tokens, wanted, ["word"]).where("_maybe").drop("_maybe").join(wanted, "word", "left_semi")


def misspellings(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The tokens (rows with ``word``) that the dictionary lacks.

    Only distinct words meet the dictionary; the verdict is joined back.
    """
    return tokens.join(unrecognized(tokens, dictionary), "word", "left_semi")
