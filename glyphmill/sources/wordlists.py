"""Word lists, frequency lists and overlays as DataFrames."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import normalize, trim_white_space
from ..model import FrequencyListError, WordListError


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files, whole files read as rows so that line numbers hold."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text_lines(whole, "value", ("path",))


def text_lines(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, line, text): the lines of list files, the byte order mark off the first."""
    rows = df.select(*by, F.posexplode(F.split(text, "\r?\n", -1)).alias("_pos", "text"))
    first = F.when(F.col("_pos") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    return rows.select(*by, (F.col("_pos") + 1).alias("line"), first.alias("text"))


def parse_word_list(line_rows: DataFrame, form: str = "exact") -> DataFrame:
    """Distinct words of list lines: trimmed, blank and # lines dropped, normalized."""
    word = trim_white_space(F.col("text"))
    rows = line_rows.select(word.alias("word")).where((F.col("word") != "") & ~F.col("word").startswith("#"))
    return rows.select(normalize(F.col("word"), form).alias("word")).distinct()


def read_word_list(spark: SparkSession, path: str, form: str = "exact") -> DataFrame:
    return parse_word_list(_file_lines(spark, path), form)


def words_of(spark: SparkSession, entries: Iterable[str], form: str = "exact") -> DataFrame:
    """A word list from memory; an empty entry is an error with its position."""
    rows = list(entries)
    for position, entry in enumerate(rows, 1):
        if not entry:
            raise WordListError(position)
    return spark.createDataFrame([(w,) for w in rows], "word string").select(normalize(F.col("word"), form).alias("word")).distinct()


def parse_frequency_list(line_rows: DataFrame) -> DataFrame:
    """(word, frequency) of word<TAB>count lines; the largest count of a word holds.

    A bad row raises with its line number.
    """
    kept = line_rows.select("line", F.regexp_replace("text", "\r$", "").alias("_t")).where((trim_white_space(F.col("_t")) != "") & ~trim_white_space(F.col("_t")).startswith("#"))
    fields = F.split("_t", "\t", -1)
    word, count = trim_white_space(F.get(fields, F.lit(0))), trim_white_space(F.get(fields, F.lit(1)))
    rows = kept.select("line", F.size(fields).alias("_n"), word.alias("word"), count.alias("_count")).withColumn("frequency", F.when(F.col("_count").rlike("^[+]?[0-9]+$"), F.expr("try_cast(_count as decimal(20,0))")))
    limit = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    bad = rows.where((F.col("_n") != 2) | (F.col("word") == "") | F.col("frequency").isNull() | (F.col("frequency") > limit)).orderBy("line").select("line", "_n", "word").first()
    if bad is not None:
        raise FrequencyListError(bad["line"], "expected word<TAB>count" if bad["_n"] != 2 or not bad["word"] else "not an unsigned 64-bit count")
    return rows.groupBy("word").agg(F.max("frequency").alias("frequency"))


def parse_list(line_rows: DataFrame) -> DataFrame:
    """(word, frequency): a frequency list if any line has a tab, else a plain list."""
    if line_rows.where(F.contains(F.col("text"), F.lit("\t"))).isEmpty():
        return parse_word_list(line_rows).withColumn("frequency", F.lit(None).cast("decimal(20,0)"))
    return parse_frequency_list(line_rows)


def overlay(operations: DataFrame) -> DataFrame:
    """Words of an operation log (version, op 'insert'|'remove', word): the last operation holds."""
    last = operations.groupBy("word").agg(F.max_by("op", "version").alias("op"))
    return last.where("op = 'insert'").select("word")


def derived_list(docs: DataFrame, min_count: int = 5, text: str = "text") -> DataFrame:
    """(word, frequency): a corpus's own dictionary, its prose words of at least ``min_count``."""
    from ..functions.text import words

    counted = docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    return counted.where(F.col("frequency") >= min_count)


def merged(sources: list[DataFrame]) -> DataFrame:
    """(word, frequency, source_ord): several candidate sources in order."""
    out = None
    for k, source in enumerate(sources):
        frequency = F.col("frequency").cast("decimal(20,0)") if "frequency" in source.columns else F.lit(None).cast("decimal(20,0)")
        part = source.select("word", frequency.alias("frequency"), F.lit(k).alias("source_ord"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source")
    return out



def overlay_text(words: DataFrame) -> str:
    """An overlay as text: its words in byte order, one a line. Overlays are a person's own words, so the driver holds them."""
    return "".join(f"{w}\n" for w in sorted({r["word"] for r in words.select("word").collect()}, key=str.encode))


def write_overlay(words: DataFrame, path: str) -> None:
    """Replace an overlay file: whole, or not at all."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as out:
        out.write(overlay_text(words))
    os.replace(part, path)
