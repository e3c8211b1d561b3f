"""Functions for SQL: ``lex_normalize``, ``lex_osa``, ``lex_split_identifier``, the table function ``lex_tokens``, and a dictionary's view with ``lex_contains``."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udf, udtf

from .classify import segment_pattern
from .distance import osa
from .unicode import FORMS


#: The words of the native plan: a letter, then letters and combining marks; an apostrophe only before a letter.
_WORD = regex.compile(r"\p{Alphabetic}(?:[\p{Alphabetic}\P{ccc=0}]|['’](?=\p{Alphabetic}))*")


@udtf(returnType="word string, byte_start bigint, byte_end bigint")
class Tokens:
    """The prose words of a text with their byte ranges, for SQL."""

    def eval(self, text: str):
        at = size = 0
        for m in _WORD.finditer(text or ""):
            size += len(text[at : m.start()].encode())
            end = size + len(m[0].encode())
            yield m[0], size, end
            at, size = m.end(), end


def register(spark: SparkSession, dictionary: DataFrame | None = None) -> None:
    """Make the functions known to SQL; with a word table also the view ``lex_words`` and ``lex_contains``.

    ``lex_split_identifier`` and ``lex_contains`` are SQL functions: the optimizer
    sees their bodies, and ``lex_contains`` in a filter is a semi- or anti-join
    with the view. A null word is in no dictionary.
    """

    @udf("string", useArrow=True)
    def lex_normalize(word, form):
        name = FORMS[form or "nfc"]
        return word if word is None or name is None else unicodedata.normalize(name, word)

    @udf("int", useArrow=True)
    def lex_osa(a, b, most):
        return None if a is None or b is None or most is None else osa(a, b, most)

    spark.udf.register("lex_normalize", lex_normalize)
    spark.udf.register("lex_osa", lex_osa)
    spark.udtf.register("lex_tokens", Tokens)
    pattern = segment_pattern().replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lex_split_identifier(token STRING) RETURNS ARRAY<STRING> RETURN filter(split(token, '{pattern}'), s -> s != '')")
    if dictionary is not None:
        dictionary.select("word").distinct().createOrReplaceTempView("lex_words")
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lex_contains(asked STRING) RETURNS BOOLEAN RETURN EXISTS(SELECT 1 FROM lex_words AS known WHERE known.word = asked)")
