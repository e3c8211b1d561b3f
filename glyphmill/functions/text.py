"""Prose and code tokens, natively, with UTF-8 byte ranges.

A regular expression gives tokens but no places, so matches are wrapped in a
sentinel and the text is split at it: odd pieces are matches, and the running sum
of the pieces' byte lengths is where each starts. It is taken in the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .unicode import ALPHABETIC
from .unicode import mark as combining_mark

#: Sentinels in order of preference; the first that a text lacks is used.
SENTINELS = ("\u0001", "\u0002", "", "")

#: Elements that a running sum folds one by one.
BLOCK = 16


def word_pattern() -> str:
    """A letter, then letters and combining marks; an apostrophe only before a letter."""
    # Runs of letters are taken whole and never given back, which changes no match.
    return f"{ALPHABETIC}++(?:(?:{combining_mark()}|['’](?={ALPHABETIC})){ALPHABETIC}*+)*+"


RAW_PATTERN = r"\P{IsWhite_Space}++"
#: ASCII punctuation that is trimmed from the ends of a raw token: all but _ - . @ : / + =
TRIMMED = "!\"#$%&'()*,;<>?[\\]^`{|}~"


def words(text: Column) -> Column:
    """All prose words of a text, without places."""
    return F.regexp_extract_all(text, F.lit(word_pattern()), F.lit(0))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """The running sums of an array of bigint with one element or more, in the row itself.

    Blocks are folded one by one; the sums before them take a pass for each
    doubling of their number. So the work is all but linear in the array.
    """

    def folded(all_: Column, at: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))
        return F.aggregate(F.slice(all_, at + 1, F.lit(BLOCK)), F.array().cast("array<bigint>"), step)

    def doubled(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k - 1)
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - back), F.lit(0)))

    def joined(blocks: Column) -> Column:
        passes = F.sequence(F.lit(1), F.length(F.bin(F.size(blocks) - 1)).cast("int"))
        sums = F.aggregate(passes, F.transform(blocks, lambda b: F.element_at(b, -1)), doubled)
        moved = F.zip_with(blocks, sums, lambda b, end: F.transform(b, lambda x: x + end - F.element_at(b, -1)))
        return F.when(F.size(blocks) == 1, F.element_at(blocks, 1)).otherwise(F.flatten(moved))

    return _bound(sizes, lambda all_: _bound(F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda at: folded(all_, at)), joined))


def located(docs: DataFrame, pattern: str, text: str = "text", by: tuple[str, ...] = ("doc_id",), base: str | None = None, column: bool = False) -> DataFrame:
    """One row per match: the columns ``by``, ``word``, ``byte_start`` and ``byte_end``.

    ``base`` names a column with the byte at which the row's text starts. With
    ``column`` also the scalars before the match in the row's text, from one. All
    is summed within the row, so nothing is shuffled and ``by`` need not be a key.
    """
    mark = F.concat(F.lit(SENTINELS[0]), F.md5(F.col(text)), F.lit(SENTINELS[0]))  # for a text that holds them all
    for sentinel in reversed(SENTINELS):
        mark = F.when(~F.contains(F.col(text), F.lit(sentinel)), F.lit(sentinel)).otherwise(mark)
    start = F.col(base).cast("long") if base else F.lit(0).cast("long")
    kept = docs.where(F.col(text).isNotNull()).select(*by, start.alias("_base"), F.col(text).alias("_text"), mark.alias("_mark"))
    wrapped = F.regexp_replace("_text", F.lit(f"({pattern})"), F.concat("_mark", F.lit("$1"), "_mark"))

    def matches(pieces: Column) -> Column:
        def summed(size: Callable[[Column], Column]) -> Column:
            """Where each match ends: a match and the gap before it are one step."""
            return running(F.transform(odd, lambda k: (size(F.get(pieces, k - 1)) + size(F.get(pieces, k))).cast("long")))

        def placed(ends: Column, counts: Column | None = None) -> Column:
            more = (lambda k: []) if counts is None else (lambda k: [F.get(counts, k).alias("_count")])
            return F.transform(ends, lambda end, k: F.struct(F.get(pieces, 2 * k + 1).alias("word"), end.alias("_end"), *more(k)))

        odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        if not column:
            return F.when(F.size(pieces) > 1, _bound(summed(F.octet_length), lambda ends: placed(ends)))
        plain = F.octet_length("_text") == F.length("_text")
        return F.when(F.size(pieces) > 1, _bound(summed(F.octet_length), lambda ends: _bound(F.when(plain, ends).otherwise(summed(F.length)), lambda counts: placed(ends, counts))))

    found = kept.select(*by, "_base", F.inline(_bound(F.split(wrapped, F.col("_mark")), matches)))
    end = F.col("_base") + F.col("_end")
    return found.select(*by, "word", (end - F.octet_length("word")).alias("byte_start"), end.alias("byte_end"), *([(F.col("_count") - F.length("word") + 1).alias("column")] if column else []))


def tokenize(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Prose words with their byte ranges."""
    return located(docs, word_pattern(), text, by)


def tokenize_lines(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same words (none goes over a line's end) with ``line`` and ``column`` besides."""
    return located(lines(docs.where(F.col(text).isNotNull()), text, by), word_pattern(), "text", (*by, "line"), "byte_start", column=True)


def lines(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines (without \\n or \\r\\n) with number and byte range; an empty text is one empty line. Columns in ``by`` are carried."""

    def placed(raw: Column, ends: Column) -> Column:
        every = F.transform(raw, lambda r, k: F.struct((k + 1).cast("long").alias("line"), r.alias("_raw"), (F.get(ends, k) - F.octet_length(r) - 1).alias("byte_start")))
        return F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), F.slice(every, 1, F.size(raw) - 1)).otherwise(every)

    found = _bound(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda raw: _bound(running(F.transform(raw, lambda r: F.octet_length(r).cast("long") + 1)), lambda ends: placed(raw, ends)))
    line = F.regexp_replace("_raw", r"\r\z", "")
    return docs.select(*by, F.inline(found)).select(*by, "line", line.alias("text"), "byte_start", (F.col("byte_start") + F.octet_length(line)).alias("byte_end"))


def raw_tokens(line_rows: DataFrame, by: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """White-space tokens of lines, ASCII punctuation trimmed at both ends, with byte ranges."""
    found = located(line_rows, RAW_PATTERN, "text", by, "byte_start").withColumn("_rest", F.ltrim("word", F.lit(TRIMMED)))
    out = found.select(*by, F.rtrim("_rest", F.lit(TRIMMED)).alias("token"), (F.col("byte_end") - F.octet_length("_rest")).alias("byte_start")).where("token <> ''")
    return out.withColumn("byte_end", F.col("byte_start") + F.octet_length("token"))


def raw_words(line_rows: DataFrame) -> DataFrame:
    """The same tokens without places: one column, ``token``."""
    found = line_rows.select(F.explode(F.regexp_extract_all("text", F.lit(RAW_PATTERN), F.lit(0))).alias("word"))
    return found.select(F.btrim("word", F.lit(TRIMMED)).alias("token")).where("token <> ''")


def line_and_column(places: DataFrame, line_rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``line`` and ``column`` (scalars, from one) to rows with ``byte_start``.

    Both sides are merged by place in one window, so no place meets all lines. A
    line's text is read once, cut at its places.
    """
    starts = line_rows.select(*by, F.col("byte_start").alias("_at"), F.lit(0).alias("_kind"), F.struct("line", "byte_start").alias("_line"))
    marks = places.select(*by, F.col("byte_start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<line:bigint,byte_start:bigint>").alias("_line")).distinct()
    run = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = starts.unionByName(marks).withColumn("_last", F.last("_line", ignorenulls=True).over(run)).where("_kind = 1")
    cuts = last.groupBy(*by, F.col("_last.line").alias("line")).agg(F.sort_array(F.collect_list(F.col("_at") - F.col("_last.byte_start"))).alias("_cuts"))
    met = line_rows.select(*by, "line", F.col("byte_start").alias("_from"), F.col("text").alias("_text")).join(cuts, [*by, "line"])

    def scalars(raw: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            begin = F.coalesce(F.get("_cuts", k - 1), F.lit(0))
            return F.length(F.decode(F.substr(raw, (begin + 1).cast("int"), (end - begin).cast("int")), "UTF-8")).cast("long")

        return F.transform("_cuts", piece)

    def placed(counts: Column) -> Column:
        return F.transform("_cuts", lambda cut, k: F.struct((F.col("_from") + cut).alias("byte_start"), (F.get(counts, k) + 1).alias("column")))

    found = met.select(*by, "line", F.inline(_bound(running(_bound(F.encode("_text", "UTF-8"), scalars)), placed)))
    return places.join(found, [*by, "byte_start"])
