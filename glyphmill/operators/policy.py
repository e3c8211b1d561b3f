"""Code analysis: directives, token policy and findings.

Directive lines set a per-document state: ignored words hold for the whole
document, disable and enable for the lines after them (the last switch before a
line, by a window over the document; documents without the marker are spared it).
Tokens pass the policy as predicates; only distinct segment words meet the
dictionary, and only tokens with an unknown one are shuffled with their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions.classify import classify, is_number, located_segments
from ..functions.unicode import WHITE_SPACE
from ..model import Policy
from ..tables import hinted, settle
from .membership import unrecognized

Lookup = Callable[[DataFrame], DataFrame]


def _trim_start(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE_SPACE}+", "")


def comment_body(line: Column, comment: Column) -> Column:
    """What a whole-line comment says, null for other lines; ``comment`` is none, html or line:<prefix>."""
    bare = _trim_start(line)
    prefix = F.substr(comment, F.lit(6))
    plain = F.when(comment.startswith("line:") & bare.startswith(prefix), _trim_start(F.substr(bare, F.length(prefix) + 1)))
    inner = _trim_start(F.substr(bare, F.lit(5)))
    markup = F.when((comment == "html") & bare.startswith("<!--") & inner.endswith("-->"), F.regexp_replace(F.substr(inner, F.lit(1), F.length(inner) - 3), f"{WHITE_SPACE}+$", ""))
    return F.coalesce(plain, markup)


def _with_directives(line_rows: DataFrame, marker: str) -> DataFrame:
    """The lines with ``kind`` (ignore, disable, enable or problem; null where a line is no directive), ``words`` and ``problem``."""
    body = line_rows.withColumn("_body", comment_body(F.col("text"), F.col("comment")))
    words = F.filter(F.split(F.substr("_body", F.lit(len(marker) + 1)), f"{WHITE_SPACE}+"), lambda w: w != "")
    parts = body.withColumn("_words", F.when(F.col("_body").startswith(marker), words)).withColumn("_name", F.get("_words", F.lit(0)))
    arguments = F.slice("_words", F.lit(2), F.size("_words"))
    alone = F.size("_words") == 1
    problem = (
        F.when((F.col("_name") == "ignore") & alone, "missing-ignored-words")
        .when(F.col("_name").isin("disable", "enable") & ~alone, "unexpected-arguments")
        .when(~F.col("_name").isin("ignore", "disable", "enable"), "unknown-directive")
    )
    return parts.withColumns({
        "kind": F.when(problem.isNotNull(), "problem").otherwise(F.col("_name")), "problem": problem,
        "words": F.when((F.col("_name") == "ignore") & ~alone, arguments).otherwise(F.array().cast("array<string>")),
    }).drop("_body", "_words", "_name")


def directives(line_rows: DataFrame, marker: str = "glyphmill:") -> DataFrame:
    """Lines that are directives: doc_id, line, kind (ignore, disable, enable or problem), words, problem, range.

    ``line_rows``: doc_id, line, text, byte_start, byte_end, comment.
    """
    return _with_directives(line_rows, marker).where("kind is not null").select("doc_id", "line", "kind", "words", "problem", "byte_start", "byte_end")


def active_lines(line_rows: DataFrame, marker: str = "glyphmill:") -> DataFrame:
    """Lines that are neither directives nor switched off."""
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    switch = F.last(F.when(F.col("kind").isin("disable", "enable"), F.col("kind")), ignorenulls=True).over(before)
    marked = _with_directives(line_rows, marker).withColumn("_switch", switch)
    return marked.where(F.col("kind").isNull() & (F.coalesce("_switch", F.lit("enable")) == "enable")).select(*line_rows.columns)


def analyze(docs: DataFrame, dictionary: DataFrame | None = None, policy: Policy | None = None, lookup: Lookup | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, directive problems) of documents (doc_id, text, comment).

    Words are looked up in a word table, or by ``lookup``: a function from distinct
    words to those it does not recognize. Findings: doc_id, line, word,
    byte_start, byte_end, token, token_start, token_end, class, segment_index.
    """
    p = policy or Policy()
    find: Lookup = lookup or (lambda words: unrecognized(words, dictionary))  # type: ignore[arg-type]
    # Only a text that holds the marker can have directives; the lines of others are all active, and stay where they are.
    marked = F.contains(F.col("text"), F.lit(p.marker))
    line_rows = text_functions.lines(docs.where(marked), by=("doc_id", "comment"))
    found = directives(line_rows, p.marker)
    active = active_lines(line_rows, p.marker)
    tokens = text_functions.raw_tokens(text_functions.lines(docs.where(~marked), by=("doc_id", "comment")).union(active))

    # Class, segments and verdicts belong to distinct tokens. They are written: a condition on the class is not tried on every token.
    distinct = text_functions.raw_words(docs.where(~marked).select("text").union(active.select("text"))).distinct()
    distinct = settle(distinct.withColumn("class", classify(F.col("token"))), "tokens")
    passing = F.lit(True) if not p.ignored_classes else ~F.col("class").isin(*p.ignored_classes)
    for pattern in p.ignored_patterns:
        passing = passing & ~F.col("token").rlike(f"^(?:{pattern})\\z")
    if p.ignored_words:
        passing = passing & ~F.col("token").isin(*p.ignored_words)
    parts = distinct.select("token", "class", F.explode(located_segments(F.col("token"), p.join_single_letter)).alias("s")).select("token", "class", "s.*")
    wanted = parts.where(~is_number(F.col("text")) & (F.length("text") >= p.min_length))
    if p.ignored_words:
        wanted = wanted.where(~F.col("text").isin(*p.ignored_words))
    # A hash that the dictionary knows is a word, so both are looked up, once.
    asked = wanted.select(F.col("text").alias("word")).union(distinct.where("class = 'hash'").select("token")).distinct()
    unknown = settle(find(asked).select("word"), "unknown").withColumn("_unknown", F.lit(True))
    named = wanted.join(unknown, wanted["text"] == unknown["word"]).drop("word", "_unknown")
    named = named.join(unknown.withColumnRenamed("word", "token"), "token", "left").withColumn("class", F.when((F.col("class") == "hash") & F.col("_unknown").isNull(), "natural-word").otherwise(F.col("class")))
    wrong = settle(named.where(passing).groupBy("token", "class").agg(F.collect_list(F.struct("text", "byte_start", "segment_index")).alias("segments")), "wrong")

    # Most tokens are none of these and are left out before the join.
    found_tokens = hinted(tokens, wrong, ["token"]).where("_maybe").drop("_maybe").join(wrong, "token")
    segments = found_tokens.select("*", F.explode("segments").alias("s")).select(
        "doc_id", "line", F.col("s.text").alias("word"), (F.col("byte_start") + F.col("s.byte_start")).alias("byte_start"), "token",
        F.col("byte_start").alias("token_start"), F.col("byte_end").alias("token_end"), "class", F.when(F.col("class") == "identifier", F.col("s.segment_index")).alias("segment_index"),
    )
    ignored = found.select("doc_id", F.explode("words").alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("ignored"))
    held = F.coalesce("ignored", F.array().cast("array<string>"))
    findings = segments.join(ignored, "doc_id", "left").where(~F.array_contains(held, F.col("token")) & ~F.array_contains(held, F.col("word")))
    out = findings.select("doc_id", "line", "word", "byte_start", (F.col("byte_start") + F.octet_length("word")).cast("long").alias("byte_end"), "token", "token_start", "token_end", "class", "segment_index")
    return out, found.where("problem is not null").select("doc_id", "line", "problem", "byte_start", "byte_end")
