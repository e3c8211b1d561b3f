"""The engine: layered sources behind one object, every call a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import whole_identifier
from ..functions.distance import deletions, osa_distance
from ..functions.text import tokenize_lines, words
from ..functions.unicode import lower, normalize
from ..model import Policy, SuggestOptions
from ..operators.membership import among, keys, union_of, unrecognized
from ..operators.policy import analyze
from ..operators.recognize import Recognizer, normalize_output
from ..operators.suggest import related_seeds, suggest
from ..sources.affixfiles import AffixDictionary
from ..sources.wordlists import merged, words_of
from ..tables import settle


@dataclass
class Engine:
    """Words are recognized if any source does: word lists in order, then affix dictionaries."""

    spark: SparkSession
    lists: list[DataFrame] = field(default_factory=list)
    affixes: list[AffixDictionary] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.recognizers = [Recognizer(self.spark, a) for a in self.affixes]

    def unrecognized(self, words: DataFrame) -> DataFrame:
        """The distinct words that no source has; each source sees what those before it lack."""
        left = words.select("word").distinct()
        if self.lists:
            left = unrecognized(left, union_of(self.lists))
        for recognizer in self.recognizers:
            spelled = keys(left)
            hit = spelled.join(recognizer.contains(spelled.select(F.col("key").alias("word"))).where("recognized").select(F.col("word").alias("key")), "key", "left_semi")
            left = left.join(hit.select("word").distinct(), "word", "left_anti")
        return left

    def check_words(self, words: DataFrame) -> DataFrame:
        """(word, recognized) of the distinct words."""
        missing = self.unrecognized(words).withColumn("recognized", F.lit(False))
        return words.select("word").distinct().join(missing, "word", "left").withColumn("recognized", F.coalesce("recognized", F.lit(True)))

    def check_text(self, docs: DataFrame) -> DataFrame:
        """Misspellings of (doc_id, text) with byte ranges, line and column."""
        wrong = self.unrecognized(docs.select(F.explode(words(F.col("text"))).alias("word")))
        return among(tokenize_lines(docs), settle(wrong, "unknown")).select("doc_id", "word", "byte_start", "byte_end", "line", "column")

    def analyze(self, docs: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
        """Findings and directive problems of (doc_id, text, comment)."""
        return analyze(docs, policy=policy, lookup=self.unrecognized)

    def candidates(self) -> DataFrame:
        """(word, frequency, suggestable, source_ord) of all sources."""
        parts = [merged(self.lists).withColumn("suggestable", F.lit(True))] if self.lists else []
        for k, recognizer in enumerate(self.recognizers, len(self.lists)):
            parts.append(recognizer.words_of().select("word", F.lit(None).cast("decimal(20,0)").alias("frequency"), F.lit(k).alias("source_ord"), "suggestable"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def suggest(self, words: DataFrame, options: SuggestOptions | None = None) -> tuple[DataFrame, DataFrame]:
        """Corrections and completeness. One affix dictionary alone adds its signals, derived forms and output spelling."""
        if len(self.recognizers) == 1 and not self.lists:
            return self._suggest_affix(words, options or SuggestOptions())
        return suggest(words, self.candidates(), options)

    def _suggest_affix(self, words: DataFrame, options: SuggestOptions) -> tuple[DataFrame, DataFrame]:
        recognizer, dictionary = self.recognizers[0], self.affixes[0]
        stems = settle(self.candidates().withColumn("source_ord", F.lit(0)), "stems")
        forms = recognizer.forms.where("depth > 0 and accepted and suggestable and nth <= 64").select("form", "stem").distinct()
        # Forms near a query whose stem looks like it: an equi-join on shared deletions, as for the stems.
        asked = words.select(lower(F.col("word")).alias("lq")).distinct().select("lq", F.explode(deletions(F.col("lq"), options.max_distance)).alias("key"))
        spelled = forms.select("form", "stem", F.explode(deletions(lower(F.col("form")), options.max_distance)).alias("key"))
        forms = asked.join(spelled, "key").where(related_seeds(F.col("lq"), lower(F.col("stem")), options.max_distance))
        derived = settle(forms.select(F.col("form").alias("word")).distinct().join(stems.select("word"), "word", "left_anti"), "derived")
        more = derived.select("word", F.lit(None).cast("decimal(20,0)").alias("frequency"), F.lit(1).alias("source_ord"), F.lit(True).alias("suggestable"))
        repaired = self.compound_repairs(words, stems, options).select("word").distinct().join(stems.select("word"), "word", "left_anti").join(derived, "word", "left_anti")
        repaired = settle(repaired, "repaired")
        joined = repaired.select("word", F.lit(None).cast("decimal(20,0)").alias("frequency"), F.lit(2).alias("source_ord"), F.lit(True).alias("suggestable"))
        found, state = suggest(words, stems.unionByName(more).unionByName(joined), options, dictionary.replacements, dictionary.keyboard, dictionary.maps)
        return found.withColumn("word", normalize_output(F.col("word"), dictionary)), state

    def compound_repairs(self, words: DataFrame, stems: DataFrame, options: SuggestOptions) -> DataFrame:
        """(query, word): compounds that come of repairing one half of a query by a stem."""
        recognizer = self.recognizers[0]
        at = F.explode(F.sequence(F.lit(1), F.least(F.length("query") - 1, F.lit(64))))
        asked = words.select(F.col("word").alias("query")).distinct().where(F.length("query") > 1).select("query", at.alias("k"))
        halves = asked.select("query", F.substr("query", F.lit(1), F.col("k")).alias("l"), F.substr("query", F.col("k") + 1).alias("r"))
        both = halves.select("query", F.explode(F.array(
            F.struct(F.col("l").alias("other"), F.col("r").alias("typo"), F.lit(True).alias("right")), F.struct(F.col("r").alias("other"), F.col("l").alias("typo"), F.lit(False).alias("right")),
        )).alias("h")).select("query", "h.*")
        good = recognizer.contains(both.select(F.col("other").alias("word"))).where("recognized").select(F.col("word").alias("other"))
        open_ = both.join(good, "other", "left_semi").select("*", F.explode(deletions(F.col("typo"), options.max_distance)).alias("key"))
        known = stems.select(F.col("word").alias("stem"), F.explode(deletions(F.col("word"), options.max_distance)).alias("key"))
        near = open_.join(known, "key").select("query", "other", "typo", "right", "stem").distinct().where(osa_distance(F.col("typo"), F.col("stem"), options.max_distance).isNotNull())
        made = settle(near.select("query", F.when(F.col("right"), F.concat("other", "stem")).otherwise(F.concat("stem", "other")).alias("word")).where("word <> query").distinct(), "repairs")
        return made.join(recognizer.contains(made).where("recognized").select("word"), "word", "left_semi")

    def explain(self, words: DataFrame) -> DataFrame:
        """How the first affix dictionary reads each word."""
        return self.recognizers[0].explain(words)

    def edits(self, findings: DataFrame, options: SuggestOptions | None = None) -> DataFrame:
        """Replacements for findings: doc_id, byte_start, byte_end, rank, replacement (of the whole identifier where there is one)."""
        found, _ = self.suggest(findings.select("word").distinct(), options or SuggestOptions(max_results=3))
        both = findings.join(found.select(F.col("query").alias("word"), "rank", F.col("word").alias("suggestion")), "word")
        whole = whole_identifier(F.col("token"), F.col("byte_start") - F.col("token_start"), F.col("word"), F.col("suggestion"))
        inside = F.col("segment_index").isNotNull()
        return both.select(
            "doc_id", F.when(inside, F.col("token_start")).otherwise(F.col("byte_start")).alias("byte_start"), F.when(inside, F.col("token_end")).otherwise(F.col("byte_end")).alias("byte_end"),
            "rank", F.when(inside, whole).otherwise(F.col("suggestion")).alias("replacement"),
        )


class Checker:
    """Words in memory: ``check`` one or many, ``suggest`` for one."""

    def __init__(self, spark: SparkSession, words: list[str], form: str = "exact") -> None:
        self.engine = Engine(spark, [words_of(spark, words, form)])
        self.form = form

    def check(self, *words: str) -> dict[str, bool]:
        spark = self.engine.spark
        asked = spark.createDataFrame([(w,) for w in words], "word string")
        named = asked.withColumn("_n", normalize(F.col("word"), self.form))
        known = self.engine.check_words(named.select(F.col("_n").alias("word"))).withColumnRenamed("word", "_n")
        return {r["word"]: r["recognized"] for r in named.join(known, "_n").select("word", "recognized").collect()}

    def suggest(self, word: str, options: SuggestOptions | None = None) -> list[str]:
        found, _ = self.engine.suggest(self.engine.spark.createDataFrame([(word,)], "word string"), options)
        return [r["word"] for r in found.orderBy("rank").collect()]


def rendered_finding(path: Column, line: Column, column: Column, word: Column) -> Column:
    """``path:line:column: misspelled: word``"""
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(":"), column.cast("string"), F.lit(": misspelled: "), word)


def utf16_column(text: Column, scalars: Column) -> Column:
    """UTF-16 units before a place given in scalars: characters beyond the first plane take two."""
    head = F.substr(text, F.lit(1), scalars)
    return F.length(head) + F.regexp_count(head, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def rendered_explanation() -> Column:
    """A row of ``explain`` in one line."""
    how = F.when(F.col("kind") == "stem", F.concat(F.lit("stem "), "stem")).when(F.col("kind").isin("affix", "derived"), F.concat(F.col("kind"), F.lit(" of "), F.col("stem")))
    how = F.coalesce(how, F.concat(F.col("kind"), F.lit(" "), F.array_join("components", "+")), F.col("kind"))
    return F.when(F.col("accepted"), F.concat("word", F.lit(": accepted ("), "casing", F.lit("), "), how)).otherwise(F.concat("word", F.lit(": rejected, "), "reason"))


def nul_separated(words: Column) -> Column:
    """An array of suggestions as one string, each ended by a NUL."""
    return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("\0"))), "")
