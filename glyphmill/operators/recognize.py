"""Recognition by affix dictionary as a cascade of joins over distinct words.

A word gives candidates (itself, and its case variants for a second, stricter
pass), a candidate gives ways to read it (whole, or cut at a break pattern), and
a way gives parts. Only distinct parts are looked up: first among the forms, and
what these lack as compounds. Verdicts are joined back: all parts of a way, any
way of a candidate, any candidate of a word.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.unicode import case_pattern, initial, lower
from ..sources.affixfiles import AffixDictionary
from ..tables import settle
from .compounds import compound_verdicts
from .forms import form_table, over_candidate_limit


def converter(rules: list[tuple[str, str, bool, bool]]):
    """A function that replaces, left to right, the longest pattern at each place.

    Of equally long patterns the first declared counts, and what a replacement
    wrote is not read again: one alternation, longest first, does just that.
    """
    if not rules:
        return lambda word: word
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0].encode()), k))
    pattern = re.compile("|".join(f"({r'\A' if rules[k][2] else ''}{re.escape(rules[k][0])}{r'\Z' if rules[k][3] else ''})" for k in order), re.S)
    targets = [rules[k][1] for k in order]
    return lambda word: pattern.sub(lambda m: targets[m.lastindex - 1], word)


def _mapped(function) -> Column:
    def mapped(words: pa.Array) -> pa.Array:
        return pa.array((None if (w := x.as_py()) is None else function(w) for x in words), pa.string())

    return F.arrow_udf(mapped, "string")


def normalize_input(word: Column, dictionary: AffixDictionary) -> Column:
    """Input conversions, then ignored characters out."""
    if dictionary.input_conversions:
        word = _mapped(converter(dictionary.input_conversions))(word)
    return F.translate(word, dictionary.ignored, "") if dictionary.ignored else word


def normalize_output(word: Column, dictionary: AffixDictionary) -> Column:
    """Output conversions, for display."""
    return _mapped(converter(dictionary.output_conversions))(word) if dictionary.output_conversions else word


def case_candidates(word: Column, turkic: bool = False) -> Column:
    """Array of struct<candidate, casing>: the variants that a second pass tries."""
    low, first = lower(word, turkic), initial(word, turkic)
    pattern = case_pattern(word)
    some = F.when(pattern == "upper", F.array(F.struct(low.alias("candidate"), F.lit("lower").alias("casing")), F.struct(first.alias("candidate"), F.lit("initial").alias("casing"))))
    some = some.when(pattern == "initial", F.array(F.struct(low.alias("candidate"), F.lit("lower").alias("casing"))))
    return F.filter(F.coalesce(some, F.array().cast("array<struct<candidate:string,casing:string>>")), lambda s: s["candidate"] != word)


def break_ways(candidate: Column, breaks: list[tuple[str, bool, bool]]) -> Column:
    """Array of arrays: the parts of each way to cut a word at a break pattern."""
    ways = []
    for text, start, end in breaks:
        size = len(text)
        if start:
            ways.append(F.when(candidate.startswith(text) & (F.length(candidate) > size), F.array(F.array(F.substr(candidate, F.lit(size + 1))))))
        elif end:
            ways.append(F.when(candidate.endswith(text) & (F.length(candidate) > size), F.array(F.array(F.substr(candidate, F.lit(1), F.length(candidate) - size)))))
        else:
            pieces = F.split(candidate, f"\\Q{text}\\E", -1)
            # Cut k joins the pieces before and after it again.
            cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.array(F.array_join(F.slice(pieces, F.lit(1), k), text), F.array_join(F.slice(pieces, k + 1, F.size(pieces)), text)))
            ways.append(F.when(F.size(pieces) > 1, F.filter(cuts, lambda p: (p[0] != "") & (p[1] != ""))))
    if not ways:
        return F.array().cast("array<array<string>>")
    empty = F.array().cast("array<array<string>>")
    every = F.flatten(F.array(*(F.coalesce(w, empty) for w in ways)))
    return F.when(F.length(candidate) <= model.MAX_COMPOUND_SCALARS, every).otherwise(empty)


class Recognizer:
    """Recognition by one affix dictionary."""

    def __init__(self, spark: SparkSession, dictionary: AffixDictionary) -> None:
        self.spark, self.dictionary = spark, dictionary
        self.forms = settle(form_table(spark, dictionary), "forms")  # derived once, for every lookup
        f = dictionary.flags
        sharps = [x.stem.upper() for x in dictionary.lexemes if dictionary.check_sharps and f.keep_case and f.keep_case in x.flags and "ß" in x.stem]
        self.sharp_forms = spark.createDataFrame([(s,) for s in sorted(set(sharps))], "form string")

    def _parts(self, words: DataFrame) -> DataFrame:
        """(word, candidate, casing, keep, way, part) of distinct words."""
        d = self.dictionary
        distinct = words.select("word").distinct().withColumn("_n", normalize_input(F.col("word"), d))
        first = F.array(F.struct(F.col("_n").alias("candidate"), F.lit("exact").alias("casing")))
        candidates = distinct.select("word", F.explode(F.concat(first, case_candidates(F.col("_n"), d.turkic))).alias("c")).select("word", "c.candidate", "c.casing", (F.col("c.casing") == "exact").alias("keep"))
        ways = F.concat(F.array(F.array("candidate")), break_ways(F.col("candidate"), d.breaks))
        opened = candidates.select("*", F.posexplode(ways).alias("way", "_parts"))
        return opened.select("word", "candidate", "casing", "keep", "way", F.posexplode("_parts").alias("nth", "part"))

    def lookup(self, parts: DataFrame) -> DataFrame:
        """Verdicts on distinct (part, keep): columns recognized, kind and the trace of the first reading."""
        probes = parts.select("part", "keep").distinct()
        allowed = F.col("accepted") & (F.col("keep") | ~F.col("keep_case"))
        kind = F.when(F.col("depth") == 0, "stem").when(F.col("depth") == 1, "affix").otherwise("derived")
        hits = probes.join(self.forms.where("accepted"), F.col("part") == F.col("form")).where(allowed).withColumn("kind", kind)
        deep = hits.where("kind = 'derived'").select(F.col("part").alias("word"))
        # A chain of rules does not count where its origin could be too many lexemes.
        barred = over_candidate_limit(deep, self.dictionary).select(F.col("word").alias("part"), F.lit("derived").alias("kind"))
        hits = hits.join(barred, ["part", "kind"], "left_anti")
        order = F.struct(F.when(F.col("kind") == "stem", 0).when(F.col("kind") == "affix", 1).otherwise(2).alias("rank"), "lexeme_id", "nth")
        best = hits.groupBy("part", "keep").agg(F.min_by(F.struct("kind", "stem", "rules"), order).alias("hit"))
        known = probes.join(best, ["part", "keep"], "left")
        left = known.where("hit is null").select("part", "keep")
        joined = compound_verdicts(self.spark, left, self.forms, self.dictionary)
        sharp = self.sharp_forms.select(F.col("form").alias("part"), F.lit(True).alias("keep"), F.lit(True).alias("sharp"))
        out = known.join(joined, ["part", "keep"], "left").join(sharp, ["part", "keep"], "left")
        found = F.coalesce(F.col("hit.kind"), F.when(F.col("components").isNotNull(), "compound"), F.when(F.col("sharp"), "sharp-s"))
        return out.select("part", "keep", found.isNotNull().alias("recognized"), found.alias("kind"), F.col("hit.stem").alias("stem"), F.col("hit.rules").alias("rules"), "components")

    def explain(self, words: DataFrame) -> DataFrame:
        """How each distinct word is read, or why not.

        Columns: word, accepted, casing, kind (stem, affix, derived, compound, sharp-s,
        break), stem, rules, components, reason. The first reading in the order
        of casings, then of the kinds, is told; break comes before sharp-s.
        """
        parts = self._parts(words)
        looked = parts.join(self.lookup(parts), ["part", "keep"])
        ways = looked.groupBy("word", "casing", "candidate", "way").agg(
            F.min("recognized").alias("all"), F.max("kind").alias("kind"), F.max("stem").alias("stem"), F.max("rules").alias("rules"), F.max("components").alias("components"),
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "part"))), lambda s: s["part"]).alias("parts"),
        )
        kind = F.when(F.col("way") == 0, F.col("kind")).otherwise("break")
        rank = F.when(F.col("casing") == "exact", 0).when(F.col("casing") == "lower", 1).otherwise(2) * 10
        rank = rank + F.when(kind == "stem", 0).when(kind == "affix", 1).when(kind == "derived", 2).when(kind == "compound", 3).when(kind == "break", 4).otherwise(5)
        reading = F.struct("casing", kind.alias("kind"), F.when(F.col("way") == 0, F.col("stem")).alias("stem"), F.when(F.col("way") == 0, F.col("rules")).alias("rules"),
                           F.when(F.col("way") == 0, F.col("components")).otherwise(F.col("parts")).alias("components"))
        best = ways.where("all").groupBy("word").agg(F.min_by(reading, F.struct(rank, "way")).alias("r"))
        distinct = words.select("word").distinct()
        told = distinct.join(best, "word", "left").select("word", F.col("r").isNotNull().alias("accepted"), "r.casing", "r.kind", "r.stem", "r.rules", "r.components")
        return told.join(self._reasons(distinct), "word", "left").withColumn("reason", F.when(~F.col("accepted"), F.coalesce("reason", F.lit("unknown"))))

    def _reasons(self, words: DataFrame) -> DataFrame:
        """(word, reason) by the first stored stem of the spelling."""
        f = self.dictionary.flags

        def has(flag: str | None) -> Column:
            return F.array_contains("flags", flag) if flag else F.lit(False)

        why = F.when(has(f.forbidden), "forbidden").when(has(f.need_affix), "needs-affix").when(has(f.only_in_compound), "only-in-compound").otherwise("keep-case")
        stems = self.forms.where("depth = 0").select(F.col("form").alias("_n"), "lexeme_id", why.alias("reason"))
        named = words.withColumn("_n", normalize_input(F.col("word"), self.dictionary))
        return named.join(stems, "_n").groupBy("word").agg(F.min_by("reason", "lexeme_id").alias("reason"))

    def contains(self, words: DataFrame) -> DataFrame:
        """(word, recognized) for the distinct words."""
        parts = self._parts(words)
        looked = parts.join(self.lookup(parts).select("part", "keep", "recognized"), ["part", "keep"])
        return looked.groupBy("word", "casing", "way").agg(F.min("recognized").alias("all")).groupBy("word").agg(F.max("all").alias("recognized"))

    def words_of(self) -> DataFrame:
        """(word, suggestable): the distinct stems, and whether they may be offered."""
        stems = self.forms.where("depth = 0").groupBy(F.col("form").alias("word")).agg(F.max("suggestable").alias("_free"))
        return stems.join(self.contains(stems), "word").select("word", (F.col("recognized") & F.col("_free")).alias("suggestable"))
