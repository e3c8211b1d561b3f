"""Compound recognition: substrings of unresolved words joined with the forms.

Every word that the forms lack is cut into its substrings (at most 256 scalars,
of the minimum length or more), the distinct substrings meet the forms in one
equi-join, and what each word's substrings matched comes back as a list. A path
through that list that covers the word, with the rules of position, count and
boundary, makes it a compound. The search for a path runs where the list is, on
data that one word bounds; the dictionary is never sent to it.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import Compound
from ..sources.affixfiles import AffixDictionary


class Paths:
    """Covers one word by components; ``matches`` maps (start, end) to what stands there."""

    def __init__(self, word: str, matches: dict[tuple[int, int], list[dict]], rules: Compound, keep: bool, triples: bool) -> None:
        self.word, self.c, self.keep, self.triples = word, rules, keep, triples
        self.matches = matches
        self.starts: dict[int, list[int]] = {}
        for a, b in matches:
            if b - a >= rules.minimum and self._boundary(a, b):
                self.starts.setdefault(a, []).append(b)
        for ends in self.starts.values():
            ends.sort()

    def _stems(self, a: int, b: int) -> list[dict]:
        return [m for m in self.matches.get((a, b), ()) if m["depth"] == 0]

    def _flagged(self, a: int, b: int, flag: str) -> bool:
        return any(flag in m["flags"] for m in self._stems(a, b))

    def _boundary(self, a: int, b: int) -> bool:
        """Whether a component may stand between these places."""
        c, word = self.c, self.word
        part = word[a:b]
        if c.check_case and a and part[0].isupper():
            return False
        if c.check_duplicate and a and word[:a].endswith(part):
            return False
        if c.check_triple and not self.triples and a:
            around = word[max(0, a - 2) : a + 2]
            at = min(2, a)
            if (at == 2 and len(around) > 2 and len({*around[:3]}) == 1) or (len(around) > at + 1 and len({*around[at - 1 : at + 2]}) == 1):
                return False
        if b == len(word) and c.force_upper and self._flagged(a, b, c.force_upper) and not word[0].isupper():
            return False
        for ending, ending_flag, beginning, beginning_flag, replacement in c.patterns:
            if replacement is None and ending != "0" and word[:a].endswith(ending) and part.startswith(beginning):
                if (ending_flag is None or self._flagged(0, a, ending_flag)) and (beginning_flag is None or self._flagged(a, b, beginning_flag)):
                    return False
        return True

    def _usable(self, m: dict, last: bool) -> bool:
        return m["compound_ok"] and (self.keep or not m["keep_case"]) and (last or self.c.forbid not in m["flags"])

    def _flag_at(self, a: int, b: int, flag: str) -> bool:
        return any(flag in m["flags"] and self._usable(m, b == len(self.word)) for m in self._stems(a, b))

    def _position_at(self, a: int, b: int, flag: str, position: str) -> bool:
        for m in self.matches[a, b]:
            if m["depth"] > 1 or not (flag in m["flags"] or self.c.flag in m["flags"]):
                continue
            if m["depth"] == 0:
                if self._usable(m, position == "end"):
                    return True
            elif m["compound_ok"] and (self.keep or not m["keep_case"]):
                if m["permitted"] or position == "begin" and m["first_kind"] == "P" or position == "end" and m["first_kind"] == "S":
                    return True
        return False

    def _count_allowed(self, n: int) -> bool:
        c = self.c
        if c.max_words is None or n <= c.max_words:
            return True
        return c.max_syllables is not None and sum(ch in c.vowels for ch in self.word) <= c.max_syllables

    def _walk(self, steps: Any, most: int) -> list[str] | None:
        """Breadth first over the number of components; ``steps(n)`` tests the nth, as (inner, final)."""
        end = len(self.word)
        reached: dict[int, list[int]] = {0: []}
        for n in range(1, most + 1):
            inner, final = steps(n)
            if final is not None and n >= 2 and self._count_allowed(n):
                for a, path in sorted(reached.items()):
                    if end in self.starts.get(a, ()) and final(a, end):
                        cuts = [0, *path, end]
                        return [self.word[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            if self.c.max_words is not None and n >= self.c.max_words and self.c.max_syllables is None:
                return None
            if inner is None:
                return None
            following: dict[int, list[int]] = {}
            for a, path in sorted(reached.items()):
                for b in self.starts.get(a, ()):
                    if b < end and b not in following and inner(a, b):
                        following[b] = [*path, b]
            if not following:
                return None
            reached = following
        return None

    def find(self) -> list[str] | None:
        """The components of the first path, by the generic flag, a rule, or positions."""
        c, most = self.c, len(self.word)
        if c.flag and (found := self._walk(lambda n: ((lambda a, b: self._flag_at(a, b, c.flag)),) * 2, most)):
            return found
        for rule in c.rules:
            def steps(n: int, rule=rule):
                test = lambda a, b: self._flag_at(a, b, rule[n - 1])
                return (test, None) if n < len(rule) else (None, test)

            if found := self._walk(steps, len(rule)):
                return found
        if c.begin and c.end:
            def positioned(n: int):
                final = lambda a, b: self._position_at(a, b, c.end, "end")
                if n == 1:
                    return (lambda a, b: self._position_at(a, b, c.begin, "begin")), None
                return ((lambda a, b: self._position_at(a, b, c.middle, "middle")) if c.middle else None), final

            return self._walk(positioned, most)
        return None


def _restored(pieces: Column, between: str, instead: str):
    """A function of k: the pieces joined again, but for the kth gap, which gets other text."""

    def at(k: Column) -> Column:
        head, tail = F.array_join(F.slice(pieces, F.lit(1), k), between), F.array_join(F.slice(pieces, k + 1, F.size(pieces)), between)
        return F.struct(F.concat(head, F.lit(instead), tail).alias("variant"), F.lit(False).alias("triples"))

    return at


def _corrected(pieces: Column, rule: tuple[str, str, bool, bool]):
    """A function of k: the word with the kth site of a replacement rule replaced; null off its anchors."""
    source, target, start, end = rule

    def at(k: Column) -> Column:
        head, tail = F.array_join(F.slice(pieces, F.lit(1), k), source), F.array_join(F.slice(pieces, k + 1, F.size(pieces)), source)
        fits = (F.lit(True) if not start else head == "") & (F.lit(True) if not end else tail == "")
        return F.when(fits, F.concat(head, F.lit(target), tail))

    return at


def _variants(word: Column, compound: Compound) -> Column:
    """Array of struct<variant, triples>: the word, and what its spelling may stand for."""
    plain = F.array(F.struct(word.alias("variant"), F.lit(False).alias("triples")))
    more = []
    if compound.check_triple and compound.simplified_triple:
        doubled = F.filter(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), lambda k: F.substr(word, k, F.lit(1)) == F.substr(word, k - 1, F.lit(1)))
        more.append(F.transform(doubled, lambda k: F.struct(F.concat(F.substr(word, F.lit(1), k), F.substr(word, k)).alias("variant"), F.lit(True).alias("triples"))))
    for ending, _, beginning, _, replacement in compound.patterns:
        if replacement:
            pieces = F.split(word, f"\\Q{replacement}\\E", -1)
            cuts = F.slice(F.sequence(F.lit(1), F.size(pieces)), F.lit(1), F.least(F.size(pieces) - 1, F.lit(model.MAX_PATTERN_VARIANTS)))
            more.append(F.transform(cuts, _restored(pieces, replacement, ending + beginning)))
    return F.concat(plain, *more) if more else plain


def _repaired(probes: DataFrame, dictionary: AffixDictionary, forms: DataFrame) -> DataFrame:
    """The (part, keep) that a replacement rule turns into a word which is no compound."""
    sites = []
    for rule in dictionary.replacements:
        pieces = F.split("part", f"\\Q{rule[0]}\\E", -1)
        cuts = F.slice(F.sequence(F.lit(1), F.size(pieces)), F.lit(1), F.size(pieces) - 1)
        sites.append(F.filter(F.transform(cuts, _corrected(pieces, rule)), lambda x: x.isNotNull()))
    tried = probes.select("part", "keep", F.explode(F.flatten(F.array(*sites))).alias("form"))
    simple = forms.where("accepted and depth <= 1").select("form", "keep_case")
    return tried.join(simple, "form").where("keep or not keep_case").select("part", "keep").distinct()


def compound_verdicts(spark: SparkSession, probes: DataFrame, forms: DataFrame, dictionary: AffixDictionary) -> DataFrame:
    """(part, keep, components) of the probes that are compounds."""
    compound = dictionary.compound
    if not compound.possible:
        return spark.createDataFrame([], "part string, keep boolean, components array<string>")
    if compound.check_replacement and dictionary.replacements:
        probes = probes.join(_repaired(probes, dictionary, forms), ["part", "keep"], "left_anti")
    usable = probes.where(F.length("part").between(2, model.MAX_COMPOUND_SCALARS))
    variants = usable.select("part", "keep", F.posexplode(_variants(F.col("part"), compound)).alias("nth", "v")).select("part", "keep", "nth", "v.*").where(F.length("variant").between(2, model.MAX_COMPOUND_SCALARS))

    # Heads of any length count too: pattern flags look the whole text before a boundary up.
    size = F.length("variant")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda a: F.transform(F.sequence(a + 1, size), lambda b: F.struct(a.alias("a"), b.alias("b"), F.substr("variant", a + 1, b - a).alias("piece")))))
    cut = variants.select("variant").distinct().select("variant", F.explode(spans).alias("s")).select("variant", "s.*").where((F.col("b") - F.col("a") >= compound.minimum) | (F.col("a") == 0))
    known = forms.where("depth <= 1 and (compound_ok or depth = 0)").select(F.col("form").alias("piece"), F.struct("depth", "flags", "keep_case", "first_kind", "permitted", "compound_ok").alias("m"))
    matched = cut.join(known, "piece").groupBy("variant").agg(F.collect_list(F.struct("a", "b", "m")).alias("matches"))

    rules = json.dumps(vars(compound))

    @F.arrow_udf("array<string>")
    def path(words: pa.Array, matches: pa.Array, keeps: pa.Array, triples: pa.Array) -> pa.Array:
        c = Compound(**json.loads(rules))
        out = []
        for word, found, keep, triple in zip(words.to_pylist(), matches.to_pylist(), keeps.to_pylist(), triples.to_pylist(), strict=True):
            by: dict[tuple[int, int], list[dict]] = {}
            for x in found or ():
                by.setdefault((x["a"], x["b"]), []).append(x["m"])
            out.append(Paths(word, by, c, keep, triple).find())
        return pa.array(out, pa.list_(pa.string()))

    walked = variants.join(matched, "variant").withColumn("components", path("variant", "matches", "keep", "triples"))
    return walked.where("components is not null").groupBy("part", "keep").agg(F.min_by("components", "nth").alias("components"))
