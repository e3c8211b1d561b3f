"""Forms that affix rules derive from lexemes: one row per form, made lexeme by lexeme.

The rules are bounded (100,000) and go to every task; each lexeme is expanded by
itself with a bound of its own, so the expansion needs no exchange and a
dictionary of any size spreads over the cluster. Recognition is then an
equi-join of words with forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..sources.affixfiles import AffixDictionary, Rule, flag_order

FORM_SCHEMA = (
    "form string, lexeme_id bigint, stem string, depth int, accepted boolean, keep_case boolean, suggestable boolean, "
    "flags array<string>, rules array<int>, first_kind string, permitted boolean, compound_ok boolean, nth int"
)


@dataclass(frozen=True)
class Derived:
    """A form on the way from a lexeme."""

    form: str
    flags: tuple[str, ...]
    rules: tuple[int, ...] = ()
    prefixes: int = 0
    suffixes: int = 0
    kind: str = ""
    cross: bool = True
    circumfix: frozenset[str] = frozenset()


class Deriver:
    """Applies the rules of a dictionary to one lexeme at a time."""

    def __init__(self, dictionary: AffixDictionary) -> None:
        self.flags, self.compound = dictionary.flags, dictionary.compound
        self.full_strip, self.most_prefixes = dictionary.full_strip, 2 if dictionary.complex_prefixes else 1
        self.rules = {r.rule_id: r for r in dictionary.rules}
        self.by_flag: dict[tuple[str, str], list[Rule]] = {}
        for r in dictionary.rules:
            self.by_flag.setdefault((r.kind, r.flag), []).append(r)
        self.conditions = {c: re.compile(c) for c in {r.condition for r in dictionary.rules}}

    def apply(self, rule: Rule, stem: str) -> str | None:
        """The form that a rule makes of a stem."""
        if not self.conditions[rule.condition].search(stem):
            return None
        if rule.kind == "P":
            if not stem.startswith(rule.strip):
                return None
            rest = stem[len(rule.strip) :]
            return rule.add + rest if rest or self.full_strip else None
        if not stem.endswith(rule.strip):
            return None
        rest = stem[: len(stem) - len(rule.strip)]
        return rest + rule.add if rest or self.full_strip else None

    def _next(self, state: Derived, origin: tuple[str, ...], kind: str) -> Iterator[Derived]:
        if kind == "P" and (state.prefixes >= self.most_prefixes or state.suffixes) or kind == "S" and state.suffixes >= 2:
            return
        turned = bool(state.kind) and state.kind != kind  # then only the lexeme's own flags and cross products count
        for flag in origin if turned else state.flags:
            for rule in self.by_flag.get((kind, flag), ()):
                if rule.rule_id in state.rules or turned and not (state.cross and rule.cross_product):
                    continue
                form = self.apply(rule, state.form)
                if form is not None:
                    around = state.circumfix | {kind} if self.flags.circumfix in rule.continuation else state.circumfix
                    yield Derived(form, rule.continuation, (*state.rules, rule.rule_id), state.prefixes + (kind == "P"), state.suffixes + (kind == "S"), kind, rule.cross_product, around)

    def accepted(self, state: Derived, origin: tuple[str, ...]) -> bool:
        f = self.flags
        return not (f.forbidden in state.flags or f.need_affix in state.flags or f.only_in_compound in origin or f.only_in_compound in state.flags or len(state.circumfix) == 1)

    def accepted_in_compound(self, state: Derived, origin: tuple[str, ...]) -> bool:
        f, c = self.flags, self.compound
        return not (f.forbidden in state.flags or c.forbid in origin or c.forbid in state.flags or f.need_affix in state.flags or len(state.circumfix) == 1)

    def derive(self, stem: str, flags: tuple[str, ...]) -> Iterator[Derived]:
        """All derived forms, last found first, up to the limit of derivations."""
        work, made = [Derived(stem, flags)], 0
        while work:
            state = work.pop()
            if state.rules:
                yield state
            if len(state.rules) == model.MAX_CHAIN:
                continue
            for kind in "PS":
                for new in self._next(state, flags, kind):
                    if made == model.MAX_DERIVATIONS:
                        return
                    made += 1
                    work.append(new)

    def single(self, stem: str, flags: tuple[str, ...]) -> Iterator[Derived]:
        """The forms of one rule; no limit applies to them."""
        for kind in "PS":
            yield from self._next(Derived(stem, flags), flags, kind)


def form_table(spark: SparkSession, dictionary: AffixDictionary) -> DataFrame:
    """All forms: the stems themselves (depth 0), those of one rule, and of several."""
    deriver = spark.sparkContext.broadcast(Deriver(dictionary))
    f, c = dictionary.flags, dictionary.compound
    lexemes = dictionary.tables(spark)["lexeme"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = deriver.value
        schema = pa.schema([
            ("form", pa.string()), ("lexeme_id", pa.int64()), ("stem", pa.string()), ("depth", pa.int32()), ("accepted", pa.bool_()), ("keep_case", pa.bool_()), ("suggestable", pa.bool_()),
            ("flags", pa.list_(pa.string())), ("rules", pa.list_(pa.int32())), ("first_kind", pa.string()), ("permitted", pa.bool_()), ("compound_ok", pa.bool_()), ("nth", pa.int32()),
        ])
        held: list[dict] = []
        for batch in batches:
            for lexeme in batch.to_pylist():
                flags = tuple(lexeme["flags"] or ())
                common = {"lexeme_id": lexeme["lexeme_id"], "stem": lexeme["stem"], "keep_case": f.keep_case in flags, "flags": list(flags)}
                barred = f.forbidden in flags
                usable = not (barred or f.need_affix in flags or f.only_in_compound in flags)
                held.append(common | {"form": lexeme["stem"], "depth": 0, "accepted": usable, "suggestable": f.no_suggest not in flags, "rules": [], "first_kind": "", "permitted": True, "compound_ok": not barred, "nth": 0})
                if barred:
                    continue
                nth = 0
                several = (s for s in d.derive(lexeme["stem"], flags) if len(s.rules) > 1)
                for source in (d.single(lexeme["stem"], flags), several):
                    for state in source:
                        good, joins = d.accepted(state, flags), len(state.rules) == 1 and d.accepted_in_compound(state, flags)
                        if not (good or joins):
                            continue
                        nth += good
                        held.append(common | {
                            "form": state.form, "depth": len(state.rules), "accepted": good, "suggestable": f.no_suggest not in flags and f.no_suggest not in state.flags, "rules": list(state.rules),
                            "first_kind": d.rules[state.rules[0]].kind, "permitted": c.permit is not None and c.permit in d.rules[state.rules[0]].continuation, "compound_ok": joins, "nth": nth,
                        })
                        if len(held) >= 4096:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return lexemes.mapInArrow(rows, FORM_SCHEMA)


def flag_origins(dictionary: AffixDictionary) -> list[tuple[str, str, str]]:
    """(kind, terminal flag, origin flag): the flags from which a rule's flag can be reached."""
    out = []
    for kind in "PS":
        parents: dict[str, set[str]] = {}
        for r in dictionary.rules:
            if r.kind == kind:
                for flag in r.continuation:
                    parents.setdefault(flag, set()).add(r.flag)
        for flag in sorted({r.flag for r in dictionary.rules if r.kind == kind}, key=flag_order):
            seen, work = {flag}, [flag]
            while work:
                for parent in parents.get(work.pop(), ()):
                    if parent not in seen:
                        seen.add(parent)
                        work.append(parent)
            out += [(kind, flag, origin) for origin in sorted(seen, key=flag_order)]
    return out


def over_candidate_limit(words: DataFrame, dictionary: AffixDictionary) -> DataFrame:
    """The words for which too many lexemes could be the origin of a chain of rules.

    Decided once for each set of matching flags, not for each word.
    """
    spark = words.sparkSession
    adds = spark.createDataFrame(sorted({(r.kind, r.add, r.flag) for r in dictionary.rules}), "kind string, add string, flag string")
    longest = max((len(r.add) for r in dictionary.rules), default=0)
    distinct = words.select("word").distinct()
    sizes = F.sequence(F.lit(0), F.least(F.length("word"), F.lit(longest)))
    ends = F.flatten(F.transform(sizes, lambda n: F.array(
        F.struct(F.lit("P").alias("kind"), F.substr("word", F.lit(1), n).alias("add")),
        F.struct(F.lit("S").alias("kind"), F.substr("word", F.length("word") - n + 1).alias("add")),
    )))
    matched = distinct.select("word", F.explode(ends).alias("e")).select("word", "e.*").join(F.broadcast(adds), ["kind", "add"])
    keyed = matched.groupBy("word").agg(F.sort_array(F.collect_set(F.concat_ws(":", "kind", "flag"))).alias("_set"))
    origins = spark.createDataFrame([(f"{k}:{t}", o) for k, t, o in flag_origins(dictionary)], "terminal string, flag string")
    sets = keyed.select("_set").distinct()
    lexeme_flag = dictionary.tables(spark)["lexeme_flag"]
    counted = (
        sets.select("_set", F.explode("_set").alias("terminal")).join(F.broadcast(origins), "terminal").select("_set", "flag").distinct()
        .join(lexeme_flag, "flag").groupBy("_set").agg(F.count_distinct("lexeme_id").alias("n"))
    )
    return keyed.join(counted.where(F.col("n") > model.MAX_CANDIDATES).select("_set"), "_set", "left_semi").select("word")
