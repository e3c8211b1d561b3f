"""Import of .aff / .dic dictionaries into typed tables, with located diagnostics.

The import runs on the driver: sources are bounded (32 and 64 MiB, a million
entries) and order matters. Its result turns into DataFrames with :meth:`tables`.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.unicode import TURKIC
from ..model import Compound, Diagnostic, Flags, ImportFailed

#: Accepted SET labels.
ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "iso-8859-1": "iso-8859-1", "iso8859-1": "iso-8859-1", "iso-8859-2": "iso-8859-2", "iso8859-2": "iso-8859-2"}
#: Directives that name one flag, and where it goes.
FLAG_DIRECTIVES = {
    "CIRCUMFIX": "circumfix", "FORBIDDENWORD": "forbidden", "KEEPCASE": "keep_case", "NEEDAFFIX": "need_affix",
    "ONLYINCOMPOUND": "only_in_compound", "NOSUGGEST": "no_suggest",
}
COMPOUND_FLAG_DIRECTIVES = {
    "COMPOUNDFLAG": "flag", "COMPOUNDBEGIN": "begin", "COMPOUNDMIDDLE": "middle", "COMPOUNDEND": "end",
    "COMPOUNDPERMITFLAG": "permit", "COMPOUNDFORBIDFLAG": "forbid", "FORCEUCASE": "force_upper",
}
#: Bare markers.
MARKERS = {
    "CHECKCOMPOUNDDUP": "check_duplicate", "CHECKCOMPOUNDREP": "check_replacement", "CHECKCOMPOUNDCASE": "check_case",
    "CHECKCOMPOUNDTRIPLE": "check_triple", "SIMPLIFIEDTRIPLE": "simplified_triple",
}
#: Directives without influence on recognition.
IGNORED = frozenset("TRY PHONE MAXDIFF NGRAMSUGS MAXNGRAMSUGS MAXCPDSUGS NOSPLITSUGS ONLYMAXDIFF SUGSWITHDOTS WARN FORBIDWARN HOME NAME VERSION".split())
#: Break patterns where none are declared: (text, at start, at end).
DEFAULT_BREAKS = [("-", False, False), ("-", True, False), ("-", False, True)]


@dataclass(frozen=True)
class Rule:
    """One affix rule; ``kind`` is P or S."""

    rule_id: int
    kind: str
    flag: str
    strip: str
    add: str
    condition: str  # a regular expression over the stem
    cross_product: bool
    continuation: tuple[str, ...]
    morphology: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexeme:
    lexeme_id: int
    stem: str
    flags: tuple[str, ...]
    morphology: tuple[str, ...] = ()


@dataclass
class AffixDictionary:
    """An imported dictionary."""

    flag_mode: str = "unicode"
    language: str = ""
    lexemes: list[Lexeme] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    flags: Flags = field(default_factory=Flags)
    compound: Compound = field(default_factory=Compound)
    breaks: list[tuple[str, bool, bool]] = field(default_factory=lambda: list(DEFAULT_BREAKS))
    replacements: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    input_conversions: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    output_conversions: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    keyboard: str | None = None
    maps: list[str] = field(default_factory=list)
    word_characters: str = ""
    ignored: str = ""
    full_strip: bool = False
    complex_prefixes: bool = False
    check_sharps: bool = False
    diagnostics: list[Diagnostic] = field(default_factory=list)

    @property
    def turkic(self) -> bool:
        return re.split("[_-]", self.language)[0].lower() in TURKIC

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The dictionary as DataFrames: lexeme, lexeme_flag, affix_rule, import_diagnostics."""
        lexeme = spark.createDataFrame([(x.lexeme_id, x.stem, list(x.flags), list(x.morphology)) for x in self.lexemes], model.LEXEME_SCHEMA)
        rule = spark.createDataFrame([(r.rule_id, r.kind, r.flag, r.strip, r.add, r.condition, r.cross_product, list(r.continuation), list(r.morphology)) for r in self.rules], model.RULE_SCHEMA)
        found = spark.createDataFrame([(d.source, d.line, d.directive, d.severity, d.message) for d in self.diagnostics], model.DIAGNOSTIC_SCHEMA)
        return {"lexeme": lexeme, "lexeme_flag": lexeme.select("lexeme_id", F.explode("flags").alias("flag")), "affix_rule": rule, "import_diagnostics": found}


def flag_order(flag: str) -> tuple:
    """Numeric flags by value, before text flags by bytes."""
    return (0, int(flag[2:]), b"") if flag.startswith("n:") else (1, 0, flag[2:].encode())


def decode_flags(value: str, mode: str) -> list[str] | None:
    """The flags of a field in order, or None if it is not well formed."""
    if mode == "num":
        parts = value.split(",")
        good = all(re.fullmatch(r"\+?[0-9]+", p) and int(p) < 2**32 for p in parts)
        return [f"n:{int(p)}" for p in parts] if good else None
    if mode == "long":
        return [f"t:{value[k:k + 2]}" for k in range(0, len(value), 2)] if value and len(value) % 2 == 0 else None
    out: list[str] = []
    for c in value:
        if "︀" <= c <= "️":  # a variation selector belongs to the scalar before it
            if not out:
                return None
            out[-1] += c
        else:
            out.append("t:" + c)
    return out or None


def _class(members: str, negated: bool = False) -> str:
    return ("[^" if negated else "[") + "".join(re.escape(c) if c not in "-^]\\[&~" else "\\" + c for c in members) + "]"


def _atom(text: str) -> tuple[str, bool, bool]:
    """(regular expression, is a class, is negated) of one condition atom."""
    if text == ".":
        return r"[\s\S]", False, False
    if len(text) == 1:
        return re.escape(text), False, False
    if len(text) < 2 or text[0] != "[" or text[-1] != "]":
        raise ValueError("expected one literal or a bracket class")
    negated = text[1] == "^" and len(text) > 2
    members = text[2:-1] if negated else text[1:-1]
    if not members:
        raise ValueError("empty bracket class")
    return _class(members, negated), True, negated


def condition_regex(text: str, kind: str) -> str:
    """A condition as a regular expression to search for in a stem.

    Suffix conditions end the stem and prefix conditions start it; one anchored
    at the start by (^...) starts it for either kind.
    """
    if text == "0":
        return ""
    if len(text) > model.MAX_CONDITION_ATOMS:
        raise ValueError("condition is over 256 atoms")
    behind, rest, anchored = "", text, False
    if m := re.match(r"\(\?<!(.*?)\)", rest):
        behind, rest = f"(?<!{_atom(m[1])[0]})", rest[m.end() :]
    elif m := re.match(r"\(\^\|(.*?)\)", rest):
        expression, is_class, negated = _atom(m[1])
        if not (is_class and negated):
            raise ValueError("a start alternative needs a negated bracket class")
        behind, rest = f"(?<!{'[' + expression[2:]})", rest[m.end() :]
    if rest.startswith("(^"):
        if not re.fullmatch(r"\(\^[^)]+\)", rest):
            raise ValueError("start anchor is not well formed")
        anchored, rest = True, rest[2:-1]
    out, k = [], 0
    while k < len(rest):
        if rest[k] == "[":
            end = rest.find("]", k + 1)
            if end < 0:
                raise ValueError("bracket class does not end")
            out.append(_atom(rest[k : end + 1])[0])
            k = end + 1
        elif rest[k] in "]()|*?\\":
            raise ValueError("syntax outside the supported conditions")
        else:
            out.append(_atom(rest[k])[0])
            k += 1
    body = "".join(out)
    if anchored or kind == "P":
        return f"^{behind}{body}"
    return f"{behind}{body}$"


def declared_encoding(raw: bytes) -> str | None:
    """The SET label of an affix file, read before it is decoded."""
    for line in raw.removeprefix(codecs.BOM_UTF8).splitlines():
        fields = line.split()
        if len(fields) >= 2 and fields[0] == b"SET":
            return fields[1].decode("latin-1")
    return None


def decode(raw: bytes, encoding: str) -> str:
    """Decode strictly; ``utf-8+iso-8859-2`` reads bytes that are not UTF-8 as ISO 8859-2."""
    raw = raw.removeprefix(codecs.BOM_UTF8)
    if encoding == "utf-8+iso-8859-2":
        return raw.decode("utf-8", "latin2_fallback").replace("\x85", "\n")
    return raw.decode(encoding)


codecs.register_error("latin2_fallback", lambda e: (e.object[e.start : e.start + 1].replace(b"\x85", b"\n").decode("iso-8859-2"), e.start + 1))


class _Importer:
    def __init__(self, aff_name: str, dic_name: str) -> None:
        self.out = AffixDictionary()
        self.aff_name, self.dic_name = aff_name, dic_name
        self.aliases: list[tuple[str, ...] | None] = []
        self.morphologies: list[tuple[str, ...] | None] = []
        self._raw_conditions: list[tuple[int, str, str]] = []
        self.once: set[str] = set()

    def say(self, line: int, directive: str, message: str, severity: str = "error", source: str | None = None) -> None:
        self.out.diagnostics.append(Diagnostic(source or self.aff_name, line, directive, severity, message))

    # Affix file.

    def aff(self, text: str) -> None:
        # Blank lines and comments stay, without fields: in some blocks they use up a row.
        lines = [(n, self._fields(line)) for n, line in enumerate(text.removesuffix("\n").split("\n"), 1) if self._fits(n, line)]
        at = 0
        while at < len(lines):
            number, fields = lines[at]
            at += 1
            if not fields:
                continue
            name, rest = fields[0], fields[1:]
            handler: Callable | None = getattr(self, f"_on_{name.lower()}", None) if name.isupper() else None
            if name in ("AF", "AM", "ICONV", "OCONV", "REP", "MAP", "BREAK", "COMPOUNDRULE", "CHECKCOMPOUNDPATTERN"):
                at = self._block(name, number, rest, lines, at)
            elif name in ("PFX", "SFX"):
                at = self._affixes(name, number, rest, lines, at)
            elif name in FLAG_DIRECTIVES or name in COMPOUND_FLAG_DIRECTIVES:
                self._one_flag(name, number, rest)
            elif name in MARKERS or name in ("CHECKSHARPS", "FULLSTRIP", "COMPLEXPREFIXES"):
                self._marker(name, number, rest)
            elif handler:
                handler(number, rest)
            elif name in IGNORED:
                self.say(number, name, "has no influence on recognition", "warning")
            else:
                self.say(number, name, "unknown directive may affect recognition")
        if self.out.ignored:
            self._strip_ignored()

    def _fits(self, number: int, line: str) -> bool:
        if len(line.encode("utf-8", "surrogatepass")) > model.MAX_LINE_BYTES:
            self.say(number, "line", "line is over 32 KiB")
            return False
        return True

    @staticmethod
    def _fields(line: str) -> list[str]:
        out = []
        for f in line.split():
            if f.startswith("#"):
                break
            out.append(f)
        return out

    def _first(self, name: str, number: int) -> bool:
        if name in self.once:
            self.say(number, name, "declared twice")
            return False
        self.once.add(name)
        return True

    def _on_set(self, number: int, rest: list[str]) -> None:
        if len(rest) != 1 or rest[0].lower() not in ENCODINGS:
            self.say(number, "SET", "unsupported encoding")

    def _on_flag(self, number: int, rest: list[str]) -> None:
        modes = {"UTF-8": "unicode", "UTF8": "unicode", "long": "long", "num": "num"}
        if len(rest) != 1 or rest[0] not in modes:
            self.say(number, "FLAG", "expected UTF-8, long or num")
        elif self._first("FLAG", number):
            self.out.flag_mode = modes[rest[0]]

    def _on_lang(self, number: int, rest: list[str]) -> None:
        if len(rest) != 1:
            self.say(number, "LANG", "expected one language")
        elif self._first("LANG", number):
            self.out.language = rest[0]

    def _flag(self, value: str) -> str | None:
        got = decode_flags(value, self.out.flag_mode)
        return got[0] if got and len(got) == 1 else None

    def _one_flag(self, name: str, number: int, rest: list[str]) -> None:
        flag = self._flag(rest[0]) if len(rest) == 1 else None
        if flag is None:
            self.say(number, name, "expected one flag")
        elif self._first(name, number):
            target, attribute = (self.out.flags, FLAG_DIRECTIVES[name]) if name in FLAG_DIRECTIVES else (self.out.compound, COMPOUND_FLAG_DIRECTIVES[name])
            setattr(target, attribute, flag)

    def _marker(self, name: str, number: int, rest: list[str]) -> None:
        if rest:
            self.say(number, name, "takes no value")
        elif self._first(name, number):
            if name in MARKERS:
                setattr(self.out.compound, MARKERS[name], True)
            else:
                setattr(self.out, {"CHECKSHARPS": "check_sharps", "FULLSTRIP": "full_strip", "COMPLEXPREFIXES": "complex_prefixes"}[name], True)

    def _number(self, name: str, number: int, value: str, low: int, high: int) -> int | None:
        if re.fullmatch(r"\+?[0-9]+", value) and low <= int(value) <= high:
            return int(value)
        self.say(number, name, f"expected a number from {low} to {high}")
        return None

    def _on_compoundmin(self, number: int, rest: list[str]) -> None:
        if len(rest) != 1:
            self.say(number, "COMPOUNDMIN", "expected one number")
        elif (n := self._number("COMPOUNDMIN", number, rest[0], 0, 2**63)) is not None and self._first("COMPOUNDMIN", number):
            self.out.compound.minimum = max(1, n)

    def _on_compoundwordmax(self, number: int, rest: list[str]) -> None:
        if not 1 <= len(rest) <= 2:
            self.say(number, "COMPOUNDWORDMAX", "expected one number")
        elif (n := self._number("COMPOUNDWORDMAX", number, rest[0], 1, 256)) is not None and self._first("COMPOUNDWORDMAX", number):
            self.out.compound.max_words = n

    def _on_compoundsyllable(self, number: int, rest: list[str]) -> None:
        if len(rest) != 2:
            self.say(number, "COMPOUNDSYLLABLE", "expected a number and vowels")
        elif (n := self._number("COMPOUNDSYLLABLE", number, rest[0], 0, 2**31)) is not None and self._first("COMPOUNDSYLLABLE", number):
            self.out.compound.max_syllables, self.out.compound.vowels = n, rest[1]

    def _on_wordchars(self, number: int, rest: list[str]) -> None:
        if len(rest) != 1:
            self.say(number, "WORDCHARS", "expected characters")
        elif self._first("WORDCHARS", number):
            self.out.word_characters = rest[0]

    def _on_ignore(self, number: int, rest: list[str]) -> None:
        if len(rest) != 1:
            self.say(number, "IGNORE", "expected characters")
        elif self._first("IGNORE", number):
            self.out.ignored = rest[0]

    def _on_key(self, number: int, rest: list[str]) -> None:
        if len(rest) != 1:
            self.say(number, "KEY", "expected one layout", "warning")
        elif "KEY" in self.once:
            self.say(number, "KEY", "declared twice", "warning")
        else:
            self.once.add("KEY")
            self.out.keyboard = rest[0]

    def _block(self, name: str, number: int, rest: list[str], lines: list, at: int) -> int:
        """A counted block: its header, then as many rows of the same name.

        Aliases and conversions pass over blank lines and comments; in the other
        blocks every line is a row. A row that is not well formed is reported and used up.
        """
        severity = "warning" if name in ("AM", "REP", "MAP") else "error"
        least = 1 if name in ("COMPOUNDRULE", "CHECKCOMPOUNDPATTERN") else 0
        most = {"AF": model.MAX_ALIASES, "AM": model.MAX_ALIASES, "BREAK": model.MAX_BREAKS, "COMPOUNDRULE": model.MAX_COMPOUND_RULES, "CHECKCOMPOUNDPATTERN": model.MAX_COMPOUND_PATTERNS}.get(name, model.MAX_CONVERSIONS)
        if len(rest) != 1 or not (rest[0].isascii() and rest[0].isdigit()) or not least <= int(rest[0]) <= most:
            self.say(number, name, f"expected a count from {least} to {most}", severity)
            return at
        if name == "BREAK":  # the first block replaces the defaults, further ones add to it
            if name not in self.once:
                self.out.breaks = []
        elif name != "COMPOUNDRULE" and name in self.once:
            self.say(number, name, "declared twice", severity)
            return at
        self.once.add(name)
        handler = getattr(self, f"_row_{name.lower()}")
        for _ in range(int(rest[0])):
            while at < len(lines) and not lines[at][1] and name in ("AF", "AM", "ICONV", "OCONV"):
                at += 1
            if at >= len(lines):
                self.say(number, name, "the block is shorter than its count", severity)
                return at
            row_number, fields = lines[at]
            at += 1
            if fields[:1] == [name]:
                problem = handler(fields[1:], fields)
            else:
                problem = "not a row of this block"
                if name in ("AF", "AM"):  # the numbers of later aliases stay
                    (self.aliases if name == "AF" else self.morphologies).append(None)
            if problem is not None:
                self.say(row_number, name, problem, severity)
        return at

    def _row_af(self, rest: list[str], _: list[str]) -> str | None:
        got = [] if not rest else decode_flags(rest[0], self.out.flag_mode) if len(rest) == 1 else None
        if got is not None and len(got) > model.MAX_FLAGS:
            got = None
        self.aliases.append(None if got is None else tuple(sorted(set(got), key=flag_order)))
        return "not a flag alias" if got is None else None

    def _row_am(self, rest: list[str], _: list[str]) -> str | None:
        self.morphologies.append(tuple(rest) if rest else None)
        return None if rest else "empty morphology alias"

    def _conversion(self, rest: list[str], into: list) -> str | None:
        if len(rest) != 2:
            return "expected a pattern and its replacement"
        source, start, end = rest[0], rest[0].startswith("_"), rest[0][1 if rest[0].startswith("_") else 0 :].endswith("_")
        source = source[1:] if start else source
        source = source[:-1] if end else source
        if not source:
            return "empty pattern"
        into.append((source, "" if rest[1] == "0" else rest[1], start, end))
        return None

    def _row_iconv(self, rest: list[str], _: list[str]) -> str | None:
        return self._conversion(rest, self.out.input_conversions)

    def _row_oconv(self, rest: list[str], _: list[str]) -> str | None:
        return self._conversion(rest, self.out.output_conversions)

    def _row_rep(self, rest: list[str], _: list[str]) -> str | None:
        if len(rest) != 2:
            return "expected a pattern and its replacement"
        source, start, end = rest[0].removeprefix("^").removesuffix("$"), rest[0].startswith("^"), rest[0].removeprefix("^").endswith("$")
        if not source or not rest[1]:
            return "empty pattern"
        self.out.replacements.append((source, rest[1], start, end))
        return None

    def _row_map(self, rest: list[str], _: list[str]) -> str | None:
        if len(rest) != 1 or len(rest[0]) < 2:
            return "expected two characters or more"
        self.out.maps.append(rest[0])
        return None

    def _row_break(self, rest: list[str], _: list[str]) -> str | None:
        if len(rest) != 1:
            return "expected one pattern"
        start, end = rest[0].startswith("^"), rest[0].endswith("$") and len(rest[0]) > 1
        text = rest[0][1 if start else 0 : -1 if end else None]
        if not text or (start and end):
            return "empty pattern"
        self.out.breaks.append((text, start, end))
        return None

    def _row_compoundrule(self, rest: list[str], _: list[str]) -> str | None:
        if len(rest) != 1:
            return "expected one rule"
        try:
            found = compound_rules(rest[0], self.out.flag_mode)
        except ValueError as error:
            return str(error)
        if len(self.out.compound.rules) + len(found) > model.MAX_EXPANSIONS:
            return "rules expand to over 16,384 sequences"
        self.out.compound.rules += found
        return None

    def _row_checkcompoundpattern(self, rest: list[str], _: list[str]) -> str | None:
        if not 2 <= len(rest) <= 3:
            return "expected an ending, a beginning and at most a replacement"
        parts = []
        for value in rest[:2]:
            text, slash, flag = value.partition("/")
            decoded = self._flag(flag) if slash else None
            if slash and decoded is None:
                return "not a flag"
            parts += [text, decoded]
        if not any(parts):
            return "empty pattern"
        self.out.compound.patterns.append((*parts, rest[2] if len(rest) == 3 else None))  # type: ignore[arg-type]
        return None

    def _affixes(self, name: str, number: int, rest: list[str], lines: list, at: int) -> int:
        flag = self._flag(rest[0]) if len(rest) == 3 else None
        if flag is None or rest[1] not in ("Y", "N") or not rest[2].isdigit():
            self.say(number, name, "expected a flag, Y or N, and a count")
            return at
        if len(self.out.rules) + int(rest[2]) > model.MAX_AFFIX_RULES:
            self.say(number, name, "over 100,000 rules")
            return at
        for _ in range(int(rest[2])):
            while at < len(lines) and not lines[at][1]:
                at += 1
            if at >= len(lines) or lines[at][1][0] != name:
                self.say(number, name, "fewer rules than announced")
                return at
            row_number, fields = lines[at]
            at += 1
            self._rule(name, row_number, fields[1:], flag, rest[1] == "Y")
        return at

    def _rule(self, name: str, number: int, rest: list[str], flag: str, cross: bool) -> None:
        if len(rest) < 3 or self._flag(rest[0]) != flag:
            self.say(number, name, "expected the flag, what to strip and what to add")
            return
        add, slash, more = rest[2].partition("/")
        continuation: tuple[str, ...] | None = ()
        if slash:
            continuation = self._entry_flags(more)
        if continuation is None:
            self.say(number, name, "continuation flags are not well formed")
            return
        try:
            condition = condition_regex(rest[3] if len(rest) > 3 else ".", name[0])
        except ValueError as error:
            self.say(number, name, str(error))
            return
        self._raw_conditions.append((number, name, rest[3] if len(rest) > 3 else "."))
        empty = lambda v: "" if v == "0" else v
        self.out.rules.append(Rule(len(self.out.rules), name[0], flag, empty(rest[1]), empty(add), condition, cross, continuation, tuple(rest[4:])))

    def _strip_ignored(self) -> None:
        gone = str.maketrans("", "", self.out.ignored)
        for number, name, condition in self._raw_conditions:
            if set(condition) & set(self.out.ignored):
                self.say(number, name, "an ignored character stands in a condition")
        self.out.rules = [Rule(r.rule_id, r.kind, r.flag, r.strip.translate(gone), r.add.translate(gone), r.condition, r.cross_product, r.continuation, r.morphology) for r in self.out.rules]

    def _entry_flags(self, value: str) -> tuple[str, ...] | None:
        if self.aliases and value.isascii() and value.isdigit() or (self.aliases and not value):
            at = int(value or 0) - 1
            return self.aliases[at] if 0 <= at < len(self.aliases) else None
        got = decode_flags(value, self.out.flag_mode)
        if got is None or len(got) > model.MAX_FLAGS:
            return None
        return tuple(sorted(set(got), key=flag_order))

    # Word file.

    def dic(self, text: str) -> None:
        gone = str.maketrans("", "", self.out.ignored)
        first = True
        for number, line in enumerate(text.split("\n"), 1):
            line = line.rstrip("\r")
            bare = line.strip()
            if not bare or bare[0] in "#/":
                continue
            if len(line.encode("utf-8", "surrogatepass")) > model.MAX_LINE_BYTES:
                self.say(number, "entry", "line is over 32 KiB", source=self.dic_name)
                continue
            if first:
                first = False
                if bare.isascii() and bare.isdigit():
                    continue
            if len(self.out.lexemes) >= model.MAX_ENTRIES:
                self.say(number, "entry", "over a million entries", source=self.dic_name)
                return
            fields = line.split()
            m = re.fullmatch(r"((?:\\[/\\]|[^/])*)(?:/(.*))?", fields[0], re.S)
            stem = re.sub(r"\\([/\\])", r"\1", m[1]).translate(gone) if m else ""
            flags: tuple[str, ...] | None = ()
            if m and m[2] is not None:
                flags = self._entry_flags(m[2])
            if not stem:
                self.say(number, "entry", "empty stem", source=self.dic_name)
            elif flags is None:
                self.say(number, "entry", "flags are not well formed", source=self.dic_name)
            else:
                self.out.lexemes.append(Lexeme(len(self.out.lexemes), stem, flags, self._morphology(number, fields[1:])))
        ordered = sorted(self.out.lexemes, key=lambda x: x.stem.encode("utf-8", "surrogatepass"))
        self.out.lexemes = [Lexeme(k, x.stem, x.flags, x.morphology) for k, x in enumerate(ordered)]

    def _morphology(self, number: int, fields: list[str]) -> tuple[str, ...]:
        if fields and self.morphologies and fields[0].isascii() and fields[0].isdigit():
            at = int(fields[0]) - 1
            known = self.morphologies[at] if 0 <= at < len(self.morphologies) else None
            if known is None:
                self.say(number, "AM", "undefined morphology alias", "warning", self.dic_name)
            return (known or ()) + tuple(fields[1:])
        return tuple(fields)


def compound_rules(text: str, mode: str) -> list[tuple[str, ...]]:
    """The literal flag sequences that a compound rule stands for."""
    most = model.MAX_RULE_COMPONENTS

    def sized(rules: Iterator[tuple[str, ...]] | list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        good = [r for r in rules if 2 <= len(r) <= most]
        if not good:
            raise ValueError("a rule has two to sixteen components")
        return good

    if "(" in text or ")" in text:
        if not re.fullmatch(r"(?:\([^()*+?]+\))+", text):
            raise ValueError("groups hold one literal flag each")
        groups = [decode_flags(g, mode) for g in re.findall(r"\(([^)]*)\)", text)]
        if any(g is None or len(g) != 1 for g in groups):
            raise ValueError("groups hold one literal flag each")
        return sized([tuple(g[0] for g in groups if g)])
    if mode != "unicode":
        return sized([tuple(decode_flags(text, mode) or ())])
    tokens = decode_flags(text, mode) or []
    spans = {"t:*": (0, most), "t:+": (1, most), "t:?": (0, 1)}
    found: list[tuple[str, ...]] = [()]
    k = 0
    while k < len(tokens):
        if tokens[k] in spans:
            raise ValueError("a quantifier follows a flag")
        low, high = spans.get(tokens[k + 1], (1, 1)) if k + 1 < len(tokens) else (1, 1)
        found = [f + (tokens[k],) * n for f in found for n in range(low, min(high, most - len(f)) + 1)]
        if len(found) > model.MAX_EXPANSIONS_PER_RULE:
            raise ValueError("a rule expands to over 1,024 sequences")
        k += 2 if k + 1 < len(tokens) and tokens[k + 1] in spans else 1
    return sized(found)


def import_text(aff: str, dic: str, strict: bool = True, aff_name: str = "aff", dic_name: str = "dic") -> AffixDictionary:
    """Import decoded sources. ``strict`` raises on any error; else they stay as diagnostics."""
    work = _Importer(aff_name, dic_name)
    work.aff(aff.replace("\r\n", "\n"))
    work.dic(dic.replace("\r\n", "\n"))
    if strict and any(d.severity == "error" for d in work.out.diagnostics):
        raise ImportFailed(work.out.diagnostics)
    return work.out


def import_bytes(aff: bytes, dic: bytes, strict: bool = True, encodings: tuple[str, str] | None = None) -> AffixDictionary:
    """Import raw sources; ``encodings`` are reviewed ones for each file and must agree with SET."""
    if len(aff) > model.MAX_AFF_BYTES or len(dic) > model.MAX_DIC_BYTES:
        raise ImportFailed([Diagnostic("aff" if len(aff) > model.MAX_AFF_BYTES else "dic", 0, "size", "error", "source is too large")])
    label = declared_encoding(aff)
    declared = ENCODINGS.get((label or "utf-8").lower())
    if declared is None:
        raise ImportFailed([Diagnostic("aff", 0, "SET", "error", f"unsupported encoding {label}")])
    used = encodings or (declared, declared)
    for name in used:
        if name != declared and not (declared == "utf-8" and name == "utf-8+iso-8859-2"):
            raise ImportFailed([Diagnostic("aff", 0, "SET", "error", f"{name} does not agree with SET {declared}")])
    texts = []
    for source, raw, name in (("aff", aff, used[0]), ("dic", dic, used[1])):
        try:
            texts.append(decode(raw, name))
        except UnicodeDecodeError as error:
            line = raw[: error.start].count(b"\n") + 1
            raise ImportFailed([Diagnostic(source, line, "encoding", "error", f"byte {error.start} is not {name}")]) from error
    return import_text(texts[0], texts[1], strict)


def read_dictionary(spark: SparkSession, aff_path: str, dic_path: str | None = None, strict: bool = True) -> AffixDictionary:
    """Import files through Spark's readers, so any path that they open will do."""
    dic_path = dic_path or re.sub(r"\.aff$", ".dic", aff_path)
    rows = {}
    for name, path, most in (("aff", aff_path, model.MAX_AFF_BYTES), ("dic", dic_path, model.MAX_DIC_BYTES)):
        found = spark.read.format("binaryFile").load(path)
        if found.select("length").first()[0] > most:
            raise ImportFailed([Diagnostic(name, 0, "size", "error", "source is too large")])
        rows[name] = bytes(found.select("content").first()[0])
    return import_bytes(rows["aff"], rows["dic"], strict)
