"""Schemas, limits and errors of the lexical engine."""

from __future__ import annotations

from dataclasses import dataclass, field

WORD_SCHEMA = "word string"
FREQUENCY_SCHEMA = "word string, frequency decimal(20,0)"
LEXEME_SCHEMA = "lexeme_id bigint, stem string, flags array<string>, morphology array<string>"
RULE_SCHEMA = (
    "rule_id int, kind string, flag string, strip string, add string, condition string, cross_product boolean, "
    "continuation array<string>, morphology array<string>"
)
DIAGNOSTIC_SCHEMA = "source string, line int, directive string, severity string, message string"

#: Import and lookup limits.
MAX_AFF_BYTES = 32 << 20
MAX_DIC_BYTES = 64 << 20
MAX_LINE_BYTES = 32 << 10
MAX_AFFIX_RULES = 100_000
MAX_ENTRIES = 1_000_000
MAX_FLAGS = 4_096
MAX_CONDITION_ATOMS = 256
MAX_CHAIN = 8
MAX_DERIVATIONS = 4_096
MAX_CANDIDATES = 8_192
MAX_COMPOUND_SCALARS = 256
MAX_COMPOUND_RULES = 1_024
MAX_COMPOUND_PATTERNS = 1_024
MAX_PATTERN_VARIANTS = 32
MAX_RULE_COMPONENTS = 16
MAX_EXPANSIONS_PER_RULE = 1_024
MAX_EXPANSIONS = 16_384
MAX_BREAKS = 256
MAX_REPLACEMENTS = 4_096
MAX_CONVERSIONS = 4_096
MAX_MAPS = 4_096
MAX_ALIASES = 100_000
MAX_ARTIFACT_BYTES = 128 << 20
MAX_FORMS_PER_SEED = 64


@dataclass(frozen=True)
class SuggestOptions:
    """Limits of a suggestion run."""

    max_results: int = 8
    max_distance: int = 2
    max_scalars: int = 64
    max_candidates: int = 100_000
    max_cells: int = 1_000_000


@dataclass(frozen=True)
class Policy:
    """What an analysis ignores and how it splits identifiers."""

    ignored_classes: frozenset[str] = frozenset({"url", "email", "number", "hash", "path", "base64", "uuid", "domain", "generated-token"})
    ignored_words: frozenset[str] = frozenset()
    ignored_patterns: tuple[str, ...] = ()
    min_length: int = 2
    join_single_letter: bool = False
    marker: str = "glyphmill:"


class LexicalError(ValueError):
    """Base of the errors below."""


class WordListError(LexicalError):
    """An empty entry; ``position`` counts from one."""

    def __init__(self, position: int) -> None:
        super().__init__(f"word list entry {position} is empty")
        self.position = position


class FrequencyListError(LexicalError):
    """A row that is not word<TAB>count; ``line`` counts from one."""

    def __init__(self, line: int, what: str) -> None:
        super().__init__(f"line {line}: {what}")
        self.line = line


class ImportFailed(LexicalError):
    """A strict import with errors; carries all diagnostics."""

    def __init__(self, diagnostics: list) -> None:
        super().__init__(f"{sum(d.severity == 'error' for d in diagnostics)} errors")
        self.diagnostics = diagnostics


class ArtifactError(LexicalError):
    """An artifact that cannot be loaded; ``reason`` names the first gate that failed."""

    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason


class ConfigError(LexicalError):
    """A bad line of a project configuration."""

    def __init__(self, line: int, message: str) -> None:
        super().__init__(f"line {line}: {message}")
        self.line = line


@dataclass(frozen=True)
class Diagnostic:
    """What an import found."""

    source: str
    line: int
    directive: str
    severity: str
    message: str


@dataclass
class Flags:
    """The special flags of an affix dictionary; None where not declared."""

    circumfix: str | None = None
    forbidden: str | None = None
    keep_case: str | None = None
    need_affix: str | None = None
    only_in_compound: str | None = None
    no_suggest: str | None = None


@dataclass
class Compound:
    """How words are joined into compounds."""

    flag: str | None = None
    begin: str | None = None
    middle: str | None = None
    end: str | None = None
    permit: str | None = None
    forbid: str | None = None
    force_upper: str | None = None
    minimum: int = 3
    max_words: int | None = None
    max_syllables: int | None = None
    vowels: str = ""
    rules: list[tuple[str, ...]] = field(default_factory=list)
    patterns: list[tuple[str, str | None, str, str | None, str | None]] = field(default_factory=list)
    check_duplicate: bool = False
    check_replacement: bool = False
    check_case: bool = False
    check_triple: bool = False
    simplified_triple: bool = False

    @property
    def possible(self) -> bool:
        return bool(self.flag or self.rules or (self.begin and self.end))
