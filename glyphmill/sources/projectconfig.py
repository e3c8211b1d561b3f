"""The project configuration: twelve keys, one `key = value` a line."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.classify import CLASSES
from ..model import ConfigError, Policy

#: The keys that may repeat, and the field that each adds to.
LISTS = {
    "ignore-word": "ignored_words", "ignore-pattern": "ignored_patterns", "include": "include", "exclude": "exclude", "ignore-class": "ignored_classes",
    "check-class": "checked_classes", "dictionary": "dictionaries", "compiled-dictionary": "artifacts", "hunspell": "affix_dictionaries",
}
#: The order in which the keys are written.
ORDER = (
    "ignore-word", "ignore-pattern", "minimum-word-length", "single-letter-prefix", "include", "exclude", "ignore-class", "check-class",
    "dictionary", "compiled-dictionary", "hunspell", "comment-syntax",
)


@dataclass
class ProjectConfig:
    """A parsed configuration."""

    ignored_words: set[str] = field(default_factory=set)
    ignored_patterns: set[str] = field(default_factory=set)
    minimum_length: int | None = None
    single_letter: str | None = None
    include: set[str] = field(default_factory=set)
    exclude: set[str] = field(default_factory=set)
    ignored_classes: set[str] = field(default_factory=set)
    checked_classes: set[str] = field(default_factory=set)
    dictionaries: set[str] = field(default_factory=set)
    artifacts: set[str] = field(default_factory=set)
    affix_dictionaries: set[str] = field(default_factory=set)
    comment: str | None = None

    @classmethod
    def parse(cls, text: str) -> ProjectConfig:
        out = cls()
        for number, raw in enumerate(text.splitlines(), 1):
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            key, equals, value = (part.strip() for part in line.partition("="))
            if not equals:
                raise ConfigError(number, "expected key = value")
            if not value:
                raise ConfigError(number, "the value is empty")
            out._take(number, key, value)
        return out

    def _take(self, number: int, key: str, value: str) -> None:
        if key in ("ignore-class", "check-class") and value not in CLASSES:
            raise ConfigError(number, f"unknown token class {value}")
        if key in LISTS:
            getattr(self, LISTS[key]).add(value)
        elif key == "minimum-word-length":
            if not (value.isascii() and value.removeprefix("+").isdigit()):
                raise ConfigError(number, "expected a number")
            self.minimum_length = int(value)
        elif key == "single-letter-prefix":
            if value not in ("join", "separate"):
                raise ConfigError(number, "expected join or separate")
            self.single_letter = value
        elif key == "comment-syntax":
            if value not in ("none", "html") and not (value.startswith("line:") and len(value) > 5):
                raise ConfigError(number, "expected none, html or line:<prefix>")
            self.comment = value
        else:
            raise ConfigError(number, f"unknown key {key}")

    def text(self) -> str:
        """The canonical text: keys in their order, values sorted."""
        single = {"minimum-word-length": self.minimum_length, "single-letter-prefix": self.single_letter, "comment-syntax": self.comment}
        out = []
        for key in ORDER:
            if key in single:
                values = [] if single[key] is None else [single[key]]
            elif key in ("ignore-class", "check-class"):
                values = sorted(getattr(self, LISTS[key]))
            else:
                values = sorted(getattr(self, LISTS[key]), key=lambda v: v.encode())
            out += [f"{key} = {v}\n" for v in values]
        return "".join(out)

    def policy(self, marker: str = "glyphmill:") -> Policy:
        """The policy: ignored classes are added to the usual ones, checked ones taken away."""
        base = Policy()
        return Policy(
            ignored_classes=frozenset((base.ignored_classes | self.ignored_classes) - self.checked_classes), ignored_words=frozenset(self.ignored_words),
            ignored_patterns=tuple(sorted(self.ignored_patterns)), min_length=base.min_length if self.minimum_length is None else self.minimum_length,
            join_single_letter=self.single_letter == "join", marker=marker,
        )
