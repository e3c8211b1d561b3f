"""Character classes as Java regular expressions, normalization and case rules."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABETIC = r"\p{IsAlphabetic}"
NUMERIC = r"\p{N}"
UPPERCASE = r"\p{IsUppercase}"
LOWERCASE = r"\p{IsLowercase}"
WHITE_SPACE = r"\p{IsWhite_Space}"
#: Languages whose dotted and dotless i are different letters.
TURKIC = frozenset({"az", "crh", "tr"})


@lru_cache(maxsize=1)
def combining() -> str:
    """The members of a class: characters whose canonical combining class is not zero.

    Narrower than ``\\p{M}``, so it is generated from the character database.
    """
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    runs: list[list[int]] = []
    for c in marks:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


@lru_cache(maxsize=1)
def mark() -> str:
    """One combining mark. The long class is tried on marks only."""
    return f"(?=\\p{{M}})[{combining()}]"


@lru_cache(maxsize=1)
def word_character() -> str:
    """One letter or combining mark."""
    return f"(?:{ALPHABETIC}|{mark()})"


@lru_cache(maxsize=1)
def run_character() -> str:
    """One letter, combining mark or number."""
    return f"(?:{ALPHABETIC}|{NUMERIC}|{mark()})"


@lru_cache(maxsize=1)
def other_character() -> str:
    """One character that is none of these."""
    return f"(?:(?!{run_character()})[\\s\\S])"


FORMS = {"exact": None, "nfc": "NFC", "nfkc": "NFKC"}


def normalize(word: Column, form: str = "nfc") -> Column:
    """Unicode normalization; ASCII words are left to the JVM side as they are."""
    name = FORMS[form]
    if name is None:
        return word

    @F.arrow_udf("string")
    def normalized(words: pa.Array) -> pa.Array:
        return pa.array((None if (w := x.as_py()) is None else unicodedata.normalize(name, w) for x in words), pa.string())

    return F.when(F.octet_length(word) == F.length(word), word).otherwise(normalized(word))


def trim_white_space(text: Column) -> Column:
    """Trim Unicode white space at both ends (the built-in trims U+0020 only)."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def lower(word: Column, turkic: bool = False) -> Column:
    """Lower case of every character by itself: no final-sigma rule."""
    if turkic:
        word = F.translate(F.regexp_replace(word, "İ", "i"), "I", "ı")
    # A capital sigma is the only character whose lower case depends on its place.
    return F.lower(F.translate(word, "Σ", "σ"))


def upper(word: Column, turkic: bool = False) -> Column:
    """Upper case, ß as SS."""
    return F.upper(F.translate(word, "iı", "İI") if turkic else word)


def initial(word: Column, turkic: bool = False) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(upper(F.substring(word, 1, 1), turkic), lower(F.substr(word, F.lit(2)), turkic))


def case_pattern(word: Column) -> Column:
    """'upper', 'initial' or null, by the cased characters alone.

    Upper: all are upper case, one letter by itself included. Initial: one or more
    upper-case letters, then lower-case ones only.
    """
    cased = F.regexp_replace(word, f"[^{UPPERCASE}{LOWERCASE}]", "")
    return F.when(cased.rlike(f"^{UPPERCASE}+$"), "upper").when(cased.rlike(f"^{UPPERCASE}+{LOWERCASE}+$"), "initial")
