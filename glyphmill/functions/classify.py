"""Token classes and identifier segments as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import ALPHABETIC, LOWERCASE, NUMERIC, UPPERCASE, other_character, run_character, word_character

#: The class names, in the order in which they are tried.
CLASSES = (
    "url", "email", "uuid", "hash", "path", "base64", "domain", "generated-token", "number",
    "identifier", "acronym", "natural-word", "unknown",
)


def boundary_pattern(join: bool = False) -> str:
    """Zero-width places between identifier segments within a run of word characters.

    With ``join`` a single capital at the start of a run stays with the segment after it.
    """
    word = word_character()
    alone = f"(?<!(?:^|{other_character()}){UPPERCASE})" if join else ""
    return (
        f"(?<={NUMERIC})(?={word})|(?<={word})(?={NUMERIC})"
        f"|(?<={LOWERCASE})(?={UPPERCASE})|{alone}(?<={UPPERCASE})(?={UPPERCASE}{LOWERCASE})"
    )


def segment_pattern(join: bool = False) -> str:
    """What stands between the segments of an identifier."""
    return f"{other_character()}+|{boundary_pattern(join)}"


def segments(token: Column, join: bool = False) -> Column:
    """The segments of an identifier: array of strings."""
    return F.filter(F.split(token, segment_pattern(join)), lambda s: s != "")


def located_segments(token: Column, join: bool = False) -> Column:
    """Array of struct<text, byte_start, segment_index>; places are relative to the token."""
    mark = "\u0001"
    run = run_character()
    edges = f"(?<={run})(?!{run}|$)|(?<!{run}|^)(?={run})|{boundary_pattern(join)}"
    pieces = F.split(F.regexp_replace(token, edges, mark), mark)
    # One fold over the pieces carries the place along.
    empty = F.array().cast("array<struct<text:string,byte_start:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        one = F.struct(piece.alias("text"), acc["at"].alias("byte_start"))
        out = F.when(piece.rlike(f"^{run}"), F.array_append(acc["out"], one)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.octet_length(piece)).cast("long").alias("at"), out.alias("out"))

    # A plain word, punctuation after it or not, is one segment.
    plain = f"^{UPPERCASE}?{LOWERCASE}+(?=[!-/:-@\\[-`{{-~]*$)"
    alone = F.array(F.struct(F.regexp_extract(token, plain, 0).alias("text"), F.lit(0).cast("long").alias("byte_start")))
    kept = F.when(token.rlike(plain), alone).otherwise(F.aggregate(pieces, start, step, lambda acc: acc["out"]))
    return F.transform(kept, lambda s, k: F.struct(s["text"].alias("text"), s["byte_start"].alias("byte_start"), k.cast("int").alias("segment_index")))


def is_number(segment: Column) -> Column:
    return segment.rlike(f"^{NUMERIC}*$")


def is_hash(token: Column) -> Column:
    """Seven or more hex digits, with 0x before or a decimal digit among them."""
    return token.rlike("^(?:0[xX][0-9A-Fa-f]{7,}|(?=.*[0-9])[0-9A-Fa-f]{7,})$")


def is_path(token: Column) -> Column:
    """A separator, a first part, and a later part that is not empty, . or .."""
    parts = F.split(F.translate(token, "\\", "/"), "/", -1)
    later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return (F.size(parts) > 1) & (F.element_at(parts, 1) != "") & F.exists(later, lambda p: ~p.isin("", ".", ".."))


def classify(token: Column) -> Column:
    """The class of a raw token; the first that applies."""
    label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    return (
        F.when(F.contains(token, F.lit("://")) | token.startswith("www."), "url")
        # Shortcuts for most tokens of prose, which no class in between can claim.
        .when(token.rlike(f"^{UPPERCASE}?{LOWERCASE}+$"), "natural-word")
        .when(token.rlike(rf"^{UPPERCASE}?{LOWERCASE}+\.+$"), "unknown")
        .when(token.rlike(r"^[^@]+@[^@]*\.[^@]*$"), "email")
        .when(token.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"), "uuid")
        .when(is_hash(token), "hash")
        .when(is_path(token), "path")
        .when(token.rlike("^(?=.*[+/=])[A-Za-z0-9+/=]{24,}$"), "base64")
        .when(token.rlike(rf"^{label}(?:\.{label})+$"), "domain")
        .when(token.rlike(r"^(?s)__.*__$") & (F.octet_length(token) > 4), "generated-token")
        .when(is_number(token), "number")
        .when(F.size(segments(token)) > 1, "identifier")
        .when(token.rlike(f"^(?:(?={ALPHABETIC}){UPPERCASE})+$"), "acronym")
        .when(token.rlike(f"^{word_character()}+$"), "natural-word")
        .otherwise("unknown")
    )


def segment_casing(word: Column, replacement: Column) -> Column:
    """The replacement in the casing of the segment: all upper, initial upper, lower, or as it is."""
    first, rest = F.substring(replacement, 1, 1), F.substr(replacement, F.lit(2))
    return (
        F.when(word.rlike(f"^{LOWERCASE}*$"), F.lower(replacement))
        .when(word.rlike(f"^{UPPERCASE}+$"), F.upper(replacement))
        .when(word.rlike(f"^{UPPERCASE}{LOWERCASE}+$"), F.concat(F.upper(first), F.lower(rest)))
        .otherwise(replacement)
    )


def whole_identifier(token: Column, segment_start: Column, word: Column, replacement: Column) -> Column:
    """The token with the segment at a relative byte place replaced, in the segment's casing."""
    head = F.decode(F.substring(F.encode(token, "UTF-8"), F.lit(1), segment_start.cast("int")), "UTF-8")
    tail = F.substr(token, F.length(head) + F.length(word) + 1)
    return F.concat(head, segment_casing(word, replacement), tail)
