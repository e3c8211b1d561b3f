"""Source trees: files by glob, comment syntax by extension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by comment syntax.
LINE_COMMENTS = {
    "//": ("rs", "c", "cc", "cpp", "h", "hpp", "java", "js", "jsx", "ts", "tsx", "go", "swift", "kt"),
    "#": ("py", "rb", "sh", "bash", "zsh", "yaml", "yml", "toml"),
    "--": ("sql", "lua", "hs"),
}
HTML_COMMENTS = ("md", "markdown", "html", "htm", "xml")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over a whole path.

    ``**/`` and ``**`` stand for any text, ``*`` for any without a slash, ``?`` for one character.
    """
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = [*out, r"[\s\S]*"], k + 3
        elif glob.startswith("**", k):
            out, k = [*out, r"[\s\S]*"], k + 2
        else:
            c = glob[k]
            out.append("[^/]*" if c == "*" else r"[\s\S]" if c == "?" else re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", c))
            k += 1
    return "^" + "".join(out) + "$"


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a relative path is included and neither it nor a folder above it is excluded."""
    into = F.lit(not include)
    for glob in include:
        into = into | path.rlike(glob_regex(glob))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    out = F.lit(False)
    for glob in exclude:
        out = out | F.exists(above, _matcher(glob))
    return into & ~out


def _matcher(glob: str):
    pattern = glob_regex(glob)
    return lambda p: p.rlike(pattern)


def comment_syntax(path: Column) -> Column:
    """'line:<prefix>', 'html' or 'none' by the extension."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    kind = F.when(extension.isin(*HTML_COMMENTS), "html")
    for prefix, extensions in LINE_COMMENTS.items():
        kind = kind.when(extension.isin(*extensions), f"line:{prefix}")
    return kind.otherwise("none")


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(doc_id, text, comment): the text files below a folder; doc_id is the relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    base = re.sub(r"^[a-z0-9]+:/*|/+$", "", root).lstrip("/")
    relative = F.regexp_replace("path", f"^[a-z0-9]+:/*{re.escape(base)}/*", "")
    kept = files.withColumn("doc_id", relative).where(selected(F.col("doc_id"), include or [], exclude or []))
    return kept.select("doc_id", F.decode("content", "UTF-8").alias("text"), comment_syntax(F.col("doc_id")).alias("comment"))
