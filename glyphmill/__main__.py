"""The command line: check, suggest, explain, analyze, compile, inspect, validate, dictionaries.

Exit status: 0 all recognized or done, 1 findings or rejected, 2 wrong use or a failed import.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import LexicalError, SuggestOptions
from .plans.engine import Engine, rendered_explanation, rendered_finding
from .sources import artifacts, catalog
from .sources.affixfiles import import_bytes, read_dictionary
from .sources.projectconfig import ProjectConfig
from .sources.trees import read_tree
from .sources.wordlists import parse_list, read_word_list, text_lines


def session() -> SparkSession:
    spark = SparkSession.builder.appName("glyphmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def engine(spark: SparkSession, given: argparse.Namespace) -> Engine:
    """Word lists first, then artifacts, then affix dictionaries."""
    lists = [read_word_list(spark, p) for p in given.dictionary] + [artifacts.read_artifacts(spark, p).select("word", "frequency") for p in given.compiled]
    return Engine(spark, lists, [read_dictionary(spark, p) for p in given.affix])


def check(spark: SparkSession, given: argparse.Namespace) -> int:
    own = engine(spark, given)
    if given.file:
        text = spark.read.text(given.file, wholetext=True).select(F.lit(given.file).alias("doc_id"), F.col("value").alias("text"))
        rows = own.check_text(text).orderBy("byte_start").select(rendered_finding(F.col("doc_id"), F.col("line"), F.col("column"), F.col("word"))).collect()
    else:
        words = spark.createDataFrame([(w,) for w in given.words], "word string")
        rows = own.check_words(words).where("not recognized").orderBy("word").select(F.concat(F.lit("unrecognized: "), "word")).collect()
    print(*(r[0] for r in rows), sep="\n")
    return int(bool(rows))


def suggest(spark: SparkSession, given: argparse.Namespace) -> int:
    options = SuggestOptions(max_results=given.results, max_distance=given.distance)
    found, state = engine(spark, given).suggest(spark.createDataFrame([(w,) for w in given.words], "word string"), options)
    for r in found.orderBy("query", "rank").collect():
        print(f"{r['query']}: {r['word']}")
    for r in state.where("completeness <> 'complete'").collect():
        print(f"{r['query']}: {r['completeness']}", file=sys.stderr)
    return 0


def explain(spark: SparkSession, given: argparse.Namespace) -> int:
    told = engine(spark, given).explain(spark.createDataFrame([(w,) for w in given.words], "word string"))
    rows = told.select("accepted", rendered_explanation().alias("line")).orderBy("line").collect()
    print(*(r["line"] for r in rows), sep="\n")
    return int(not all(r["accepted"] for r in rows))


def analyze(spark: SparkSession, given: argparse.Namespace) -> int:
    config = ProjectConfig.parse(Path(given.config).read_text()) if given.config else ProjectConfig()
    base = Path(given.config).parent if given.config else Path()
    given.dictionary += [str(base / p) for p in sorted(config.dictionaries)]
    given.compiled += [str(base / p) for p in sorted(config.artifacts)]
    given.affix += [str(base / p) for p in sorted(config.affix_dictionaries)]
    docs = read_tree(spark, given.path, sorted(config.include), sorted(config.exclude))
    if config.comment:
        docs = docs.withColumn("comment", F.lit(config.comment))
    findings, problems = engine(spark, given).analyze(docs, config.policy())
    rows = findings.select("doc_id", "line", "byte_start", "word").orderBy("doc_id", "byte_start").collect()
    for r in rows:
        print(f"{r['doc_id']}:{r['line']}: misspelled: {r['word']}")
    for r in problems.orderBy("doc_id", "line").collect():
        print(f"{r['doc_id']}:{r['line']}: {r['problem']}", file=sys.stderr)
    return int(bool(rows))


def compile_(spark: SparkSession, given: argparse.Namespace) -> int:
    if given.affix:
        aff = Path(given.affix[0])
        raw = aff.read_bytes(), aff.with_suffix(".dic").read_bytes()
        artifacts.save_dictionary(import_bytes(*raw), spark, given.output, *raw)
    else:
        text = spark.read.text(given.dictionary, wholetext=True)
        Path(given.output).write_bytes(artifacts.compile_words(parse_list(text_lines(text, "value"))))
    return 0


def inspect(spark: SparkSession, given: argparse.Namespace) -> int:
    found = artifacts.manifest_of(spark, given.path) if Path(given.path).is_dir() else artifacts.inspect(Path(given.path).read_bytes())
    print(*(f"{k}: {v}" for k, v in found.items() if not isinstance(v, dict)), sep="\n")
    return 0


def validate(spark: SparkSession, given: argparse.Namespace) -> int:
    if given.path.endswith(".aff"):
        found = read_dictionary(spark, given.path, strict=False).diagnostics
        print(*(f"{d.source}:{d.line}: {d.severity}: {d.directive}: {d.message}" for d in found), sep="\n")
        return int(any(d.severity == "error" for d in found))
    artifacts.validate(Path(given.path).read_bytes())
    return 0


def dictionaries(spark: SparkSession, given: argparse.Namespace) -> int:
    if given.install:
        aff, _ = catalog.install(given.install, catalog.LocalFetcher(Path(given.source)), Path(given.folder))
        print(f"ready: {aff}")
    else:
        catalog.catalog(spark).select("locale", "license").orderBy("locale").show(100, truncate=False)
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, *, sources: bool = True) -> argparse.ArgumentParser:
        out = commands.add_parser(name)
        out.set_defaults(run=run)
        if sources:
            for option in ("dictionary", "compiled", "affix"):
                out.add_argument(f"--{option}", action="append", default=[])
        return out

    for name, run in (("check", check), ("suggest", suggest), ("explain", explain)):
        command(name, run).add_argument("words", nargs="*")
    commands.choices["check"].add_argument("--file")
    commands.choices["suggest"].add_argument("--results", type=int, default=8)
    commands.choices["suggest"].add_argument("--distance", type=int, default=2)
    command("analyze", analyze).add_argument("path")
    commands.choices["analyze"].add_argument("--config")
    command("compile", compile_).add_argument("--output", required=True)
    for name, run in (("inspect", inspect), ("validate", validate)):
        command(name, run, sources=False).add_argument("path")
    own = command("dictionaries", dictionaries, sources=False)
    for option, value in (("--install", None), ("--source", "."), ("--folder", "dictionaries")):
        own.add_argument(option, default=value)
    given = parser.parse_args(arguments)
    try:
        return given.run(session(), given)
    except (LexicalError, OSError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
