"""The command line, saved dictionaries and SQL functions."""

import pytest
from pyspark.sql import functions as F

from glyphmill import __main__ as commands
from glyphmill.functions.classify import segments
from glyphmill.functions.register import register
from glyphmill.sources import artifacts
from glyphmill.sources.affixfiles import import_bytes
from glyphmill.sources.wordlists import overlay_text, write_overlay

AFF, DIC = "SFX S Y 1\nSFX S 0 s .\nCOMPOUNDFLAG C\nCOMPOUNDMIN 2\nBREAK 1\nBREAK -\n", "2\ncat/SC\ndog/C\n"


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "own.aff").write_text(AFF)
    (tmp_path / "own.dic").write_text(DIC)
    (tmp_path / "words.txt").write_text("alpha\nbeta\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("alpha = beta\n# glyphmill:ignore zeta\nzeta = gama\n")
    (tmp_path / "config").write_text("dictionary = words.txt\n")
    return tmp_path


def run(capsys, *arguments):
    status = commands.main([str(a) for a in arguments])
    out = capsys.readouterr()
    return status, out.out.strip().split("\n"), out.err


def test_check_and_explain(folder, capsys):
    assert run(capsys, "check", "--dictionary", folder / "words.txt", "--affix", folder / "own.aff", "alpha", "cats", "catdog")[0] == 0
    assert run(capsys, "check", "--dictionary", folder / "words.txt", "gama")[:2] == (1, ["unrecognized: gama"])
    status, lines, _ = run(capsys, "check", "--dictionary", folder / "words.txt", "--file", folder / "src/a.py")
    assert status == 1 and lines[-1].endswith(":3:8: misspelled: gama")
    status, lines, _ = run(capsys, "explain", "--affix", folder / "own.aff", "cats", "zz")
    assert status == 1 and lines == ["cats: accepted (exact), affix of cat", "zz: rejected, unknown"]


def test_suggest_and_analyze(folder, capsys):
    assert run(capsys, "suggest", "--dictionary", folder / "words.txt", "alpa")[1] == ["alpa: alpha"]
    status, lines, _ = run(capsys, "analyze", "--config", folder / "config", folder / "src")
    assert (status, lines) == (1, ["a.py:3: misspelled: gama"])


def test_compile_inspect_validate(folder, capsys):
    assert run(capsys, "compile", "--dictionary", folder / "words.txt", "--output", folder / "w.bin")[0] == 0
    assert "words: 2" in run(capsys, "inspect", folder / "w.bin")[1] and run(capsys, "validate", folder / "w.bin")[0] == 0
    assert run(capsys, "check", "--compiled", folder / "w.bin", "alpha")[0] == 0
    assert run(capsys, "compile", "--affix", folder / "own.aff", "--output", folder / "saved")[0] == 0
    assert "lexemes: 2" in run(capsys, "inspect", folder / "saved")[1] and run(capsys, "validate", folder / "own.aff")[0] == 0
    (folder / "bad.bin").write_bytes(b"nothing")
    status, _, error = run(capsys, "validate", folder / "bad.bin")
    assert status == 2 and "truncated header" in error
    assert run(capsys, "dictionaries")[0] == 0


def test_saved_dictionaries_load_as_they_were(spark, folder):
    own = import_bytes(AFF.encode(), DIC.encode())
    artifacts.save_dictionary(own, spark, str(folder / "d"), AFF.encode(), DIC.encode())
    assert artifacts.load_dictionary(spark, str(folder / "d")) == own
    own.rules[0] = own.rules[0].__class__(**{**vars(own.rules[0]), "rule_id": 7})
    assert artifacts.invariants(own) == ["rule numbers"]


def test_overlay_file(spark, tmp_path):
    words = spark.createDataFrame([("é",), ("b",), ("b",), ("Z",)], "word string")
    assert overlay_text(words) == "Z\nb\né\n"
    write_overlay(words, str(tmp_path / "words.txt"))
    assert (tmp_path / "words.txt").read_text() == "Z\nb\né\n"


def test_sql_functions(spark):
    register(spark, spark.createDataFrame([("don't",)], "word string"))
    rows = spark.sql("SELECT t.* FROM lex_tokens('é don''t x1') t WHERE NOT EXISTS (SELECT 1 FROM lex_words w WHERE w.word = t.word)").collect()
    assert [(r["word"], r["byte_start"]) for r in rows] == [("é", 0), ("x", 9)]
    assert spark.sql("SELECT lex_osa('recieve', 'receive', 2), lex_normalize('e\\u0301', 'nfc')").first()[:] == (1, "é")
    words = spark.createDataFrame([("don't",), ("x",), (None,), ("don't",)], "word string")
    words.createOrReplaceTempView("asked_words")
    assert [r[0] for r in spark.sql("SELECT lex_contains(word) FROM asked_words").collect()] == [True, False, False, True]
    known = spark.sql("SELECT word FROM asked_words WHERE lex_contains(word)")
    assert [r[0] for r in known.collect()] == ["don't"] * 2 and "LeftSemi" in known._jdf.queryExecution().toString()
    tokens = spark.createDataFrame([(t,) for t in ("HTTPResponseCode2x", "snake_case-9", "", "it's É1", "__", None)], "token string")
    tokens.createOrReplaceTempView("asked_tokens")
    got = spark.sql("SELECT token, lex_split_identifier(token) AS s FROM asked_tokens").collect()
    assert got == tokens.select("token", segments(F.col("token")).alias("s")).collect() and got[0]["s"] == ["HTTP", "Response", "Code", "2", "x"]
