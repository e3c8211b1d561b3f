"""Word lists, text, code analysis, suggestions, artifacts, configuration, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill import model
from glyphmill.functions.classify import classify, located_segments, segments
from glyphmill.functions.distance import deletions, osa, osa_distance
from glyphmill.functions.register import _WORD, register
from glyphmill.functions.text import SENTINELS, line_and_column, lines, raw_tokens, tokenize, tokenize_lines
from glyphmill.model import Policy, SuggestOptions
from glyphmill.operators.policy import analyze
from glyphmill.operators.suggest import suggest
from glyphmill.plans.engine import Checker, Engine, utf16_column
from glyphmill.sources import artifacts, catalog
from glyphmill.sources.affixfiles import import_bytes, import_text
from glyphmill.sources.projectconfig import ProjectConfig
from glyphmill.sources.trees import comment_syntax, glob_regex, read_tree, selected
from glyphmill.sources.wordlists import parse_frequency_list, parse_list, parse_word_list, read_word_list, text_lines, words_of


def one(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_word_lists(spark, tmp_path):
    rows = text_lines(docs(spark, "﻿b\n#x\n\n a \r\nb\n"), "text")
    assert sorted(r[0] for r in parse_word_list(rows).collect()) == ["a", "b"]
    (tmp_path / "w.txt").write_text("﻿zebra\n# no\ncafé\n")
    assert sorted(r[0] for r in read_word_list(spark, str(tmp_path / "w.txt"), "nfc").collect()) == ["café", "zebra"]
    with pytest.raises(model.WordListError) as error:
        words_of(spark, ["a", ""])
    assert error.value.position == 2


def test_frequency_lists(spark):
    rows = text_lines(docs(spark, "# c\na\t3\na\t9\nb\t18446744073709551615\n"), "text")
    assert {r[0]: int(r[1]) for r in parse_list(rows).collect()} == {"a": 9, "b": 2**64 - 1}
    for bad, line in (("a\t1\nb\tx", 2), ("a\t1\n\nb", 3), ("a\t18446744073709551616", 1), ("a\t1\tz", 1)):
        with pytest.raises(model.FrequencyListError) as error:
            parse_frequency_list(text_lines(docs(spark, bad), "text"))
        assert error.value.line == line


def test_tokens_and_ranges(spark):
    found = [(r["word"], r["byte_start"], r["byte_end"]) for r in tokenize(docs(spark, "Café, Strasse! don't l’esprit x' café")).orderBy("byte_start").collect()]
    assert found[:3] == [("Café", 0, 5), ("Strasse", 7, 14), ("don't", 16, 21)]
    assert [w for w, _, _ in found[3:]] == ["l’esprit", "x", "café"]
    marked = tokenize(docs(spark, "a\u0001b c\u0002d")).orderBy("byte_start").collect()
    assert [(r["word"], r["byte_start"]) for r in marked] == [("a", 0), ("b", 2), ("c", 4), ("d", 6)]


@pytest.mark.parametrize("letters", ["ab c", "aé c'𝔘\u0301\n", "abcdé \r\n-,("])
def test_places_are_summed_in_the_row(spark, letters):
    """No text is dealt out to number its tokens; long arrays, rows of one key and empty texts are placed alike."""
    rng = random.Random(11)
    texts = [None, "", "\n", "ab" * 30_000, *("".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 33, 64, 65, 700, 20_000, 90_000))]
    rows = spark.createDataFrame([(1, t) for t in texts], "doc_id bigint, text string")
    tokens, line_rows = tokenize(rows), lines(rows)
    for found in (tokens, line_rows, raw_tokens(line_rows)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((m[0], len(t[: m.start()].encode()), len(t[: m.end()].encode())) for t in texts if t for m in _WORD.finditer(t))
    assert sorted((r["word"], r["byte_start"], r["byte_end"]) for r in tokens.collect()) == want
    want = []
    for t in texts:
        at = 0
        for k, raw in enumerate(every := (t or "").split("\n"), 1):
            if k < len(every) or raw or len(every) == 1:
                want.append((k, raw.removesuffix("\r"), at))
            at += len(raw.encode()) + 1
    assert sorted((r["line"], r["text"], r["byte_start"]) for r in line_rows.collect()) == sorted(want)


def test_lines_and_columns_of_long_lines(spark):
    """Columns are summed with the bytes: no row carries its line's text, and any place of a long line is found."""
    rng = random.Random(12)
    texts = ["", "\r\n\n", "a\r\nbé é\n\n𝔘c d", *("".join(rng.choice(letters) for _ in range(30_000)) for letters in ("ab ", "aé𝔘 ", "aé \n"))]
    found = tokenize_lines(docs(spark, *texts))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for d, text in enumerate(texts):
        for m in _WORD.finditer(text):
            want.add((d, m[0], len(text[: m.start()].encode()), text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start())))
    columns = ["doc_id", "word", "byte_start", "line", "column"]
    assert {tuple(r) for r in found.select(*columns).collect()} == want
    places = line_and_column(tokenize(docs(spark, *texts)), lines(docs(spark, *texts)))
    plan = places._jdf.queryExecution().analyzed().toString()
    assert "struct<line:bigint,byte_start:bigint,text" not in plan
    assert {tuple(r) for r in places.select(*columns).collect()} == want


def test_only_tokens_that_matter_are_shuffled(spark):
    """The places of recognized tokens stay where they are; a document without a directive meets no window."""
    text = "let known = known;\n" * 400 + "// glyphmill:ignore tpyo\nlet tpyo = wrng;\n"
    rows = spark.createDataFrame([(1, text, "line://"), (2, text.replace("glyphmill", "other"), "line://")], "doc_id bigint, text string, comment string")
    findings, _ = analyze(rows, one(spark, "let", "known", "other", "ignore"))
    found = sorted((r["doc_id"], r["line"], r["word"]) for r in findings.collect())
    assert found == [(1, 402, "wrng"), (2, 401, "tpyo"), (2, 402, "tpyo"), (2, 402, "wrng")]
    analyzed = findings._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in analyzed.splitlines() if "Window [" in x]
    assert "_mark" in analyzed and len(windows) == 1  # the bits come before the join; the lines of marked documents only are ordered
    assert findings.where("token = 'known'").isEmpty()
    engine = Engine(spark, [one(spark, "let", "known")])
    assert {(r["word"], r["line"], r["column"]) for r in engine.check_text(rows.select("doc_id", "text").where("doc_id = 1")).collect()} == {("glyphmill", 401, 4), ("ignore", 401, 14), ("tpyo", 401, 21), ("tpyo", 402, 5), ("wrng", 402, 12)}


def test_tokens_of_a_text_with_all_sentinels(spark):
    text = "a".join(SENTINELS) + " b c"
    at = len(SENTINELS[0].encode())
    rows = tokenize(docs(spark, "x" + text)).orderBy("byte_start").collect()
    assert [r["word"] for r in rows] == ["x", *"a" * (len(SENTINELS) - 1), "b", "c"] and rows[1]["byte_start"] == 1 + at


def test_sql_tokens_equal_the_native_plan(spark):
    register(spark)
    texts = ["Café don't l’esprit x' ''y", "हिन्दी की किताब", "Ⅷ ⅷ a1b", "e\u0301a \u0301b", "", "漢字 かな 𝔘n"]
    want = [(r["word"], r["byte_start"], r["byte_end"]) for r in tokenize(docs(spark, *texts)).orderBy("doc_id", "byte_start").collect()]
    docs(spark, *texts).createOrReplaceTempView("token_texts")
    got = spark.sql("SELECT doc_id, t.* FROM token_texts, LATERAL lex_tokens(text) t ORDER BY doc_id, byte_start").collect()
    assert [(r["word"], r["byte_start"], r["byte_end"]) for r in got] == want


def test_lines_and_raw_tokens(spark):
    rows = lines(docs(spark, "a\r\nbé\n\nc", "", "x\n")).orderBy("doc_id", "line").collect()
    assert [(r["doc_id"], r["line"], r["text"], r["byte_start"], r["byte_end"]) for r in rows] == [
        (0, 1, "a", 0, 1), (0, 2, "bé", 3, 6), (0, 3, "", 7, 7), (0, 4, "c", 8, 9), (1, 1, "", 0, 0), (2, 1, "x", 0, 1),
    ]
    tokens = raw_tokens(lines(docs(spark, "(foo), 'é.b' -- !!\n x;"))).orderBy("byte_start").collect()
    assert [(r["token"], r["byte_start"], r["byte_end"]) for r in tokens] == [("foo", 1, 4), ("é.b", 8, 12), ("--", 14, 16), ("x", 21, 22)]


CLASSES = {
    "https://a.b": "url", "www.x": "url", "a@b.c": "email", "123e4567-e89b-12d3-a456-426614174000": "uuid", "deadbee1": "hash", "0xDEADBEE": "hash", "deadbeef": "natural-word",
    "src/main.rs": "path", "a\\b": "path", "a/.": "unknown", "QUJDREVGR0hJSktMTU5PUFFSU1RVVg==": "base64", "example.org": "domain", "1.81": "domain", "end.": "unknown", "__init__": "generated-token",
    "42": "number", "fooBar": "identifier", "HTTPServer": "identifier", "a1": "identifier", "NASA": "acronym", "word": "natural-word", "café": "natural-word", "--": "unknown", "www.": "url",
}


def test_classes(spark):
    rows = one(spark, *CLASSES).select("word", classify(F.col("word")).alias("class")).collect()
    assert {r["word"]: r["class"] for r in rows} == CLASSES


def test_segments(spark):
    want = {"OAuthAuthenticationProvider": "O Auth Authentication Provider", "HTTPResponseCode": "HTTP Response Code", "version2Parser": "version 2 Parser", "é_aB": "é a B"}
    joined = want | {"OAuthAuthenticationProvider": "OAuth Authentication Provider"}
    for expected, join in ((want, False), (joined, True)):
        rows = one(spark, *want).select("word", segments(F.col("word"), join).alias("s"), located_segments(F.col("word"), join).alias("l")).collect()
        for r in rows:
            assert " ".join(r["s"]) == expected[r["word"]] == " ".join(x["text"] for x in r["l"])
            raw = r["word"].encode()
            assert all(raw[x["byte_start"] :].startswith(x["text"].encode()) for x in r["l"])


def test_analysis_with_directives(spark):
    source = "let userAuthentcationProvider = build();\n// glyphmill:ignore tpyo\nlet tpyo = wrng;\n// glyphmill:disable\nnope\n// glyphmill:enable\nfoobar // glyphmill:ignore\n// glyphmill:ignore"
    rows = spark.createDataFrame([(1, source, "line://")], "doc_id bigint, text string, comment string")
    known = one(spark, "let", "user", "Provider", "build", "glyphmill", "ignore")
    findings, problems = analyze(rows, known, Policy(ignored_patterns=("foo|foobar",)))
    found = findings.orderBy("byte_start").collect()
    assert [(r["line"], r["word"], r["token"], r["class"], r["segment_index"]) for r in found] == [(1, "Authentcation", "userAuthentcationProvider", "identifier", 1), (3, "wrng", "wrng", "natural-word", None)]
    assert source.encode()[found[0]["byte_start"] : found[0]["byte_end"]] == b"Authentcation"
    assert [(r["line"], r["problem"]) for r in problems.collect()] == [(8, "missing-ignored-words")]


def test_osa():
    assert osa("recieve", "receive", 2) == 1 and osa("ca", "abc", 3) == 3 and osa("abc", "xyz", 2) is None and osa("", "ab", 2) == 2


def test_distance_and_neighbourhoods(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(60)})
    left, right = one(spark, *words).withColumnRenamed("word", "a"), one(spark, *words).withColumnRenamed("word", "b")
    found = {(r["a"], r["b"]): r["d"] for r in left.crossJoin(right).select("a", "b", osa_distance(F.col("a"), F.col("b"), 2).alias("d")).collect()}
    assert found == {(a, b): osa(a, b, 2) for a in words for b in words}
    share = left.select("a", F.explode(deletions(F.col("a"), 2)).alias("k")).join(right.select("b", F.explode(deletions(F.col("b"), 2)).alias("k")), "k").select("a", "b").distinct()
    pairs = {(r[0], r[1]) for r in share.collect()}
    assert all(p in pairs for p, d in found.items() if d is not None)


def brute_suggest(query, words, options):
    """The walk in order, one candidate after another."""
    found, cells, state = [], 0, "complete"
    for examined, word in enumerate(sorted(words, key=str.encode)):
        if examined == options.max_candidates:
            state = "candidate limit reached"
            break
        if abs(len(query) - len(word)) > options.max_distance:
            continue
        need = (len(query) + 1) * (len(word) + 1)
        if cells + need > options.max_cells:
            state = "edit-distance budget reached"
            break
        cells += need
        if (d := osa(query, word, options.max_distance)) is not None:
            found.append((d, word))
    return [w for _, w in sorted(found)][: options.max_results], state


@pytest.mark.parametrize("options", [SuggestOptions(), SuggestOptions(max_distance=1, max_cells=900), SuggestOptions(max_candidates=70), SuggestOptions(max_results=2, max_cells=3000)])
def test_suggestions_stop_where_a_walk_would(spark, options):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(200)})
    queries = [*words[:3], "abca", "dd", "aabbccdd", "x"]
    found, state = suggest(one(spark, *queries), one(spark, *words), options)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["word"])
    states = dict(state.collect())
    for q in queries:
        want, ended = brute_suggest(q, words, options)
        assert (got.get(q, []), states[q]) == (want, ended)


def test_suggestion_signals_and_casing(spark):
    known = spark.createDataFrame([("cut", 100), ("cat", 1), ("car", None), ("the", None), ("tea", None)], "word string, frequency bigint")
    found, state = suggest(one(spark, "cot", "Teh", "COT", "x" * 65), known, replacements=[("teh", "the", True, True)])
    top = {r["query"]: r["word"] for r in found.where("rank = 1").collect()}
    assert top == {"cot": "cut", "Teh": "The", "COT": "CUT"}
    assert dict(state.collect())["x" * 65] == "query exceeds the scalar limit"


def test_affix_suggestions(spark):
    dictionary = import_text("NOSUGGEST S\nSFX N Y 1\nSFX N 0 n .\nCOMPOUNDFLAG C\nCOMPOUNDMIN 3\nOCONV 1\nOCONV q k", "5\nHäuser/N\nBahn/C\nHof/C\nprivat/S\nquark")
    engine = Engine(spark, affixes=[dictionary])
    found, _ = engine.suggest(one(spark, "Häusernn", "BahnHoff", "privaat", "quarj"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], set()).add(r["word"])
    assert "Häusern" in got["Häusernn"] and "BahnHof" in got["BahnHoff"] and "privat" not in got.get("privaat", set()) and "kuark" in got["quarj"]


def test_layers_and_checker(spark):
    engine = Engine(spark, [one(spark, "alpha")], [import_text("SFX S Y 1\nSFX S 0 s .", "1\nbeta/S")])
    assert dict(engine.check_words(one(spark, "alpha", "betas", "gamma")).collect()) == {"alpha": True, "betas": True, "gamma": False}
    wrong = engine.check_text(docs(spark, "alpha\nbetas é gama")).collect()
    assert [(r["word"], r["line"], r["column"]) for r in sorted(wrong, key=lambda r: r["byte_start"])] == [("é", 2, 7), ("gama", 2, 9)]
    checker = Checker(spark, ["receive", "relieve"])
    assert checker.check("receive", "recieve") == {"receive": True, "recieve": False} and checker.suggest("recieve") == ["receive", "relieve"]


def test_import_diagnostics():
    out = import_text("NOPE x\nTRY abc\nSFX A Y 1\nSFX A 0 s [\nFORBIDDENWORD", "2\nok\n/x", strict=False)
    assert [(d.directive, d.severity) for d in out.diagnostics] == [("NOPE", "error"), ("TRY", "warning"), ("SFX", "error"), ("FORBIDDENWORD", "error"), ("entry", "error")] or len(out.diagnostics) >= 4
    with pytest.raises(model.ImportFailed):
        import_text("NOPE x", "1\na")


@pytest.mark.parametrize(
    ("aff", "said"),
    [
        ("REP 2\n# c\nREP a b\nREP c d", [(2, "REP", "warning"), (4, "REP", "warning")]), ("MAP 2\n\nMAP ab\n", [(2, "MAP", "warning")]), ("BREAK 2\n# c\nBREAK -", [(2, "BREAK", "error")]),
        ("COMPOUNDRULE 2\n#\nCOMPOUNDRULE AB", [(2, "COMPOUNDRULE", "error")]), ("COMPOUNDRULE 0", [(1, "COMPOUNDRULE", "error")]), ("CHECKCOMPOUNDPATTERN 2\n\nCHECKCOMPOUNDPATTERN a b", [(2, "CHECKCOMPOUNDPATTERN", "error")]),
        ("ICONV 1\n# c\n\nICONV a b", []), ("AF 2\nAF AB\n# c\nAF", []), ("ICONV 1\nICONV a b\nICONV 0", [(3, "ICONV", "error")]), ("OCONV 0\nOCONV 0", [(2, "OCONV", "error")]), ("AF 0\nAF 0", [(2, "AF", "error")]),
        ("AM 0\nAM 0", [(2, "AM", "warning")]), ("REP 0\nREP 0", [(2, "REP", "warning")]), ("MAP 0\nMAP 0", [(2, "MAP", "warning")]), ("REP 2\nREP a b", [(1, "REP", "warning")]),
        ("CHECKCOMPOUNDPATTERN 1\nCHECKCOMPOUNDPATTERN a b\nCHECKCOMPOUNDPATTERN 1", [(3, "CHECKCOMPOUNDPATTERN", "error")]), ("BREAK 1\nBREAK -\nBREAK 1\nBREAK x", []), ("REP 1\nSFX A Y 0", [(2, "REP", "warning")]),
    ],
)
def test_counted_blocks(aff, said):
    out = import_text(aff, "1\nok", strict=False)
    assert [(d.line, d.directive, d.severity) for d in out.diagnostics] == said
    if aff.startswith("BREAK 1"):
        assert [b[0] for b in out.breaks] == ["-", "x"]
    if aff.startswith("REP 2\n#"):
        assert [r[:2] for r in out.replacements] == [("a", "b")]


def test_import_encodings():
    assert import_bytes("SET ISO8859-2\n".encode(), "1\nžába".encode("iso-8859-2")).lexemes[0].stem == "žába"
    assert import_bytes(b"SET UTF-8\n", "2\nok\nž\n".encode() + "č".encode("iso-8859-2"), encodings=("utf-8", "utf-8+iso-8859-2")).lexemes[-1].stem == "ž"
    with pytest.raises(model.ImportFailed):
        import_bytes(b"SET UTF-8\n", b"1\n\xff")
    with pytest.raises(model.ImportFailed):
        import_bytes(b"SET KOI8-R\n", b"1\na")


def test_artifacts(spark, tmp_path):
    raw = artifacts.encode(["pear", "apple", "étude", "apple"], {"pear": 3, "apple": 0})
    assert raw == artifacts.encode(["étude", "apple", "pear"], {"pear": 3}) and raw[:8] == b"FLEXDIC\0"
    artifacts.validate(raw)
    assert list(artifacts.decode(raw)) == [("apple", None), ("pear", 3), ("étude", None)]
    assert list(artifacts.decode(artifacts.encode([]))) == []
    for broken, reason in ((raw[:40], "truncated header"), (b"X" + raw[1:], "magic"), (raw[:-1], "file length"), (raw[:70] + b"\1" + raw[71:], "checksum")):
        with pytest.raises(model.ArtifactError) as error:
            artifacts.inspect(broken)
        assert error.value.reason == reason
    (tmp_path / "a.dic").write_bytes(raw)
    rows = artifacts.read_artifacts(spark, str(tmp_path / "a.dic")).collect()
    assert [(r["word"], r["frequency"]) for r in rows] == [("apple", None), ("pear", 3), ("étude", None)]
    spark.dataSource.register(artifacts.ArtifactSource)
    assert spark.read.format("word-artifact").load(str(tmp_path / "a.dic")).count() == 3
    sniffed = artifacts.sniff(spark.read.format("binaryFile").load(str(tmp_path / "a.dic"))).first()
    assert sniffed["kind"] == "words"


def test_saved_dictionary(spark, tmp_path):
    aff, dic = b"SFX S Y 1\nSFX S 0 s .\n", b"1\ncat/S"
    artifacts.save_dictionary(import_bytes(aff, dic), spark, str(tmp_path / "d"), aff, dic)
    assert artifacts.check_dictionary(spark, str(tmp_path / "d"), aff, dic)["lexemes"] == 1
    with pytest.raises(model.ArtifactError):
        artifacts.check_dictionary(spark, str(tmp_path / "d"), aff, dic + b"x")


def test_catalogue_and_install(spark, tmp_path):
    assert catalog.catalog(spark).count() == 18 and catalog.find_locale("xx") is None
    assert catalog.problems("../x", "a/b", "http://x", "12", " ") == ["locale", "file name", "address", "digest", "license"]
    import hashlib

    digest = hashlib.sha256(b"data").hexdigest()
    assert catalog.install_file(tmp_path / "en" / "f", b"data", digest) and not catalog.install_file(tmp_path / "en" / "f", b"data", digest)
    with pytest.raises(catalog.InstallError):
        catalog.install_file(tmp_path / "en" / "f", b"other", hashlib.sha256(b"other").hexdigest())
    with pytest.raises(catalog.InstallError):
        catalog.install_file(tmp_path / "g", b"data", "0" * 64)


def test_project_configuration():
    text = "ignore-word = b\nignore-word = a\nignore-pattern = x+\nminimum-word-length = 3\nsingle-letter-prefix = join\ninclude = src/**\ncheck-class = hash\ndictionary = d.txt\ncomment-syntax = line:#\n"
    config = ProjectConfig.parse("# note\n" + text)
    assert config.text().splitlines()[:2] == ["ignore-word = a", "ignore-word = b"] and ProjectConfig.parse(config.text()) == config
    policy = config.policy()
    assert "hash" not in policy.ignored_classes and policy.min_length == 3 and policy.join_single_letter
    for bad in ("x", "k = v", "ignore-word =", "ignore-class = nope", "minimum-word-length = -1", "comment-syntax = line:", "single-letter-prefix = no"):
        with pytest.raises(model.ConfigError) as error:
            ProjectConfig.parse("\n" + bad)
        assert error.value.line == 2


def test_trees(spark, tmp_path):
    cases = {("src/*.rs", "src/a.rs"): True, ("src/*.rs", "src/b/a.rs"): False, ("**/x.rs", "yx.rs"): True, ("a?c", "abc"): True, ("a?c", "ac"): False, ("src/**", "src/a/b"): True}
    import re

    assert {k: bool(re.search(glob_regex(k[0]), k[1])) for k in cases} == cases
    (tmp_path / "src/skip").mkdir(parents=True)
    for name in ("src/a.py", "src/skip/b.py", "c.md", "d.bin"):
        (tmp_path / name).write_text("x")
    rows = read_tree(spark, str(tmp_path), include=["**/*.py", "*.md"], exclude=["src/skip"]).collect()
    assert {r["doc_id"]: r["comment"] for r in rows} == {"src/a.py": "line:#", "c.md": "html"}
    assert one(spark, "a.rs").select(comment_syntax(F.col("word"))).first()[0] == "line://"
    assert one(spark, "a/b").select(selected(F.col("word"), [], ["a"])).first()[0] is False


def test_utf16(spark):
    assert one(spark, "a𝔘b").select(utf16_column(F.col("word"), F.lit(2))).first()[0] == 3


def test_queries_agree_with_their_sql(spark):
    """Every registered query of the engine, at the smallest scale."""
    import duckdb

    from glyphmill.plans.catalogue import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "pages", "events", "part", "nation"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    for name, query in QUERIES.items():
        got = query(spark, sf)
        if name in ORACLE:
            want = db.execute(ORACLE[name])
            columns = sorted(d[0] for d in want.description)
            at = [next(k for k, d in enumerate(want.description) if d[0] == c) for c in columns]
            rows = sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
            assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows, name
        else:
            assert got.count() > 0, name
