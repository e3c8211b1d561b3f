"""The registered queries of the lexical engine and their SQL counterparts.

Dictionary H is a corpus's own: the prose words that ``documents`` has five times
or more. Both sides derive it from the table, so no outside dictionary is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import classify, segments, whole_identifier
from ..functions.text import lines, raw_words, tokenize, tokenize_lines, words
from ..functions.unicode import normalize
from ..model import SuggestOptions
from ..operators.forms import flag_origins, form_table
from ..operators.membership import among, misspellings, recognized, union_of, unrecognized
from ..operators.policy import active_lines, analyze, directives
from ..operators.recognize import Recognizer, normalize_input
from ..operators.suggest import suggest
from ..sources import artifacts, catalog
from ..sources.affixfiles import AffixDictionary, import_text
from ..sources.trees import glob_regex
from ..sources.wordlists import derived_list, overlay, parse_frequency_list, parse_word_list, text_lines
from ..streaming.live import check_stream
from ..tables import settle, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary H: (word, frequency)."""
    return derived_list(table(spark, sf_dir, "documents"))


# SQL fragments. RE2 knows no "Alphabetic" property; letters and marks agree with it on these tables.
WORD_RE = r"\p{L}[\p{L}\p{M}]*(?:[''’]\p{L}[\p{L}\p{M}]*)*"


def sql_words(column: str) -> str:
    return f"unnest(regexp_extract_all({column}, '{WORD_RE}'))"


SQL_H = f"h AS (SELECT word, count(*) AS frequency FROM (SELECT {sql_words('text')} AS word FROM documents) GROUP BY word HAVING count(*) >= 5)"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def q_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_TOKENIZE = f"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '({WORD_RE})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
e AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS word FROM p),
r AS (SELECT doc_id, i, word, sum(strlen(word)) OVER (PARTITION BY doc_id ORDER BY i) AS byte_end FROM e)
SELECT doc_id, word, (byte_end - strlen(word))::BIGINT AS byte_start, byte_end::BIGINT AS byte_end FROM r WHERE i % 2 = 0
"""


def q_word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_list(table(spark, sf_dir, "documents"), min_count=1)


SQL_WORD_FREQUENCY = f"SELECT word, count(*) AS frequency FROM (SELECT {sql_words('text')} AS word FROM documents) GROUP BY word"


def q_check_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(words(F.col("text"))).alias("word"))
    return misspellings(tokens, h(spark, sf_dir)).groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("n"))


SQL_CHECK_TEXT = f"""
WITH {SQL_H}, t AS (SELECT conv_id, turn, {sql_words('text')} AS word FROM conversations)
SELECT conv_id, turn, word, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.word = t.word) GROUP BY conv_id, turn, word
"""


def q_misspelling_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("lang", F.explode(words(F.col("text"))).alias("word"))
    counted = tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))  # distinct words before the join
    known = h(spark, sf_dir).select("word", F.lit(True).alias("_known"))
    return counted.join(known, "word", "left").groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)).alias("unrecognized"))


SQL_RATE = f"""
WITH {SQL_H}, t AS (SELECT lang, {sql_words('text')} AS word FROM documents)
SELECT lang, count(*)::BIGINT AS tokens, count(*) FILTER (h.word IS NULL)::BIGINT AS unrecognized FROM t LEFT JOIN h ON h.word = t.word GROUP BY lang
"""

LIST_TEXTS = [(1, "﻿zebra\n# note\n\n  apple \nzebra\n pear　\n#x\nÉtude\n"), (2, "apple\r\nfig\r\n")]


def q_wordlist_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_word_list(text_lines(values(spark, LIST_TEXTS, "id int, text string"), "text"))


SQL_WORDLIST = f"""
WITH l AS (SELECT unnest(string_split(regexp_replace(replace(text, chr(13), ''), '^' || chr(65279), ''), chr(10))) AS raw FROM {sql_values(LIST_TEXTS)} AS v(id, text)),
t AS (SELECT trim(raw, ' ' || chr(9) || chr(160) || chr(12288)) AS word FROM l)
SELECT DISTINCT word FROM t WHERE word <> '' AND NOT starts_with(word, '#')
"""

COUNT_TEXTS = [(1, "# counts\ncat\t3\ndog\t7\ncat\t9\n\nbird\t0\n")]


def q_frequency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_frequency_list(text_lines(values(spark, COUNT_TEXTS, "id int, text string"), "text"))
    return parsed.select("word", F.col("frequency").cast("long").alias("frequency"), (F.nullif("frequency", F.lit(0)).isNull()).alias("unranked"))


SQL_FREQUENCY = f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS raw FROM {sql_values(COUNT_TEXTS)} AS v(id, text))
SELECT split_part(raw, chr(9), 1) AS word, max(split_part(raw, chr(9), 2)::BIGINT) AS frequency, max(split_part(raw, chr(9), 2)::BIGINT) = 0 AS unranked FROM l WHERE raw <> '' AND NOT starts_with(raw, '#') GROUP BY 1
"""


def q_checker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(words(F.col("p_name"))).alias("word"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word")).union(names)
    return recognized(asked, union_of([h(spark, sf_dir), names]))


SQL_UNION = f"""
WITH {SQL_H}, names AS (SELECT {sql_words('p_name')} AS word FROM part), s AS (SELECT word FROM h UNION SELECT word FROM names),
asked AS (SELECT {sql_words('text')} AS word FROM benchmark UNION SELECT word FROM names)
SELECT asked.word, s.word IS NOT NULL AS recognized FROM asked LEFT JOIN s ON s.word = asked.word
"""

OPERATIONS = [(1, "insert", "alpha"), (2, "insert", "beta"), (3, "remove", "alpha"), (4, "insert", "gamma"), (5, "remove", "delta"), (6, "insert", "alpha"), (7, "remove", "beta")]


def q_overlay_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay(values(spark, OPERATIONS, "version int, op string, word string"))


SQL_OVERLAY = f"SELECT word FROM {sql_values(OPERATIONS)} AS v(version, op, word) GROUP BY word HAVING arg_max(op, version) = 'insert'"

MARKED = [("café",), ("café",), ("plain",), ("Ångström",), ("ẛ̣",)]


def q_normalize_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, MARKED, "word string").select("word", normalize(F.col("word"), "nfc").alias("normalized"))


SQL_NFC = f"SELECT word, nfc_normalize(word) AS normalized FROM {sql_values(MARKED)} AS v(word)"


def _code_tokens(docs: DataFrame) -> DataFrame:
    return raw_words(lines(docs))


def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _code_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("class", classify(F.col("token"))).groupBy("class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct_tokens"))


_ENDS = r"[!\"#$%&''()*,;<>?\[\\\]^`{|}~]+"
SQL_TOKENS = (
    "raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS w FROM documents), "
    f"tok AS (SELECT doc_id, regexp_replace(regexp_replace(w, '^{_ENDS}', ''), '{_ENDS}$', '') AS token FROM raw)"
)
SQL_CLASS = r"""CASE
  WHEN contains(token, '://') OR starts_with(token, 'www.') THEN 'url'
  WHEN regexp_matches(token, '^[^@]+@[^@]*\.[^@]*$') THEN 'email'
  WHEN regexp_matches(token, '^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$') THEN 'uuid'
  WHEN regexp_matches(token, '^0[xX][0-9A-Fa-f]{7,}$') OR (regexp_matches(token, '^[0-9A-Fa-f]{7,}$') AND regexp_matches(token, '[0-9]')) THEN 'hash'
  WHEN len(string_split(replace(token, chr(92), '/'), '/')) > 1 AND string_split(replace(token, chr(92), '/'), '/')[1] <> ''
       AND len(list_filter(string_split(replace(token, chr(92), '/'), '/')[2:], lambda p: p NOT IN ('', '.', '..'))) > 0 THEN 'path'
  WHEN regexp_matches(token, '^[A-Za-z0-9+/=]{24,}$') AND regexp_matches(token, '[+/=]') THEN 'base64'
  WHEN regexp_matches(token, '^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$') THEN 'domain'
  WHEN regexp_matches(token, '^__.*__$') AND strlen(token) > 4 THEN 'generated-token'
  WHEN regexp_matches(token, '^\p{N}*$') THEN 'number'
  WHEN regexp_matches(token, '[\p{L}\p{M}\p{N}][^\p{L}\p{M}\p{N}]+[\p{L}\p{M}\p{N}]') OR regexp_matches(token, '\p{N}[\p{L}\p{M}]|[\p{L}\p{M}]\p{N}|\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}') THEN 'identifier'
  WHEN regexp_matches(token, '^\p{Lu}+$') THEN 'acronym'
  WHEN regexp_matches(token, '^[\p{L}\p{M}]+$') THEN 'natural-word'
  ELSE 'unknown' END"""
SQL_CLASSIFY = f"""
WITH {SQL_TOKENS}, c AS (SELECT token, count(*) AS n FROM tok WHERE token <> '' GROUP BY token)
SELECT {SQL_CLASS} AS class, sum(n)::BIGINT AS tokens, count(*)::BIGINT AS distinct_tokens FROM c GROUP BY 1
"""

IDENTIFIERS = [("userAuthProvider2HTTPResponse",), ("OAuthAuthenticationProvider",), ("HTTPResponseCode",), ("version2Parser",), ("snake_case_name",), ("X",), ("aB",), ("__init__",), ("42",), ("kebab-case9",)]


def q_split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("token")).distinct()
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("token")).distinct()
    return values(spark, IDENTIFIERS, "token string").union(events).union(urls).select("token", F.array_join(segments(F.col("token")), "|").alias("segments"))


#: Segment boundaries as marks, for a dialect without lookaround.
SQL_MARKED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '[^\p{L}\p{M}\p{N}]+', '|', 'g'), '(\p{N})([\p{L}\p{M}])', '\1|\2', 'g'), '([\p{L}\p{M}])(\p{N})', '\1|\2', 'g'), '(\p{Ll})(\p{Lu})', '\1|\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1|\2', 'g')"
SQL_SPLIT = f"""
WITH t AS (SELECT token FROM {sql_values(IDENTIFIERS)} AS v(token) UNION ALL SELECT DISTINCT event_type FROM events UNION ALL SELECT DISTINCT url FROM pages)
SELECT token, array_to_string(list_filter(string_split({SQL_MARKED}, '|'), lambda s: s <> ''), '|') AS segments FROM t
"""


def q_analyze_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("none").alias("comment"))
    findings, _ = analyze(docs, h(spark, sf_dir))
    return findings.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("word").alias("distinct_words"))


SQL_ANALYZE = f"""
WITH {SQL_H}, {SQL_TOKENS}, c AS (SELECT doc_id, token, {SQL_CLASS} AS class FROM tok WHERE token <> ''),
s AS (SELECT doc_id, class, unnest(list_filter(string_split({SQL_MARKED}, '|'), lambda x: x <> '')) AS word FROM c
      WHERE class NOT IN ('url', 'email', 'number', 'hash', 'path', 'base64', 'uuid', 'domain', 'generated-token'))
SELECT doc_id, class, count(*) AS findings, count(DISTINCT word) AS distinct_words FROM s
WHERE length(word) >= 2 AND NOT regexp_matches(word, '^\\p{{N}}*$') AND NOT EXISTS (SELECT 1 FROM h WHERE h.word = s.word) GROUP BY doc_id, class
"""

SOURCES = [
    (1, "let a = 1;\n// glyphmill:ignore tpyo wrod\nlet tpyo = 2;\n// glyphmill:disable\nlet wrnog = 3;\n// glyphmill:enable\nlet b = 4;\n// glyphmill:ignore\n// glyphmill:what\n", "line://"),
    (2, "<!-- glyphmill:disable -->\ntext\n<!-- glyphmill:enable now -->\nmore\n", "html"),
    (3, "# glyphmill:disable\nx\n", "none"),
]


def q_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = values(spark, SOURCES, "doc_id int, text string, comment string")
    line_rows = lines(docs, by=("doc_id", "comment"))
    found = directives(line_rows)
    active = active_lines(line_rows).select("doc_id", "line")
    kinds = found.select("doc_id", "line", F.coalesce("problem", "kind").alias("kind"))
    return kinds.union(active.select("doc_id", "line", F.lit("active")))


SQL_DIRECTIVES = f"""
WITH v AS (SELECT * FROM {sql_values(SOURCES)} AS v(doc_id, text, comment)),
a AS (SELECT doc_id, comment, string_split(text, chr(10)) AS a FROM v),
l AS (SELECT doc_id, comment, generate_subscripts(a, 1) AS line, unnest(a) AS t, len(a) AS n FROM a),
m AS (SELECT *, CASE WHEN starts_with(comment, 'line:') AND starts_with(ltrim(t), substr(comment, 6)) THEN ltrim(substr(ltrim(t), length(comment) - 4))
      WHEN comment = 'html' AND starts_with(t, '<!--') AND t LIKE '%-->' THEN trim(substr(t, 5, length(t) - 7)) END AS body FROM l WHERE line < n OR t <> ''),
d AS (SELECT *, list_filter(string_split(substr(body, 11), ' '), lambda w: w <> '') AS w, starts_with(body, 'glyphmill:') AS is_directive FROM m),
k AS (SELECT *, CASE WHEN NOT coalesce(is_directive, false) THEN NULL WHEN w[1] = 'ignore' AND len(w) = 1 THEN 'missing-ignored-words' WHEN w[1] = 'ignore' THEN 'ignore'
      WHEN w[1] IN ('disable', 'enable') AND len(w) > 1 THEN 'unexpected-arguments' WHEN w[1] IN ('disable', 'enable') THEN w[1] ELSE 'unknown-directive' END AS kind FROM d),
s AS (SELECT *, last_value(CASE WHEN kind IN ('disable', 'enable') THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sw FROM k)
SELECT doc_id, line::BIGINT AS line, coalesce(kind, 'active') AS kind FROM s WHERE kind IS NOT NULL OR coalesce(sw, 'enable') = 'enable'
"""


def q_line_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    wrong = unrecognized(docs.select(F.explode(words(F.col("text"))).alias("word")), h(spark, sf_dir))
    return among(tokenize_lines(docs), settle(wrong, "unknown")).select("doc_id", "word", "byte_start", "line", "column")


SQL_LINE_COLUMN = f"""
WITH {SQL_H}, p AS (SELECT doc_id, string_split(regexp_replace(text, '({WORD_RE})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
e AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS word FROM p),
r AS (SELECT doc_id, i, word, sum(strlen(word)) OVER w - strlen(word) AS byte_start, sum(length(word) - length(replace(word, chr(10), ''))) OVER w + 1 AS line,
      sum(length(word)) OVER w - length(word) AS chars,
      max(CASE WHEN contains(word, chr(10)) THEN chars_before + length(word) - length(split_part(word, chr(10), -1)) END) OVER w AS line_start
      FROM (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS chars_before FROM e) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, word, byte_start::BIGINT AS byte_start, line::BIGINT AS line, (chars - coalesce(line_start, 0) + 1)::BIGINT AS column
FROM r WHERE i % 2 = 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.word = r.word)
"""

PATHS = [("src/main.rs",), ("src/a/b.rs",), ("yx.rs",), ("docs/read.md",), ("a.txt",), ("src/.rs",)]
GLOBS = [("src/*.rs", "^src/[^/]*[.]rs$"), ("**/x.rs", "^.*x[.]rs$"), ("src/**", "^src/.*$"), ("?.txt", "^.[.]txt$"), ("**", "^.*$")]


def q_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = values(spark, PATHS, "path string")
    tests = F.explode(F.array(*(F.struct(F.lit(g).alias("pattern"), F.col("path").rlike(glob_regex(g)).alias("matched")) for g, _ in GLOBS)))
    return paths.select("path", tests.alias("t")).select("path", "t.*")


SQL_GLOB = f"SELECT path, pattern, regexp_matches(path, re) AS matched FROM {sql_values(PATHS)} AS p(path), {sql_values(GLOBS)} AS g(pattern, re)"

AFF = "PFX U Y 1\nPFX U 0 un .\nSFX S Y 2\nSFX S 0 s [^y]\nSFX S y ies y\nSFX D N 1\nSFX D 0 ed/S .\nSFX L Y 1\nSFX L 0 ly .\n"
STEMS = [("walk", "SDU"), ("happy", "UL"), ("try", "S"), ("kind", "UL"), ("jump", "SD")]
DIC = f"{len(STEMS)}\n" + "\n".join(f"{s}/{f}" for s, f in STEMS)
#: kind, flag, strip, add, condition, cross product, continuation
RULES = [("P", "U", "", "un", "^", True, ""), ("S", "S", "", "s", "[^y]$", True, ""), ("S", "S", "y", "ies", "y$", True, ""), ("S", "D", "", "ed", ".$", False, "S"), ("S", "L", "", "ly", ".$", True, "")]
SQL_AFFIX = (
    f"lex AS (SELECT stem, flags FROM {sql_values(STEMS)} AS l(stem, flags)), rule AS (SELECT * FROM {sql_values(RULES)} AS r(kind, flag, strip, add, cond, crossing, more)), "
    "one AS (SELECT stem, flags, kind, flag, crossing, more, CASE kind WHEN 'P' THEN add || substr(stem, length(strip) + 1) ELSE substr(stem, 1, length(stem) - length(strip)) || add END AS form "
    "FROM lex JOIN rule ON contains(flags, flag) AND regexp_matches(stem, cond) AND (kind = 'P' AND starts_with(stem, strip) OR kind = 'S' AND ends_with(stem, strip)))"
)


def _fixture() -> AffixDictionary:
    return import_text(AFF, DIC)


def q_affix_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_table(spark, _fixture()).where("depth = 1 and accepted").select("stem", "form")


SQL_AFFIX_GENERATE = f"WITH {SQL_AFFIX} SELECT stem, form FROM one"


def q_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_table(spark, _fixture()).where("accepted and depth > 1").select("stem", "form").distinct()


SQL_CROSS = f"""
WITH {SQL_AFFIX},
two AS (
  SELECT o.stem, CASE r.kind WHEN 'P' THEN r.add || substr(o.form, length(r.strip) + 1) ELSE substr(o.form, 1, length(o.form) - length(r.strip)) || r.add END AS form, r.kind, r.crossing, o.flags, r.more
  FROM one o JOIN rule r ON regexp_matches(o.form, r.cond) AND (r.kind = 'P' AND starts_with(o.form, r.strip) OR r.kind = 'S' AND ends_with(o.form, r.strip))
   AND (o.kind = 'P' AND r.kind = 'S' AND o.crossing AND r.crossing AND contains(o.flags, r.flag) OR o.kind = 'S' AND r.kind = 'S' AND contains(o.more, r.flag)))
SELECT DISTINCT stem, form FROM two
"""


def q_affix_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of H that are another word of H with an ending: endings in one equi-join, stems in another."""
    known = h(spark, sf_dir).select("word")
    endings = values(spark, [("s",), ("ed",), ("ing",), ("en",), ("re",)], "add string")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length("word") - 1)), lambda n: F.substr("word", F.length("word") - n + 1)))
    cut = known.where(F.length("word") > 1).select("word", ends.alias("add")).join(F.broadcast(endings), "add")
    stems = cut.select("word", "add", F.substr("word", F.lit(1), F.length("word") - F.length("add")).alias("stem"))
    return stems.join(known.select(F.col("word").alias("stem")), "stem", "left_semi").select("word", "stem", "add")


SQL_AFFIX_REVERSE = f"""
WITH {SQL_H}, e AS (SELECT * FROM (VALUES ('s'), ('ed'), ('ing'), ('en'), ('re')) AS e(add))
SELECT a.word, b.word AS stem, e.add FROM (SELECT word, substr(word, length(word) - n + 1) AS add, substr(word, 1, length(word) - n) AS stem FROM h, (VALUES (1), (2), (3)) AS v(n) WHERE length(word) > n) a
JOIN e ON e.add = a.add JOIN h b ON b.word = a.stem
"""

CHAIN = "SFX A N 1\nSFX A 0 x/B .\nSFX B N 1\nSFX B 0 y/C .\nSFX C N 1\nSFX C 0 z/A .\nPFX P Y 1\nPFX P 0 un/Q .\nPFX Q Y 1\nPFX Q 0 re .\n"
CHAIN_EDGES = [("S", "A", "B"), ("S", "B", "C"), ("S", "C", "A"), ("P", "P", "Q")]


def q_flag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, t[2:], o[2:]) for k, t, o in flag_origins(import_text(CHAIN, "1\nroot/A"))]
    return values(spark, rows, "kind string, terminal string, origin string")


SQL_CLOSURE = f"""
WITH RECURSIVE e AS (SELECT * FROM {sql_values(CHAIN_EDGES)} AS e(kind, flag, more)), f AS (SELECT kind, flag FROM e UNION SELECT kind, more FROM e),
r(kind, terminal, origin) AS (SELECT kind, flag, flag FROM f UNION SELECT r.kind, r.terminal, e.flag FROM r JOIN e ON e.kind = r.kind AND e.more = r.origin)
SELECT kind, terminal, origin FROM r
"""


def q_case_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised and upper-case words of the benchmark against lower-case words of H."""
    from ..operators.recognize import case_candidates

    low = h(spark, sf_dir).where(F.col("word").rlike("^[a-z]+$")).select(F.col("word").alias("candidate"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word")).where(F.col("word").rlike("^[A-Za-z]+$")).distinct()
    spread = asked.select("word", F.explode(F.concat(F.array("word"), F.transform(case_candidates(F.col("word")), lambda c: c["candidate"]))).alias("candidate"))
    return spread.join(low, "candidate", "left_semi").select("word", "candidate").distinct()


SQL_CASE = f"""
WITH {SQL_H}, a AS (SELECT DISTINCT word FROM (SELECT {sql_words('text')} AS word FROM benchmark) WHERE regexp_matches(word, '^[A-Za-z]+$')),
c AS (SELECT word, word AS candidate FROM a UNION SELECT word, lower(word) FROM a WHERE regexp_matches(word, '^[A-Z]+[a-z]*$')
      UNION SELECT word, upper(substr(word, 1, 1)) || lower(substr(word, 2)) FROM a WHERE regexp_matches(word, '^[A-Z]+$'))
SELECT word, candidate FROM c WHERE regexp_matches(candidate, '^[a-z]+$') AND EXISTS (SELECT 1 FROM h WHERE h.word = candidate)
"""

BREAK_WORDS = [("E-Mail",), ("Mail.Adresse",), ("E-Mail.Adresse",), (".Adresse",), ("E",), ("Mail-E",), ("E--Mail",)]


def q_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = import_text("BREAK 2\nBREAK -\nBREAK .\n", "3\nE\nMail\nAdresse")
    return Recognizer(spark, dictionary).contains(values(spark, BREAK_WORDS, "word string"))


SQL_BREAK = f"""
WITH w AS (SELECT word FROM {sql_values(BREAK_WORDS)} AS v(word)), s AS (SELECT * FROM (VALUES ('E'), ('Mail'), ('Adresse')) AS s(stem)),
k AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM w),
cut AS (SELECT word FROM k WHERE substr(word, i, 1) IN ('-', '.') AND substr(word, 1, i - 1) IN (SELECT stem FROM s) AND substr(word, i + 1) IN (SELECT stem FROM s))
SELECT word, word IN (SELECT stem FROM s) OR word IN (SELECT word FROM cut) AS recognized FROM w
"""

PARTS = [("Haus",), ("Tür",), ("Schloss",), ("a",)]
COMPOUNDS = [("HausTür",), ("HausTürSchloss",), ("HausTürx",), ("Haus",), ("HausHaus",), ("TürHausTür",), ("aa",)]


def q_compound_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = import_text("COMPOUNDFLAG C\nCOMPOUNDMIN 2\nCHECKCOMPOUNDDUP\n", f"{len(PARTS)}\n" + "\n".join(f"{p}/C" for (p,) in PARTS))
    return Recognizer(spark, dictionary).contains(values(spark, COMPOUNDS, "word string"))


SQL_COMPOUND = f"""
WITH RECURSIVE w AS (SELECT word FROM {sql_values(COMPOUNDS)} AS v(word)), s AS (SELECT stem FROM {sql_values(PARTS)} AS s(stem)),
r(word, pos, n) AS (SELECT word, 0, 0 FROM w UNION SELECT r.word, pos + length(stem), n + 1 FROM r JOIN s ON length(stem) >= 2 AND substr(r.word, pos + 1, length(stem)) = stem AND NOT ends_with(substr(r.word, 1, pos), stem))
SELECT word, word IN (SELECT stem FROM s) OR EXISTS (SELECT 1 FROM r WHERE r.word = w.word AND pos = length(w.word) AND n >= 2) AS recognized FROM w
"""

POSITIONED = [("Bahn", "B"), ("Hof", "M"), ("Straße", "E")]
POSITIONED_WORDS = [("BahnStraße",), ("BahnHofStraße",), ("BahnHofHofStraße",), ("HofStraße",), ("BahnHof",), ("StraßeBahn",)]


def q_compound_positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = import_text("COMPOUNDBEGIN B\nCOMPOUNDMIDDLE M\nCOMPOUNDEND E\nCOMPOUNDMIN 1\n", "3\n" + "\n".join(f"{s}/{f}" for s, f in POSITIONED))
    return Recognizer(spark, dictionary).contains(values(spark, POSITIONED_WORDS, "word string"))


SQL_POSITIONED = f"""
WITH RECURSIVE w AS (SELECT word FROM {sql_values(POSITIONED_WORDS)} AS v(word)), s AS (SELECT * FROM {sql_values(POSITIONED)} AS s(stem, f)),
r(word, pos, f) AS (SELECT word, length(stem), 'B' FROM w JOIN s ON f = 'B' AND starts_with(word, stem)
  UNION SELECT r.word, pos + length(stem), s.f FROM r JOIN s ON s.f IN ('M', 'E') AND r.f <> 'E' AND substr(r.word, pos + 1, length(stem)) = stem)
SELECT word, word IN (SELECT stem FROM s) OR EXISTS (SELECT 1 FROM r WHERE r.word = w.word AND pos = length(w.word) AND r.f = 'E') AS recognized FROM w
"""

CASCADE_WORDS = [("walk",), ("walks",), ("Walked",), ("walkeds",), ("unwalks",), ("UNHAPPY",), ("unhappyly",), ("tries",), ("trys",), ("kind-jump",), ("unjump",), ("happies",)]


def q_contains_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Recognizer(spark, _fixture()).contains(values(spark, CASCADE_WORDS, "word string"))


SQL_CASCADE = f"""
WITH {SQL_AFFIX},
two AS (
  SELECT CASE r.kind WHEN 'P' THEN r.add || substr(o.form, length(r.strip) + 1) ELSE substr(o.form, 1, length(o.form) - length(r.strip)) || r.add END AS form
  FROM one o JOIN rule r ON regexp_matches(o.form, r.cond) AND (r.kind = 'P' AND starts_with(o.form, r.strip) OR r.kind = 'S' AND ends_with(o.form, r.strip))
   AND (o.kind = 'P' AND r.kind = 'S' AND o.crossing AND r.crossing AND contains(o.flags, r.flag) OR o.kind = 'S' AND r.kind = 'S' AND contains(o.more, r.flag))),
f AS (SELECT stem AS form FROM lex UNION SELECT form FROM one UNION SELECT form FROM two),
w AS (SELECT word FROM {sql_values(CASCADE_WORDS)} AS v(word)),
c AS (SELECT word, word AS candidate FROM w UNION SELECT word, lower(word) FROM w WHERE regexp_matches(word, '^[A-Z]+[a-z]*$')),
p AS (SELECT word, [candidate] AS parts FROM c UNION ALL SELECT word, string_split(candidate, '-') FROM c WHERE len(string_split(candidate, '-')) = 2)
SELECT word, bool_or(len(list_filter(parts, lambda x: x IN (SELECT form FROM f))) = len(parts)) AS recognized FROM p GROUP BY word
"""
#: A dialect without subqueries in lambdas takes the parts one by one.
SQL_CASCADE = SQL_CASCADE[: SQL_CASCADE.index("SELECT word, bool_or")] + (
    ", u AS (SELECT word, parts, unnest(parts) AS x FROM p), ok AS (SELECT word, parts, bool_and(f.form IS NOT NULL) AS good FROM u LEFT JOIN f ON f.form = u.x GROUP BY word, parts) "
    "SELECT word, bool_or(good) AS recognized FROM ok GROUP BY word"
)


def q_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = Recognizer(spark, _fixture()).explain(values(spark, CASCADE_WORDS, "word string"))
    return told.select("word", "accepted", "casing", "kind", "stem", F.array_join("components", "+").alias("components"), "reason")


def q_iconv_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = import_text("IGNORE ́\nICONV 3\nICONV æ ae\nICONV -_ x\nICONV q 0\n", "1\nword")
    asked = values(spark, [("ær",), ("fin-",), ("wórd",), ("q-q",), ("-a",)], "word string")
    return asked.select("word", normalize_input(F.col("word"), dictionary).alias("normalized"))


def _ascii(df: DataFrame) -> DataFrame:
    return df.where(F.col("word").rlike("^[a-z]+$"))


def q_suggest_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case ASCII words of the benchmark that H lacks, with all words of H one edit away."""
    known = _ascii(h(spark, sf_dir))
    asked = _ascii(table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word")))
    found, _ = suggest(unrecognized(asked, known), known.select("word"), SuggestOptions(max_results=1_000_000, max_distance=1, max_candidates=1 << 40, max_cells=1 << 50))
    return found.select("query", "word", "distance")


SQL_ASKED = f"{SQL_H}, k AS (SELECT word, frequency FROM h WHERE regexp_matches(word, '^[a-z]+$')), q AS (SELECT DISTINCT word AS query FROM (SELECT {sql_words('text')} AS word FROM benchmark) WHERE regexp_matches(word, '^[a-z]+$') AND word NOT IN (SELECT word FROM k))"
#: Words one edit apart share one of their single deletions, or one is a deletion of the other.
SQL_CUT = "SELECT DISTINCT {0}, unnest(list_append(list_transform(generate_series(1, length({0})), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {0})) AS cut FROM {1}"
SQL_NEAR = f"{SQL_ASKED}, near AS (SELECT DISTINCT query, word FROM ({SQL_CUT.format('query', 'q')}) JOIN ({SQL_CUT.format('word', 'k')}) USING (cut) WHERE damerau_levenshtein(query, word) <= 1)"
SQL_SUGGEST_D1 = f"WITH {SQL_NEAR} SELECT query, word, 1 AS distance FROM near"


def q_suggest_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark that H lacks, with all words of H up to two edits away; no SQL, whose edit distance is another one beyond one edit."""
    known = h(spark, sf_dir).select("word")
    asked = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word"))
    found, _ = suggest(unrecognized(asked, known), known, SuggestOptions(max_results=1_000_000, max_distance=2, max_candidates=1 << 40, max_cells=1 << 50))
    return found.select("query", "word", "distance")


def q_suggest_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _ascii(h(spark, sf_dir))
    asked = _ascii(table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word")))
    found, _ = suggest(unrecognized(asked, known), known, SuggestOptions(max_results=3, max_distance=1, max_candidates=1 << 40, max_cells=1 << 50))
    return found.select("query", F.col("rank").cast("long").alias("rank"), "word", F.col("frequency").cast("long").alias("frequency"))


SQL_SUGGEST_FREQUENCY = f"""
WITH {SQL_NEAR}, s AS (SELECT query, word, frequency, row_number() OVER (PARTITION BY query ORDER BY frequency DESC, word) AS rank FROM near JOIN k USING (word))
SELECT query, rank, word, frequency FROM s WHERE rank <= 3
"""


def q_suggest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a small budget of cells: what is found before it runs out, and how the search ended."""
    known = _ascii(h(spark, sf_dir))
    asked = _ascii(table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("word")))
    found, state = suggest(unrecognized(asked, known), known.select("word"), SuggestOptions(max_results=1_000_000, max_distance=1, max_candidates=1 << 40, max_cells=4000))
    counted = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return state.join(counted, "query", "left").select("query", "completeness", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


SQL_SUGGEST_BUDGET = f"""
WITH {SQL_ASKED}, lens AS (SELECT DISTINCT length(query) AS ql FROM q),
run AS (SELECT ql, word, sum((ql + 1) * (length(word) + 1)) OVER (PARTITION BY ql ORDER BY word) AS cells FROM lens JOIN k ON abs(ql - length(word)) <= 1),
hit AS (SELECT query, word FROM q JOIN run ON ql = length(query) AND cells <= 4000 AND damerau_levenshtein(query, word) <= 1),
over AS (SELECT ql FROM run GROUP BY ql HAVING max(cells) > 4000)
SELECT query, CASE WHEN length(query) IN (SELECT ql FROM over) THEN 'edit-distance budget reached' ELSE 'complete' END AS completeness, (SELECT count(*) FROM hit WHERE hit.query = q.query)::BIGINT AS n FROM q
"""


def q_suggest_rep_key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = values(spark, [("q",), ("á",), ("teh",), ("Recieve",)], "word string")
    known = values(spark, [("e",), ("w",), ("a",), ("z",), ("tea",), ("the",), ("receive",)], "word string")
    found, _ = suggest(asked, known, replacements=[("teh", "the", True, True)], keyboard="qw|er", maps=["áz"])
    return found.where("rank = 1").select("query", "word", "distance", "ranking_distance")


IDENTIFIER_EDITS = [("userAuthentcationProvider", 4, "Authentcation", "authentication"), ("HTTPRespnse", 4, "Respnse", "response"), ("MAX_LENGHT", 4, "LENGHT", "length"), ("getNaem", 3, "Naem", "name"), ("naem_of", 0, "naem", "Name")]


def q_whole_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, IDENTIFIER_EDITS, "token string, at int, word string, suggestion string")
    return rows.select("token", whole_identifier(F.col("token"), F.col("at"), F.col("word"), F.col("suggestion")).alias("replaced"))


SQL_WHOLE = f"""
SELECT token, substr(token, 1, start_at) || CASE WHEN regexp_matches(word, '^[a-z]*$') THEN lower(suggestion) WHEN regexp_matches(word, '^[A-Z]+$') THEN upper(suggestion)
  WHEN regexp_matches(word, '^[A-Z][a-z]+$') THEN upper(substr(suggestion, 1, 1)) || lower(substr(suggestion, 2)) ELSE suggestion END || substr(token, start_at + length(word) + 1) AS replaced
FROM {sql_values(IDENTIFIER_EDITS)} AS v(token, start_at, word, suggestion)
"""


def q_artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_name")
    return names.select("n_name", F.sha2(F.col("n_name").cast("binary"), 256).alias("digest"), (F.sha2(F.lower("n_name"), 256) == F.sha2(F.col("n_name"), 256)).alias("same_as_lower"))


SQL_ARTIFACT_VERIFY = "SELECT n_name, sha256(n_name) AS digest, sha256(lower(n_name)) = sha256(n_name) AS same_as_lower FROM nation"


def q_artifact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all part names, compiled into an artifact and read back."""
    raw = artifacts.compile_words(table(spark, sf_dir, "part").select(F.explode(words(F.col("p_name"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency")))
    artifacts.validate(raw)
    return values(spark, list(artifacts.decode(raw)), "word string, frequency bigint")


SQL_ARTIFACT_WORDS = f"SELECT word, count(*) AS frequency FROM (SELECT {sql_words('p_name')} AS word FROM part) GROUP BY word"


def q_dictionary_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.col("locale").rlike("^[A-Za-z0-9_-]+$") & F.col("aff_sha256").rlike("^[0-9a-f]{64}$") & F.col("dic_sha256").rlike("^[0-9a-f]{64}$") & (F.trim("license") != "")
    return catalog.catalog(spark).select("locale", "encoding", safe.alias("safe"))


DECISIONS = [("en", "walks", True, True), ("en", "wlak", False, False), ("en", "unkinds", True, False), ("de", "Haus", True, True), ("de", "Huas", True, False)]


def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, DECISIONS, "locale string, word string, ours boolean, other boolean")
    return rows.groupBy("locale").agg(F.count_if(F.col("ours") == F.col("other")).alias("agreements"), F.count_if(F.col("ours") != F.col("other")).alias("disagreements"))


SQL_SCORECARD = f"SELECT locale, count(*) FILTER (ours = other) AS agreements, count(*) FILTER (ours <> other) AS disagreements FROM {sql_values(DECISIONS)} AS v(locale, word, ours, other) GROUP BY locale"


def q_stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations replayed as a stream of document versions; misspellings per conversation and turn."""
    import uuid

    known = h(spark, sf_dir).select("word")
    path = f"{sf_dir.rstrip('/')}/conversations.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.removesuffix("t") + "[t]")  # a glob: the source would take a plain path for a folder
    versions = rows.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), F.lit(1).alias("version"), "text")
    base = f"{shared_folder(spark)}/glyphmill-stream-{uuid.uuid4().hex}"
    out = f"{base}/findings"
    query = check_stream(versions, lambda: known, lambda found, n: found.write.mode("append").parquet(out), f"{base}/state")
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


SQL_STREAM = f"""
WITH {SQL_H}, t AS (SELECT conv_id || ':' || turn AS doc_id, {sql_words('text')} AS word FROM conversations)
SELECT doc_id, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.word = t.word) GROUP BY doc_id
"""

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}

ORACLE = {
    "q_tokenize": SQL_TOKENIZE, "q_word_frequency": SQL_WORD_FREQUENCY, "q_check_text": SQL_CHECK_TEXT, "q_misspelling_rate_by_lang": SQL_RATE, "q_wordlist_parse": SQL_WORDLIST,
    "q_frequency_list": SQL_FREQUENCY, "q_checker_union": SQL_UNION, "q_overlay_ops": SQL_OVERLAY, "q_normalize_nfc": SQL_NFC, "q_classify": SQL_CLASSIFY, "q_split_identifier": SQL_SPLIT,
    "q_analyze_policy": SQL_ANALYZE, "q_directives": SQL_DIRECTIVES, "q_line_column": SQL_LINE_COLUMN, "q_glob": SQL_GLOB, "q_affix_generate": SQL_AFFIX_GENERATE, "q_cross_product": SQL_CROSS,
    "q_affix_reverse": SQL_AFFIX_REVERSE, "q_flag_closure": SQL_CLOSURE, "q_case_fallback": SQL_CASE, "q_break": SQL_BREAK, "q_compound_generic": SQL_COMPOUND, "q_compound_positioned": SQL_POSITIONED,
    "q_contains_cascade": SQL_CASCADE, "q_suggest_d1": SQL_SUGGEST_D1, "q_suggest_frequency": SQL_SUGGEST_FREQUENCY, "q_suggest_budget": SQL_SUGGEST_BUDGET, "q_whole_identifier": SQL_WHOLE,
    "q_artifact_verify": SQL_ARTIFACT_VERIFY, "q_artifact_words": SQL_ARTIFACT_WORDS, "q_scorecard": SQL_SCORECARD, "q_stream_check": SQL_STREAM,
}
