"""Operators that look at one row at a time: HTML, quality, secrets, decontamination."""

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from glyphmill.llm import decontamination, html, quality, secrets
from glyphmill.llm.tokens import byte_bpe, piece_bpe, piece_counts


def texts(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><a href="/">Home</a></header><div id="cookie-notice">We use cookies, many of them, ok?</div>
<div class="layout"><div class="sidebar"><p>Related, stuff, here, with, many, commas, and more, text.</p></div>
<div class="post"><h1>Title &amp; more</h1><div><p>First   para,
with text<p>Second <b>bold</b> one<ul><li>a<li>b</ul></div><form><p>Subscribe, please, now</p></form>
<div class="comments"><p>Great, post, I, really, liked, it</p></div></div></div><footer>&copy; me</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html.main_text(PAGE) == "Title & more\nFirst para, with text\nSecond bold one\na\nb"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<div>b<span>c</span></div>d", "a\nbc\nd"), ("<nav><a href=x>m</a></nav>", ""),
        ("<article><p>cut off &am", "cut off &am"), ("<article><p>x<di", "x"), ("<article><p>1 < 2 &lt; 3</article>", "1 < 2 < 3"),
        ("<article><p>a<br>b</p><!-- note --><p>c</article>", "a b\nc"), ("<article><script>no", ""), ("<article><p class='ad'>buy</p><p>text</p></article>", "text"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ],
)
def test_html_cases(page, text):
    assert html.main_text(page) == text


def test_html_class_words():
    page = """<body class="no-sidebar"><div class="wrap has-sidebar"><div class="story-text"><header class="entry-header"><h1>Head</h1></header>
    <p>Body text, with commas, and words.</p><p class="note">Plain note</p></div>
    <section id="comments"><article class="comment"><p>Reader, says, much, here, and, there</p></article></section>
    <ul class="social-links"><li>Share it</li></ul></div></body>"""
    assert html.main_text(page) == "Head\nBody text, with commas, and words.\nPlain note"
    page = page.replace('<div class="story-text">', "<article>").replace("note</p></div>", "note</p></article>")
    assert html.main_text(page) == "Head\nBody text, with commas, and words.\nPlain note"


def test_html_deep_and_long_pages():
    assert html.main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    long = " ".join(f"w{k}" for k in range(200_000))
    assert html.main_text(f"<article><p>{long}</p></article>") == long


def test_html_keeps_the_whole_article():
    """Short sections, quotes and lists beside a long one; the side bar within stays out."""
    long = "<p>" + "long, text " * 80 + "</p>"
    want = ("long, text " * 80).strip()
    page = f"<main><article><h1>T</h1><section>{long}</section><section><h2>S</h2><p>s</p></section><aside>no</aside></article><article><p>other</p></article></main>"
    assert html.main_text(page) == f"T\n{want}\nS\ns"
    assert html.main_text(f"<body><main><div>{long}</div><blockquote>q</blockquote><ul><li>u</ul></main><div>x</div>") == f"{want}\nq\nu"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<script async src="x.js"/>var a=1;</script><p>text</p>', "text"), ('<article><p><a name="x"/>text, more</article>', "text, more"), ("<article><p>a<a href=/x/>link</a> b</article>", "alink b"),
        ('<article><svg><path d="M0"/><text>no</text></svg><p>a</article>', "a"), ("<article><svg/><p>a</article>", "a"), ("<article><div/><p>a</article>", "a"),
    ],
)
def test_html_slashes(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", ["<b>" * 16000 + "</i>" * 16000, "<a><div>" * 8000 + "</a>" * 8000, "<b>" * 16000 + "<h1></h1>" * 16000, "<b>" * 16000 + "x<hr>" * 16000, "<header>" * 16000])
def test_html_hostile_pages_take_linear_time(page):
    start = time.monotonic()
    html.main_text(page)
    assert time.monotonic() - start < 3


def test_html_frame(spark):
    pages = texts(spark, [(1, "u", PAGE, 7), (2, None, None, 8), (2, None, None, 8)], "page_id bigint, url string, html string, n_chars int")
    rows = html.extract(pages).collect()
    assert [r["text"] for r in rows if r["page_id"] == 2] == ["", ""] and rows[0]["n_chars"] == 7
    assert html.extract(pages.limit(0)).count() == 0


# Quality


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(k, k + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "a a a a a", "x\x85y z　w", "l\nl\n \nl", "é*#&\n" * 3 + "the end of it the end of it all", "a b"])
def test_base_counts(text):
    assert quality.base_counts(text) == brute_counts(text)


def test_fertility_agrees_with_the_encoders():
    text = "Plain words, ünïcode and 漢字 𝔘 \n tail"
    n, chars, fallback, entropy = quality.fertility(text)
    ids = byte_bpe().encode_ordinary(text)
    pieces = piece_bpe().encode(text)
    assert n == len(ids) and chars == len(text) / n
    assert fallback == sum(map(piece_bpe().is_byte, pieces)) / len(pieces) > 0
    assert 0 < entropy <= n


def test_ids_are_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ("Hello  world\n\n don't", "Straße ÄÖÜ 12345 %%% &&&", " \t x", "漢字かな", "<|endoftext|> a", "ñ" * 500):
        assert byte_bpe().encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


def test_the_added_token_is_found_in_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("end of one<|endoftext|>start of two", "a  <|endoftext|> \n b", "<|endoftext|><|endoftext|>", "<|endoftext|", "plain"):
        ids = other.encode(text, add_special_tokens=False).ids
        assert byte_bpe().encode_to_numpy(text, allowed_special="all").tolist() == ids
        assert quality.fertility(text)[0] == len(ids)


def test_fallback_share_is_one_measure_for_every_text():
    """A rare character adds its own bytes only: line breaks count with and without it."""
    line = "time year people way day man thing woman life child\n"
    for text in (line * 20, line * 20 + "\U0001f9ff", "a\tb", "plain words", "caf\u00e9 \u3000 \r x"):
        pieces = piece_bpe().encode(text)
        assert quality.fertility(text)[2] == sum(map(piece_bpe().is_byte, pieces)) / len(pieces)
    assert quality.fertility(line * 20)[2] > 0.05


def test_piece_counts_by_chunks_are_those_of_whole_texts(spark):
    draw, model = random.Random(5), piece_bpe()
    parts = ["the", "people", " ", "  ", "\n", "\n\n", "\t", "\u2581", "\u2581\u2581a", "\u00e9", "\u6f22\u5b57", "\U0001f9ff", "\x00", "\u00a0", "x" * 200, ".", "don't", "\r\n", "<0x0A>", "</s>"]
    made = ["".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(3000)]
    noise = ["".join(map(chr, draw.choices(range(128), k=300))) for _ in range(300)]
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    corpus = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0]]
    for text in [*made, *noise, *pieces, *corpus, " " * 5000, "a" * 5000, "ab" * 300 + " c"]:
        ids = model.encode(text)
        assert piece_counts().count(text) == (len(ids), sum(map(model.is_byte, ids))), repr(text)


def test_piece_counts_of_very_long_words_take_no_square_time():
    start = time.monotonic()
    for text in ("a" * 500_000, "thequick" * 60_000, " " * 500_000, "\u00e9" * 300_000):
        piece_counts().count(text)
    assert time.monotonic() - start < 20


def test_bands_reject_noise_and_keep_good_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.judge(docs, quality.sample_bands(docs, labels)).join(labels, "doc_id").where("not base_failed")
    good, kept_good = judged.where("quality = 1").agg(F.count(F.lit(1)), F.count_if("kept")).first()
    bad, kept_bad = judged.where("quality = 0").agg(F.count(F.lit(1)), F.count_if("kept")).first()
    assert kept_good >= 0.98 * good and kept_bad <= 0.3 * bad


def test_bands_are_fitted_on_all_good_rows(spark):
    """20,000 labelled rows, some beyond any sample's limits: every quantile as numpy has it over all of them."""
    rng = np.random.default_rng(4)
    n = 20_000
    lang = rng.choice(["en", "de", None, "", "few"], n, p=[0.6, 0.3, 0.06, 0.0395, 0.0005])
    tokens, chars, entropy = rng.integers(60, 3000, n), rng.gamma(9, 0.5, n).round(3) + rng.random(n) * (rng.random(n) < 0.5), rng.random(n) * 9
    fallback = np.zeros(n)
    fallback[np.flatnonzero(lang == "de")[-1]] = 0.3
    rows = list(zip(lang.tolist(), tokens.tolist(), chars.tolist(), fallback.tolist(), entropy.tolist(), strict=True))
    bands = quality.fit_bands(spark.createDataFrame(rows, "lang string, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double"))
    assert set(bands) == {"", "en", "de"}

    def low(values):
        q = np.quantile(values, 0.002)
        return q - 0.15 * (np.median(values) - q)

    for key, band in bands.items():
        own = lang == key if key else np.ones(n, bool)
        power = np.floor(np.log2(tokens[own])).astype(int)
        lows = [(p, low(entropy[own][power == p])) for p in sorted(set(power.tolist())) if (power == p).sum() >= quality.MIN_ROWS]
        assert [p for p, _ in band.entropy_low] == [p for p, _ in lows] and [x for _, x in band.entropy_low] == pytest.approx([x for _, x in lows], rel=1e-12)
        want = (np.median(chars[own]), low(chars[own]), -low(-chars[own]), max(0.02, 2 * fallback[own].max()))
        assert (band.chars_median, band.chars_low, band.chars_high, band.fallback_high) == pytest.approx(want, rel=1e-12)


def test_bands_use_every_labelled_row(spark):
    """9,000 labelled rows, over the 8,192 of the former sample: a single one with byte fallback sets the limit, whichever it is."""
    plain = "some plain words of a text that goes on and on " * 6
    odd = plain + "\U0001f9ff" * 40
    skipped = spark.range(9000).orderBy(F.xxhash64("id"), "id").collect()[-1][0]  # the last in the order of the hashes
    docs = texts(spark, [(k, odd if k == skipped else plain, "en") for k in range(9000)], "doc_id bigint, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert quality.sample_bands(docs, labels)["en"].fallback_high > 0.1
    rated = quality.rate(docs.where(F.col("doc_id").isin(skipped, skipped - 1) | (F.col("doc_id") % 100 == 0)), labels)
    assert "text" not in rated.columns and rated.where(f"doc_id = {skipped}").first()["fallback_share"] > 0.05


def test_quality_frame_edges(spark):
    docs = texts(spark, [(1, None, "en", 5), (1, None, "en", 5), (2, "", None, 6), (None, "w " * 400, "en", 7)], "doc_id bigint, text string, lang string, n_words int")
    rows = quality.judge(docs, {}).collect()
    assert [r["n_words"] for r in rows] == [0, 0, 0, 400] and all(r["base_failed"] and not r["kept"] for r in rows)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.sample_bands(docs, labels) == {}


# Secrets


def spans_of(text):
    plain, every = secrets.scan(text)
    return secrets.rendered(plain), secrets.rendered(every)


def test_plain_spans_and_dropped_matches():
    assert spans_of("Password: 'abcdef' x")[0] == "assign:0:17"
    assert spans_of("token=ab secret=token: abcdef")[0] == ""  # the failing match takes its text with it
    key = "AKIA" + "B" * 16
    assert spans_of(f"x {key} y")[0] == "access:2:22" and spans_of(f"x {key[:-1]} y")[0] == ""
    assert spans_of("é " + "0a" * 12)[0] == "hex:2:26" and spans_of("f" * 23)[0] == ""
    assert spans_of(f"secret={'a1' * 12}")[0] == "assign:0:31,hex:7:31"
    assert spans_of("paſſword=abcdefgh")[0] == ""  # ASCII letters only, in either case


def test_layers_are_unwrapped_and_mapped():
    secret = "password=hunter2hunter"
    once = base64.b64encode(secret.encode()).decode()
    twice = base64.b64encode(gzip.compress(once.encode())).decode()
    nested = urllib.parse.quote(twice, safe="")
    for layer in (once, twice, nested):
        text = f"see {layer} end"
        plain, every = secrets.scan(text)
        a, kind, b = every[0]
        assert plain == [] and kind == 0 and a == 4 and text[a:b].rstrip("=") in (layer, layer.rstrip("="), layer.removesuffix("%3D"), layer.removesuffix("%3D%3D"))
    text = "x password%3Dabcdefgh y"
    assert secrets.scan(text) == ([], [(2, 0, 21)])
    text = "\\u0070assword=abcdefgh"
    assert secrets.scan(text) == ([], [(0, 0, len(text))])
    assert secrets.scan("%2541KIA" + "Z" * 16) == ([], [(0, 1, 24)])


def test_equal_nested_tokens_are_all_reported():
    one = base64.b64encode(b"token%3Dabcdefgh").decode()
    for text in (f"{one} and {one}", "\n".join([one] * 3)):
        places = [(m.start(), 0, m.end()) for m in re.finditer(re.escape(one), text)]
        assert secrets.scan(text) == ([], places)
    twice = base64.b64encode(f"{one}".encode()).decode()
    assert len(secrets.scan(f"{twice} {twice}")[1]) == 2


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_all_members_of_a_stream_are_read(pack):
    token = base64.b64encode(pack(b"first part ") + pack(b"token=abcdefghij")).decode()
    assert secrets.scan(token) == ([], [(0, 0, len(token))])


def test_a_bound_within_a_character_keeps_the_layer():
    token = base64.b64encode(gzip.compress(("token=abcdefghij " + "\u00e9" * 100).encode())).decode()
    assert [s[1] for s in secrets.scan(token, window=100)[1]] == [0]


def test_tokens_behind_a_path_or_prefix_are_decoded():
    token = base64.b64encode(b"password=hunter2hunter").decode().rstrip("=")
    for before in ("example.com/path/", "id_", "a/b-c_", "x/"):
        assert secrets.scan(before + token)[1] == [(len(before), 0, len(before + token))], before
    assert secrets.scan(f"{token}/tail/of/it")[1] == [(0, 0, len(token))]
    for before in ("q", "qz", "qzx"):
        assert [k for _, k, _ in secrets.scan(before + token)[1]] == [0], before


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_long_streams_are_read_to_the_end(pack):
    """A secret behind 20 MB, one that two windows share, and one in a stream within the stream."""
    token = base64.b64encode(pack(pack(b"plain words " * 1_700_000 + b"token=abcdefghij"))).decode()
    assert secrets.scan(token)[1] == [(0, 0, len(token))]
    body = b"x" * 995 + b" token=abcdefghij " + b"y" * 3000
    token = base64.b64encode(pack(body)).decode()
    assert secrets.scan(token, window=1000)[1] == [(0, 0, len(token))]


def test_utf16_and_nested_escapes():
    for code in ("utf-16", "utf-16-le", "utf-16-be"):
        token = base64.b64encode("password=hunter2hunter".encode(code)).decode()
        assert secrets.scan(token)[1] == [(0, 0, len(token))], code
        assert secrets.scan("x/y/" + token)[1] == [(4, 0, 4 + len(token))], code
    for depth in (1, 3, 4, 5, 40, 3000):
        text = "password%" + "25" * depth + "3Dabcdefgh"
        assert (0, 0, len(text)) in secrets.scan(text)[1], depth
        text = "\\" + "u005c" * depth + "u0070assword=abcdefgh"
        assert secrets.scan(text) == ([], [(0, 0, len(text))]), depth
    text = "x^ plain text that starts like a stream: token=abcdefgh"
    assert [k for _, k, _ in secrets.scan(base64.b64encode(text.encode()).decode())[1]] == [0]


def test_scan_ends_on_cycles_and_bombs():
    bomb = base64.b64encode(gzip.compress(b"0" * (64 << 20))).decode()
    assert secrets.scan(bomb, window=1 << 16)[0] == []
    assert secrets.scan("%25" * 5000) == ([], [])
    assert secrets.scan(None) == ([], []) and secrets.scan("") == ([], [])


def test_secrets_frame(spark):
    docs = texts(spark, [(1, "token: abcdefg", "s"), (2, None, None), (2, None, None)], "doc_id bigint, text string, spans string")
    rows = secrets.find_secrets(docs).collect()
    assert len(rows[0]["base_spans"]) == len(rows[0]["spans"]) == 1 and rows[1]["spans"] == []


# Decontamination


def test_leaks_found_and_clean_left(spark):
    items = [(k, " ".join(f"term{(k * 7 + j * j) % 97}x{j % 5} common the" for j in range(6 + k)) + f". Answer{k} is here{k}.") for k in range(30)]
    benchmark = texts(spark, [*items, (99, None), (98, "")], "item_id bigint, text string")
    filler = "plain words that no item has and the common rest " * 30
    altered = items[12][1].split()
    altered[3] = "changed"
    docs = [(k, f"{filler} {items[k][1].upper()} {filler}") for k in range(0, 30, 3)] + [(100, filler), (101, None), (102, ""), (103, " ".join(altered)), (104, items[20][1][: len(items[20][1]) // 2])]
    found = decontamination.leaks(texts(spark, docs), benchmark).select("doc_id", F.explode("leaks.item_id")).collect()
    assert {(r[0], r[1]) for r in found} == {(k, k) for k in range(0, 30, 3)} | {(103, 12)}


def test_leaks_need_question_and_answer_and_keep_string_ids(spark):
    question, answer = " ".join(f"q{k}" for k in range(60)), "a1 a2 a3 a4 a5"
    benchmark = spark.createDataFrame([("item-x", f"{question}\n{answer}"), ("item-y", None), (None, "")], "item_id string, text string")
    docs = texts(spark, [(1, f"before {question} {answer} after"), (2, f"{question} b1 b2 b3 b4 b5"), (3, None), (4, ""), (5, f"{question} {answer} " + "x " * 200_000)])
    rows = decontamination.leaks(docs, benchmark).collect()
    assert {r["doc_id"]: [m["item_id"] for m in r["leaks"]] for r in rows} == {1: ["item-x"], 2: [], 3: [], 4: [], 5: ["item-x"]}


def test_index_grows_with_its_postings():
    draw = random.Random(3)
    items = [(k, " ".join(f"w{int(draw.paretovariate(0.6)) % 20000}" for _ in range(50))) for k in range(2000)]
    index = decontamination.Index(items)
    assert len(index.runs) == len(index.ceilings) <= sum(map(len, index.items))
    sample = [t for _, t in items[::100]] + [" ".join(t.split()[::-1]) for _, t in items[::500]]
    found = {(row, m["item_id"]) for row, own in index.matches(pa.array(sample)) for m in own}
    assert {(k, 100 * k) for k in range(20)} <= found and all(row < 20 for row, _ in found)


def test_leaks_agree_with_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    def shingles(text):
        words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    items = {r["item_id"]: shingles(r["text"]) for r in benchmark.collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        own = shingles(r["text"] or "")
        want |= {(r["doc_id"], i) for i, s in items.items() if len(s & own) >= 0.8 * len(s)}
    got = {(r[0], r[1]) for r in decontamination.leaks(docs, benchmark).select("doc_id", F.explode("leaks.item_id")).collect()}
    assert got == want and len(want) > 10
    split = decontamination.leaks(docs, benchmark, shard_bytes=4096)
    assert {(r[0], r[1]) for r in split.select("doc_id", F.explode("leaks.item_id")).collect()} == want


def test_no_benchmark_and_no_documents(spark):
    docs = texts(spark, [(1, "some text")])
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.leaks(docs, none).first()["leaks"] == []
    assert decontamination.leaks(docs.limit(0), texts(spark, [(1, "a b c d e f")], "item_id bigint, text string")).count() == 0
