"""Operators that look at the whole corpus, against brute force, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import eliasfano, languagemodel, linededup, packing, quality, sharding, simhash, substring
from glyphmill.llm.common import Scratch, hinted, small_batches
from glyphmill.llm.components import connected_components
from glyphmill.llm.eliasfano import EliasFano
from glyphmill.llm.tokens import byte_bpe
from glyphmill.llm.wordseq import Words
from glyphmill.tables import shared_folder

SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (5, "ünï çödé\nline"), (6, "x " * 3000), (7, "x " * 3000)]


def docs_of(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus(spark):
    small_batches(spark)
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def rows(corpus):
    return {r["doc_id"]: r["text"] or "" for r in corpus.collect()}


# Line dedup


def test_line_dedup(spark, corpus, rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    count = collections.Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} if k)
    found = linededup.drop_common_lines(corpus, min_docs=3).collect()
    assert len(found) == len(rows)
    for r in found:
        lines = rows[r["doc_id"]].split("\n")
        stay = [x for x in lines if not key(x) or count[key(x)] < 3]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(stay), len(lines), len(lines) - len(stay))


def test_line_dedup_edges(spark):
    docs = docs_of(spark, [(1, " A \nx", 1), (1, " A \nx", 1), (2, "a", 2), (3, "É\na\t", 3), (4, None, 4), (None, "a", 5), (5, "\n\n", 6)], "doc_id bigint, text string, n_lines int")
    found = linededup.drop_common_lines(docs, min_docs=4).orderBy("doc_id", "text").collect()
    assert [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found] == [
        (None, "", 1, 1), (1, "x", 2, 1), (1, "x", 2, 1), (2, "", 1, 1), (3, "É", 2, 1), (4, "", 1, 0), (5, "\n\n", 3, 0),
    ]
    assert linededup.drop_common_lines(docs.limit(0)).count() == 0


# Packing


def check_packed(rows_, n_docs, capacity=1024):
    by = collections.defaultdict(list)
    for r in rows_:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
        assert places[-1][0] + places[-1][1] <= capacity
    return len(by)


def test_packing(spark, corpus, rows):
    found = packing.pack_documents(corpus).collect()
    sequences = check_packed(found, len(rows))
    total = 0
    by = collections.defaultdict(dict)
    for r in found:
        by[r["doc_id"]][r["piece"]] = (r["start"], np.frombuffer(r["ids"], "<u4").tolist())
        assert r["length"] * 4 == len(r["ids"])
    for doc, text in rows.items():
        ids = byte_bpe().encode_ordinary(text) + [2]
        total += len(ids)
        pieces = [by[doc][k] for k in range(len(by[doc]))]
        assert [x for _, p in pieces for x in p] == ids
        assert [len(p) for _, p in pieces[1:]] == [1024] * (len(pieces) - 1)
        assert [s for s, _ in pieces] == [0, *np.cumsum([len(p) for _, p in pieces])[:-1]]
    assert sequences <= 1.02 * total / 1024 + 1


def test_packing_edges(spark):
    found = packing.pack_documents(docs_of(spark, EDGES), digest=True).collect()
    assert check_packed(found, len(EDGES)) > 0
    assert sum(r["doc_id"] in (1, 2) for r in found) == 2 and sum(r["doc_id"] == 4 for r in found) == 2
    assert {r["ids_crc32"] for r in found if r["doc_id"] in (1, 2)} == {zlib.crc32((2).to_bytes(4, "little"))}
    assert packing.pack_documents(docs_of(spark, EDGES).limit(0)).count() == 0


def test_configurations_cover_the_histogram():
    rng = np.random.default_rng(0)
    for n in (0, 1, 30, 3000):
        histogram = np.bincount(rng.integers(1, 65, n), minlength=65)
        cover, used = np.zeros(65, int), 0
        for config, times in packing.configurations(histogram, 64).items():
            assert sum(s * a for s, a in config) <= 64
            used += times
            for s, a in config:
                cover[s] += a * times
        assert (cover == histogram).all()
        over_half = int(histogram[33:].sum())  # no two of these share a sequence
        assert used <= max(1.05 * (histogram * np.arange(65)).sum() / 64, over_half) + 2


# SimHash


def brute_components(ids, prints, limit=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= limit):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, doc in enumerate(ids):
        least[root(k)] = min(least.get(root(k), doc), doc)
    return [least[root(k)] for k in range(len(ids))]


def brute_print(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, corpus, rows):
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(corpus).collect()}
    ids = sorted(rows)
    prints = [brute_print(rows[i]) for i in ids]
    assert [found[i][0] for i in ids] == prints
    assert [found[i][1] for i in ids] == brute_components(ids, prints)


@pytest.mark.parametrize("bucket_rows", [200_000, 20, 3])
def test_links_with_hot_buckets(spark, bucket_rows):
    """Fingerprints that share blocks; small bucket limits deal them again and must change nothing."""
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64) & ~0xFFFF | 0xBEEF
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.link_forest(spark.createDataFrame([(p,) for p in signed], "fp bigint"), bucket_rows=bucket_rows)
    roots = {r["node"]: r["root"] for r in connected_components(links, Scratch(spark, "test")).collect()}
    found = [roots.get(p, p) for p in signed]
    want = brute_components(signed, prints)
    assert found == want


def test_simhash_edges(spark):
    found = simhash.near_duplicates(docs_of(spark, EDGES)).collect()
    assert len(found) == len(EDGES)
    by = collections.defaultdict(set)
    for r in found:
        by[r["doc_id"]].add(r["component"])
    assert by[1] == by[2] == by[3] and by[6] == by[7] == {6} and by[4] == {4}
    assert simhash.near_duplicates(docs_of(spark, EDGES).limit(0)).count() == 0


def test_similar_groups(spark):
    """Texts with some words replaced: near ones join their base, far ones and unrelated texts do not."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows_, want = [], {}
    for base in range(40):
        words = [word() for _ in range(rng.randrange(150, 400))]
        rows_.append((10 * base, " ".join(words)))
        want[10 * base] = 10 * base
        for copy, share in ((1, 0.0), (2, 0.006), (3, 0.012), (4, 0.1)):
            own = [word() if rng.random() < share else w for w in words]
            rows_.append((10 * base + copy, " ".join(own).upper() if copy == 1 else " ".join(own)))
            want[10 * base + copy] = 10 * base if share < 0.1 else 10 * base + copy
    rows_ += [(1000, None), (1001, ""), (1002, "short text"), (1003, "short text"), (1004, "other text")]
    want |= {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002, 1004: 1004}
    groups = collections.defaultdict(list)
    for r in simhash.similar_groups(docs_of(spark, rows_)).collect():
        groups[r["root"]].append(r["doc_id"])
    got = {d: min(g) for g in groups.values() for d in g}
    assert sum(got[d] != want[d] for d in want) <= 2  # a pair near the threshold may fall on either side
    assert all(got[d] == want[d] for d in want if d % 10 in (0, 1, 4) or d >= 1000)
    assert simhash.similar_groups(docs_of(spark, rows_).limit(0)).count() == 0


def test_similar_groups_with_a_hot_group(spark):
    """One base with many copies: buckets over the limit are dealt again, and the group stays one."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows_ = [(k, " ".join(w if rng.random() > 0.004 else f"x{rng.randrange(10**6)}" for w in words)) for k in range(250)]
    rows_ += [(1000 + k, " ".join(f"{k}y{rng.randrange(10**6)}" for _ in range(80))) for k in range(30)]
    groups = collections.defaultdict(list)
    for r in simhash.similar_groups(docs_of(spark, rows_), hot_bucket=40).collect():
        groups[r["root"]].append(r["doc_id"])
    sizes = sorted(map(len, groups.values()))
    assert sizes == [1] * 30 + [250]


@pytest.mark.parametrize("block_shingles", [500, 2_000_000])
def test_similar_groups_equal_exact_jaccard(spark, block_shingles):
    """Pairs from 0.7 to 0.9: exactly those at 0.8 or more link, as by brute force."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows_, near = [], collections.Counter()
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    want = {}
    for base in range(300):
        words = [word() for _ in range(rng.randrange(60, 300))]
        other = words[:]
        for k in range(0, len(words), rng.choice([40, 45, 50, 60])):
            other[k] = word()
        a, b = shingles(words), shingles(other)
        jaccard = len(a & b) / len(a | b)
        near[jaccard >= 0.8] += 1
        rows_ += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
        want |= {2 * base: 2 * base, 2 * base + 1: 2 * base + (jaccard < 0.8)}
    assert min(near[True], near[False]) > 50
    groups = collections.defaultdict(list)
    for r in simhash.similar_groups(docs_of(spark, rows_), block_shingles=block_shingles).collect():
        groups[r["root"]].append(r["doc_id"])
    assert {d: min(g) for g in groups.values() for d in g} == want


def test_hot_buckets_lose_no_pair(spark):
    """Many small pairs in one hot bucket, alike in no other: every pair still meets in some bucket."""
    rows_ = [(i, i.to_bytes(8, "little"), 7) for i in range(600)] + [(i, i.to_bytes(8, "little"), 8) for i in range(30)]
    dealt = simhash._dealt(spark.createDataFrame(rows_, "node bigint, fp binary, bucket bigint"), Scratch(spark, "test"), hot_bucket=40).collect()
    members = collections.defaultdict(set)
    for r in dealt:
        members[r["bucket"]].add(r["node"])
    assert max(map(len, members.values())) < 160
    met = {(a, b) for m in members.values() for a in m for b in m if a < b}
    assert len(met) == 600 * 599 // 2


def test_large_buckets_link_as_small_ones():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (3, 10), dtype=np.uint64)
    prints = np.repeat(base, 60, axis=0)
    prints[:, 1] ^= np.uint64(1) << rng.integers(0, 64, 180).astype(np.uint64)
    keys = np.zeros(180, np.int64)
    members, centres = simhash._partition_links(keys, prints, 96)
    assert len(members) == 177 and all(a // 60 == b // 60 for a, b in zip(members, centres, strict=True))
    members, centres = simhash._partition_links(np.arange(180) // 30, prints, 96)
    assert {a // 30 == b // 30 for a, b in zip(members, centres, strict=True)} == {True} and len(set(members)) == 174


def test_long_gray_index_finds_the_links_of_brute_force():
    """Codes of six lanes in buckets of many sizes; some pairs differ in one lane only, by more than its usual share."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (60, 6), dtype=np.uint64)
    prints = base[rng.integers(0, 60, 900)].copy()
    for row in prints:
        for bit in rng.choice(384, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    buckets = np.sort(rng.choice([3, 5, 7, 8, 9], 900, p=[0.6, 0.3, 0.08, 0.01, 0.01]))[rng.permutation(900)]
    prints[1], buckets[:2] = prints[0], 11
    prints[1, 0] ^= np.uint64((1 << 30) - 1)  # 30 bits, all in the first lane
    for limit in (0, 30, 50, 86):
        apart = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2, dtype=np.int64)
        near = (apart <= limit) & (buckets[:, None] == buckets[None, :])
        want = np.arange(900)
        while ((least := np.where(near, want[None, :], 900).min(axis=1)) != want).any():
            want = least
        got = np.arange(900)
        members, centres = simhash._partition_links(buckets, prints, limit)
        got[members] = centres
        groups = lambda x: {frozenset(np.flatnonzero(x == k).tolist()) for k in np.unique(x)}
        assert groups(got) == groups(want)
        assert (got[0] == got[1]) == (limit >= 30)
    assert simhash._partition_links(buckets[:0], prints[:0], 3)[0].size == 0


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = [(order[k], order[k + 1]) for k in range(299)] + [(1000, 1001), (5, 5)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert found == {k: 0 for k in range(1, 300)} | {1001: 1000}


# Substring dedup


def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for i in range(k, k + window)}
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def test_substring_dedup(spark, corpus, rows):
    found = {r["doc_id"]: (r["text"], r["n_words"], r["n_removed"]) for r in substring.drop_repeats(corpus).collect()}
    ids = sorted(rows)
    assert [found[i] for i in ids] == brute_repeats([rows[i] for i in ids], 35)


def test_substring_dedup_small_vocabulary(spark):
    """Few words, so that windows repeat at every distance, within and across documents."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        words = [rng.choice("ab") if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 120))]
        a = rng.randrange(0, 40)
        words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.randrange(10, 60)]
        texts.append(rng.choice(["\n", " ", "\t "]).join(words))
    texts += [None, "", "same " * 50, "same " * 36, "same " * 35]
    found = substring.drop_repeats(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r["text"], r["n_words"], r["n_removed"]) for r in found] == brute_repeats(texts, 35)


@pytest.mark.parametrize("size", [64, 400, 1024, 4096])
def test_words_that_cancel_in_polynomials_have_their_own_hashes(spark, size):
    """A Thue-Morse word and its complement: equal polynomials modulo 2**64 from 1,024 letters on."""
    bits = [k.bit_count() % 2 for k in range(size)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    words = Words(pa.array([a, b]))
    assert len(set(words.hashes.tolist())) == 2 and len({int(words.runs(np.array([k]), np.array([k + 1]), 1)[0]) for k in (0, 1)}) == 2
    if size == 1024:
        shared = " ".join(f"s{k}" for k in range(34))
        docs = spark.createDataFrame([(1, f"{shared} {a}"), (2, f"{shared} {b}")], "doc_id bigint, text string")
        assert [r["n_removed"] for r in substring.drop_repeats(docs).collect()] == [0, 0]


def test_substring_edges(spark):
    docs = docs_of(spark, [(d, t, "k") for d, t in EDGES], "doc_id bigint, text string, n_words string")
    found = substring.drop_repeats(docs).collect()
    assert len(found) == len(EDGES) and {r["n_removed"] for r in found if r["doc_id"] in (6, 7)} == {3000}
    assert substring.drop_repeats(docs.limit(0)).count() == 0


# Language model


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 7), (1000, 1 << 40), (4000, 300), (20000, 20001)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        sequence = EliasFano(np.concatenate([EliasFano.encode(values, universe), np.arange(3, dtype=np.uint64)]))
        assert (sequence.get(np.arange(n)) == values).all() if n else sequence.n == 0
        asked = np.concatenate([values, rng.integers(0, universe, 500).astype(np.uint64)])
        at = sequence.find(asked)
        assert ((at >= 0) == np.isin(asked, values)).all() and (values[at[at >= 0]] == asked[at >= 0]).all()


def test_elias_fano_selects_once_a_search(monkeypatch):
    """Long and short buckets, in one word and over many: the end of a bucket follows from its start, but for the few that leave the word."""
    rng = np.random.default_rng(9)
    values = np.sort(np.concatenate([rng.integers(0, 1 << 40, 20_000), rng.integers(1 << 30, (1 << 30) + 500, 600)]).astype(np.uint64))
    sequence = EliasFano(EliasFano.encode(values, 1 << 40))
    assert (sequence.get(np.arange(len(values))) == values).all()
    asked, seen, select = np.concatenate([values, rng.integers(0, 1 << 40, 20_000).astype(np.uint64)]), [], eliasfano._select_in_word
    monkeypatch.setattr(eliasfano, "_select_in_word", lambda word, rank: (seen.append(len(word)), select(word, rank))[1])
    at = sequence.find(asked)
    assert ((at >= 0) == np.isin(asked, values)).all() and (values[at[at >= 0]] == asked[at >= 0]).all()
    assert sum(seen) < 1.2 * len(asked)


def test_select_in_word():
    rng = np.random.default_rng(10)
    words = np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64) | np.uint64(1 << 63), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64)])
    for word in words:
        ones = [k for k in range(64) if int(word) >> k & 1]
        assert eliasfano._select_in_word(np.full(len(ones), word), np.arange(len(ones))).tolist() == ones


def tokens_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def test_scores(spark, corpus, rows):
    out = {r["doc_id"]: r for r in languagemodel.train_and_score(corpus).collect()}
    train = collections.Counter(t for i, x in rows.items() if zlib.crc32(str(i).encode()) % 10 for t in tokens_of(x))
    total, vocabulary = sum(train.values()), len(train)
    for i, text in rows.items():
        own = tokens_of(text)
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (vocabulary + 1))) for t in own)
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(train[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)  # both negative: the model is better


def test_model_is_a_distribution(spark):
    """The probabilities of all next words after a context, the unknown one included, sum to one at most."""
    rng = random.Random(5)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.3)), 30)}" for _ in range(40)) for _ in range(80)]
    model = languagemodel.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    vocabulary = sorted({w for t in texts for w in t.split()})
    asked = [(f"w0 {w}",) for w in [*vocabulary, "never"]] + [("w0",)]
    scored = {r["text"]: 10 ** r["score"] for r in languagemodel.score(spark.createDataFrame(asked, "text string"), model).collect()}
    tails = {r["text"]: 10 ** r["score"] for r in languagemodel.score(spark.createDataFrame([(w,) for w in [*vocabulary, "never"]], "text string"), model).collect()}
    heads = {r["text"]: r["score"] for r in languagemodel.score(spark.createDataFrame([("",)], "text string"), model).collect()}
    assert heads[""] < 0 and len(tails) == len(vocabulary) + 1
    # p(end | w) = p(w0 w end) / p(w0 w); the sum over w of p(w0 w end) is p(w0) times the chance of two words.
    first = 10 ** scored["w0"] if scored["w0"] < 0 else 1.0
    assert sum(v for k, v in scored.items() if k != "w0") < first


def test_scores_equal_a_brute_force_trigram_model(spark):
    """Words, pairs and triples, none left out, with the same discounts: every text's score, but for the rounding of codes."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") + str(min(int(rng.expovariate(0.5)), 9)) for _ in range(rng.randrange(60))) for _ in range(120)]
    model = languagemodel.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    grams = {n: collections.Counter() for n in (1, 2, 3)}
    for t in texts:
        own = [None, None, *tokens_of(t)]
        for k in range(2, len(own)):
            for n in grams:
                grams[n][tuple(own[k + 1 - n : k + 1])] += 1

    def discount(n):
        ones, twos = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    total, heads, types = sum(grams[1].values()), collections.defaultdict(int), collections.defaultdict(int)
    for n in (2, 3):
        for g, c in grams[n].items():
            heads[g[:-1]] += c
            types[g[:-1]] += 1

    def chance(g):
        if len(g) == 1:
            return (grams[1][g] - discount(1)) / total if g in grams[1] else discount(1) * len(grams[1]) / total
        lower, head = chance(g[1:]), g[:-1]
        if not heads[head]:
            return lower
        d = discount(len(g))
        return max(0.0, grams[len(g)][g] - d) / heads[head] + d * types[head] / heads[head] * lower

    asked = [*texts[:40], "a0 b0 never c1", "", "a0 a0 a0 a0"]
    found = {r["text"]: r["score"] for r in languagemodel.score(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()}
    for t in asked:
        own = [None, None, *tokens_of(t)]
        want = sum(math.log10(chance(tuple(own[k - 2 : k + 1]))) for k in range(2, len(own)))
        assert found[t] == pytest.approx(want, rel=0.02, abs=0.02)


def test_lm_edges(spark):
    out = languagemodel.train_and_score(docs_of(spark, EDGES)).collect()
    assert len(out) == len(EDGES) and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in out)
    assert languagemodel.train_and_score(docs_of(spark, EDGES).limit(0)).count() == 0
    alone = languagemodel.train_and_score(docs_of(spark, [(7, "a b")] if zlib.crc32(b"7") % 10 == 0 else [(k, "a b") for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0])).first()
    assert alone["train_tokens"] == 0 and alone["score"] == pytest.approx(alone["base_score"])


# Sharding


def test_sharding(spark, corpus, rows):
    out = sharding.assign_shards(corpus, 24).collect()
    assert len(out) == len(rows)
    load, slots, where = collections.Counter(), collections.defaultdict(list), {}
    for r in out:
        raw = rows[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert where.setdefault(raw, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.05 * sum(load.values()) / 24 + max(len(t.encode()) + 8 for t in rows.values())


def test_quotas_equal_the_plain_heap():
    import heapq

    rng = random.Random(2)
    classes = sorted(((float(rng.randrange(1, 5000)), rng.choice([1, 2, 7, 300])) for _ in range(60)), reverse=True)
    heap = [(0.0, s) for s in range(5)]
    for size, n in classes:
        for _ in range(n):
            at, shard = heap[0]
            heapq.heapreplace(heap, (at + size, shard))
    quotas = sharding.lpt_quotas(classes, 5)
    load = sum(np.array([size]) * q for (size, _), q in zip(classes, quotas, strict=True))
    assert [int(q.sum()) for q in quotas] == [n for _, n in classes]
    assert sorted(load) == pytest.approx(sorted(x for x, _ in heap), rel=1e-3)


def test_sharding_edges(spark):
    out = sharding.assign_shards(docs_of(spark, [(d, t, 3) for d, t in EDGES], "doc_id bigint, text string, shard int"), 3).collect()
    assert len(out) == len(EDGES) and len({(r["shard"], r["slot"]) for r in out}) == len(EDGES)
    by = {r["doc_id"]: r["shard"] for r in out}
    assert by[6] == by[7] and by[1] == by[2]
    assert sharding.assign_shards(docs_of(spark, EDGES).limit(0), 3).count() == 0


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = Scratch(spark, "test").keep(out, name.replace(" ", "-"))
        assert 0 < docs.count() <= before
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    check_packed(packed.collect(), 0)


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    text = " ".join(f"word{k % 41}{k % 7}" for k in range(120))
    others = [" ".join(f"own{d}x{(k * k) % 89}" for k in range(100)) for d in (4, 5)]
    rows_ = [(k, text, "en", "s", 1) for k in range(4)] + [(4 + k, t, "en", "s", 1) for k, t in enumerate(others)] + [(0, text, "en", "s", 1)]
    more = [" ".join(f"{d}y{(k * 3) % 71}" for k in range(90)) for d in "abc"]
    rows_ += [(9, more[0], "en", "s", 1), (9, more[1], None, None, None), (None, more[2], "en", "s", 1), (None, text, "en", "s", 1), (9, more[0], "fr", "s", 1)]
    docs = docs_of(spark, rows_, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == [0, 4, 5, 9, 9, None]


def test_hinted_rows_hold_all_keys(spark):
    """Keys of another type, null and repeated ones: none is missed, and few others pass."""
    rows_ = docs_of(spark, [(k, "t") for k in range(5000)] + [(None, "n")])
    keys = spark.createDataFrame([(k,) for k in range(0, 5000, 10)] + [(0,), (None,)], "doc_id int")
    found = {r["doc_id"]: r["_maybe"] for r in hinted(rows_, keys, ["doc_id"]).collect()}
    assert len(found) == 5001 and all(found[k] for k in range(0, 5000, 10)) and found[None]
    assert sum(found.values()) < 520
    assert not any(r["_maybe"] for r in hinted(rows_, keys.limit(0), ["doc_id"]).collect())


def test_pipeline_shuffles_few_texts(spark):
    """Bands and near dedup where no table is small enough for a broadcast: most texts stay in the task that reads them, little stays on disk."""
    import corpus_pipeline

    rng = random.Random(14)
    rows_ = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)), "en", "s", 1) for k in range(200)]
    rows_ += [(1000 + r[0], *r[1:]) for r in rows_[:5]] + rows_[:3]
    docs = Scratch(spark, "test").keep(docs_of(spark, rows_, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "docs")
    labels = docs.selectExpr("doc_id", "int(doc_id % 20 = 0) AS quality").distinct()
    size, context, folder = sum(len(r[1]) for r in rows_), spark.sparkContext._jsc.sc(), Path(shared_folder(spark).removeprefix("file:"))

    def cost():
        """Bytes shuffled so far, and bytes in the shared folder."""
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return np.array([sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size())), sum(f.stat().st_size for f in folder.rglob("*.parquet"))])

    before = cost()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bands = quality.sample_bands(docs, labels)
        after_bands = cost()
        kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
        after = cost()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(bands) <= {"", "en"} and kept == list(range(200))
    assert after_bands[0] - before[0] < size / 50
    assert after[0] - after_bands[0] < size / 2 and after[1] - before[1] < size / 50


def test_oracle_of_line_dedup(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r[1:] for r in db.execute(linededup.ORACLE_SQL).fetchall()}
    found = linededup.drop_common_lines(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in found} == want
