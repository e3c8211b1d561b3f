"""Benchmark decontamination: a BM25 index of the test items, queried by every passage.

The items make an inverted index: for each term its postings in item order, cut
into blocks that know their greatest impact. Documents are cut into overlapping
passages, long enough that any copy of an item lies within one, and each passage
is a query. Block-max WAND walks the postings and skips items, and whole blocks,
whose bounds cannot reach the threshold.

All items above the threshold are retrieved, not a top few. The threshold is the
item's own: its full BM25 score less the terms that a copy may lack and still
share enough shingles, so nothing that the verification would confirm is missed.
Impacts are divided by it, which makes one the threshold of all. A passage whose
terms' bounds do not add up to one is left without walking any posting; that test
runs over whole Arrow batches.

A retrieved item is confirmed when at least ``similarity`` of its five-word
shingles stand in the passage, and as large a part of the words of its question
(all but the last line or sentence) and of its answer, if it has one.

The index is broadcast in shards of at most ``SHARD_BYTES`` of item text, chosen
by the item's hash; a larger benchmark takes further passes over the documents.

Defined cases: null or empty texts and items match nothing; items under five words
are one shingle of all their words; repeated items each report their matches;
repeated rows of documents are judged alike; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import release
from .wordseq import NON_WORD, Words, text_chunks

SHINGLE = 5
SIMILARITY = 0.8
K1, B = 1.2, 0.75
#: Postings in a block.
BLOCK = 4
#: Entries of the index that the test before the walk looks at together.
RUNS_AT_ONCE = 1 << 20
#: Bytes of item text that one broadcast index may hold.
SHARD_BYTES = 16 << 20

_END = re.compile(r"[\n?.!](?=\s*\S)")


def parts(text: str) -> tuple[str, str]:
    """(question, answer): the last line or sentence is the answer; one alone is all question."""
    cuts = [m.end() for m in _END.finditer(text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts.cast(pa.large_string())), lanes=1, separators=NON_WORD)


def _shingles(words: Words, start: int, end: int, size: int = SHINGLE) -> np.ndarray:
    if end - start < size:
        return words.runs(np.array([start]), np.array([end])) if end > start else np.zeros(0, np.uint64)
    at = np.arange(start, end - size + 1)
    return words.runs(at, at + size)


class Index:
    """The inverted index of the items, with block maxima; impacts are parts of an item's threshold."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, shingle: int = SHINGLE) -> None:
        self.similarity, self.shingle = similarity, shingle
        self.ids, self.shingles, self.sizes, self.questions, self.answers = [], [], [], [], []
        words = _words(pa.array([t or "" for _, t in items], pa.large_string()))
        bags = []
        order = np.argsort(np.diff(words.first), kind="stable")  # items of like length share blocks, which keeps bounds tight
        for k in order.tolist():
            item, text = items[k]
            a, b = int(words.first[k]), int(words.first[k + 1])
            if a == b:
                continue
            question, answer = (_words(pa.array([p], pa.large_string())) for p in parts(text))
            self.ids.append(item)
            self.sizes.append(b - a)
            self.shingles.append(np.unique(_shingles(words, a, b, shingle)))
            self.questions.append(np.unique(question.hashes))
            self.answers.append(np.unique(answer.hashes))
            bags.append(np.unique(words.hashes[a:b], return_counts=True))
        #: Words that a passage advances by; it is twice as long.
        self.stride = int(1.25 * max(self.sizes, default=1)) + shingle
        n, mean = len(bags), np.mean(self.sizes) if bags else 1.0
        self.terms, where = np.unique(np.concatenate([t for t, _ in bags] or [np.zeros(0, np.uint64)]), return_inverse=True)
        frequency = np.bincount(where, minlength=len(self.terms))
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        at = 0
        for k, (terms, counts) in enumerate(bags):
            own = where[at : at + len(terms)]
            at += len(terms)
            weight = idf[own] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * self.sizes[k] / mean))
            spare = int((1 - similarity) * len(self.shingles[k]) + 1e-9)  # each term lacking costs a shingle at least
            threshold = np.sort(weight)[: max(1, len(weight) - spare)].sum() * (1 - 1e-9)
            for t, w in zip(own.tolist(), (weight / threshold).tolist(), strict=True):
                postings[t].append((k, w))
        self.items = [np.array([k for k, _ in p], np.int64) for p in postings]
        self.impacts = [np.array([w for _, w in p]) for p in postings]
        self.block_max = [[float(w[c : c + BLOCK].max()) for c in range(0, len(w), BLOCK)] for w in self.impacts]
        self.block_end = [[int(i[min(c + BLOCK, len(i)) - 1]) for c in range(0, len(i), BLOCK)] for i in self.items]
        self.bound = np.array([max(b) for b in self.block_max])
        #: Greatest impact of each term on the runs of ``BLOCK`` items that it occurs in, one term after another.
        runs, ceilings = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for own, weights in zip(self.items, self.impacts, strict=True):
            first = np.flatnonzero(np.diff(own // BLOCK, prepend=-1))
            runs.append(own[first] // BLOCK)
            ceilings.append((np.maximum.reduceat(weights, first) * (1 + 1e-6)).astype(np.float32))
        self.runs, self.ceilings = np.concatenate(runs), np.concatenate(ceilings)
        self.run_start = np.cumsum([len(r) for r in runs])

    def above(self, terms: list[int]) -> list[int]:
        """Items whose normalised score by these terms reaches one: block-max WAND."""
        found = []
        lists = [[int(self.items[t][0]), t, 0] for t in terms]  # current item, term, position
        while True:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(lists):
                total += self.bound[t]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # The blocks that would hold the pivot's item, and where the first of them ends.
            total, end = 0.0, 1 << 62
            for _, t, at in lists[: pivot + 1]:
                b = at // BLOCK
                ends = self.block_end[t]
                while b < len(ends) and ends[b] < item:
                    b += 1
                if b < len(ends):
                    total += self.block_max[t][b]
                    end = min(end, ends[b])
            if total < 1:  # no item up to the end of these blocks can reach the threshold
                target = end + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
                target = max(target, item + 1)
                lists = self._advance(lists, pivot + 1, target)
            elif lists[0][0] == item:
                score = sum(float(self.impacts[t][at]) for _, t, at in lists[: pivot + 1])
                if score >= 1:
                    found.append(item)
                lists = self._advance(lists, pivot + 1, item + 1)
            else:
                lists = self._advance(lists, pivot, item)

    def _advance(self, lists: list[list[int]], n: int, target: int) -> list[list[int]]:
        """Move the first ``n`` lists to their first item at or past ``target``; spent lists go."""
        out = []
        for entry in lists[:n]:
            item, t, at = entry
            if item < target:
                at += int(np.searchsorted(self.items[t][at:], target))
                if at >= len(self.items[t]):
                    continue
                entry = [int(self.items[t][at]), t, at]
            out.append(entry)
        return out + lists[n:]

    def _candidates(self, term: np.ndarray, known: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Passages with their distinct terms, where the bounds of some run of items add up to one."""
        before = np.concatenate([[0], np.cumsum(known)])
        own = term[known]  # a passage's known words lie together
        low, count = before[start], before[end] - before[start]
        passage = np.repeat(np.arange(len(start)), count)
        if not len(passage):
            return
        inner = np.arange(len(passage)) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique(passage * len(self.terms) + own[np.repeat(low, count) + inner])
        passage, term = np.divmod(pairs, len(self.terms))
        cuts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        likely = np.add.reduceat(self.bound[term], cuts) >= 1 - 1e-6
        ends = np.concatenate([cuts[1:], [len(pairs)]])
        names = passage[cuts]
        chosen = np.flatnonzero(likely)
        # What the runs of items of a passage's terms take, in slices of bounded size; a passage over it alone goes to the walk.
        weight = np.add.reduceat(self.run_start[term + 1] - self.run_start[term], cuts)[chosen]
        slices = np.cumsum(weight) // RUNS_AT_ONCE
        for group in np.split(chosen, np.flatnonzero(np.diff(slices)) + 1) if len(chosen) else []:
            for k in group[self._reach(term, cuts, ends, group)].tolist():
                yield int(names[k]), term[cuts[k] : ends[k]].tolist()

    def _reach(self, term: np.ndarray, cuts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which passages of ``group`` have bounds that add up to one on some run of items."""

        def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        sizes = ends[group] - cuts[group]
        own = term[spread(cuts[group], sizes)]
        lengths = self.run_start[own + 1] - self.run_start[own]
        if int(lengths.sum()) > 2 * RUNS_AT_ONCE:
            return np.ones(len(group), bool)
        at = spread(self.run_start[own], lengths)
        blocks = int(self.runs.max()) + 1
        keys, where = np.unique(np.repeat(np.repeat(np.arange(len(group)), sizes), lengths) * blocks + self.runs[at], return_inverse=True)
        sums = np.bincount(where, self.ceilings[at], len(keys))
        out = np.zeros(len(group), bool)
        out[keys[sums >= 1 - 1e-4] // blocks] = True
        return out

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, list[dict]]]:
        """(row, matches) of the rows that share items."""
        words = _words(texts)
        if not len(words.starts) or not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        known = self.terms[at] == words.hashes
        counts = np.diff(words.first)
        passages = np.maximum(1, -(-counts // self.stride) - 1) * (counts > 0)
        doc = np.repeat(np.arange(words.n_docs), passages)
        start = words.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(passages) - passages, passages)) * self.stride
        end = np.minimum(start + 2 * self.stride, words.first[doc + 1])
        hits: dict[int, dict[int, dict]] = {}
        for p, terms in self._candidates(at, known, start, end):
            a, b = int(start[p]), int(end[p])
            for k in self.above(terms):
                here = _shingles(words, a, b, min(self.shingle, self.sizes[k]))
                share = float(np.isin(self.shingles[k], here).mean())
                if share < self.similarity:
                    continue
                own = words.hashes[a:b]
                question = float(np.isin(self.questions[k], own).mean()) if len(self.questions[k]) else 1.0
                if question < self.similarity:
                    continue
                answer = float(np.isin(self.answers[k], own).mean()) if len(self.answers[k]) else 1.0
                if answer < self.similarity:
                    continue
                d = int(doc[p])
                best = hits.setdefault(d, {}).get(k)
                if best is None or best["overlap"] < share:
                    hits[d][k] = {"item_id": self.ids[k], "overlap": share, "question_overlap": question, "answer_overlap": answer, "start_word": a - int(words.first[d])}
        for d, own in hits.items():
            yield d, [own[k] for k in sorted(own)]


MATCH = "struct<item_id:{},overlap:double,question_overlap:double,answer_overlap:double,start_word:bigint>"


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks", similarity: float = SIMILARITY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``into``: the array of confirmed items of each row of ``docs``; a map without any exchange.

    ``item_id`` keeps its type, a number or a string.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // (shard_bytes // 2)))  # half full on average, so that uneven hashing stays in bounds
    name = benchmark.schema["item_id"].dataType
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(name)), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start_word", pa.int64())]))
    columns = []
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in own], similarity))
        columns.append(_lookup(index, kind, MATCH.format(name.simpleString()))(F.col(text)))
    return docs.withColumn(into, columns[0] if shards == 1 else F.concat(*columns))


def _lookup(index, kind: pa.DataType, match: str):
    def found(texts: pa.Array) -> pa.Array:
        release()
        rows: list[list[dict]] = [[] for _ in range(len(texts))]
        for a, b in text_chunks(texts):
            for row, matches in index.value.matches(texts.slice(a, b - a)):
                rows[a + row] = matches
        return pa.array(rows, kind)

    return F.arrow_udf(found, f"array<{match}>")
