"""Substring dedup: suffixes partitioned by prefixes of variable length.

A word goes when a window of ``window`` words that covers it starts anywhere
else too. In the suffix tree of all documents such windows are the internal
nodes at depth ``window`` or more; the tree is never built in one place:

1. Only sampled suffixes enter the partitions. Every window names the smallest
   hash among its runs of ``prefix`` words (the leftmost of equals), so equal windows name
   the same run at the same place, and some 9 % of the positions stand for
   all windows: a sample's subtree is the run of windows that name it.
2. Suffixes are partitioned by their first ``prefix`` words. A prefix that starts
   one suffix only has no internal node and is left.
3. Where all suffixes of a prefix have the same context (their whole run of
   windows, ends included), the context is one maximal repeat, found without
   looking any deeper.
4. Elsewhere the prefix is lengthened to the whole context: contexts found twice
   or more are maximal repeats; one suffix for each context goes on, and its
   windows, the nodes at full depth, are counted among those of the others.

A node is named by a 128-bit hash of its words, so a group of any size is counted
by partial aggregates instead of meeting in one task, and joins that carry the
counts back are plain shuffled joins that the runtime splits on skew.

Texts are read as they stand; those that the second look at step 4 or the removal
need are shuffled compressed.

Defined cases: null or empty text has no words; texts under ``window`` words lose
nothing; repeated rows are each other's copies and lose all covered words; a word
run such as "x x x ..." longer than a window repeats itself and goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release
from .wordseq import Words, text_chunks

WINDOW = 35
PREFIX = 8
#: Starts of a run of windows are stored with their number in one long.
_PACK = 1 << 16


def sampled(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, prefix hash) of the sampled suffixes."""
    n = len(words.starts)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    places = np.arange(n - prefix + 1)
    hashes = words.runs(places, places + prefix)
    starts = np.arange(n - window + 1)
    doc = words.doc_of_words()
    whole = doc[starts] == doc[starts + window - 1]
    named = starts + np.lib.stride_tricks.sliding_window_view(hashes, window - prefix + 1).argmin(axis=1)
    starts, named = starts[whole], named[whole]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    last = np.concatenate([first[1:], [len(named)]]) - 1
    return named[first], starts[first], starts[last], hashes[named[first]]


def _suffixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(prefix, context, _rid, _sig, span) of all sampled suffixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for a, b in text_chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                words = Words(part.column(2), lanes=1)
                at, first, last, hashes = sampled(words, window, prefix)
                if not len(at):
                    continue
                doc = np.searchsorted(words.first, first, "right") - 1
                context = words.runs(first, last + window) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                span = (first - words.first[doc]) * _PACK + (last - first + 1)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(span)],
                    ["prefix", "context", "_rid", "_sig", "span"],
                )

    return docs.select("_rid", "_sig", "_text").mapInArrow(rows, "prefix bigint, context bigint, _rid bigint, _sig bigint, span bigint")


def _windows(picked: DataFrame, window: int) -> DataFrame:
    """(_w1, _w2, _rid, _sig, span) of every window of the picked suffixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            texts = _unpacked(batch.column(2))
            for a, b in text_chunks(texts):
                words = Words(texts.slice(a, b - a))
                starts, doc = _spread(batch.column(3).slice(a, b - a), words, 1)
                if not len(starts):
                    continue
                ends = starts + window
                span = (starts - words.first[doc]) * _PACK + 1
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.runs(starts, ends, lane).view(np.int64)) for lane in (0, 1)] + [batch.column(0).take(take), batch.column(1).take(take), pa.array(span)],
                    ["_w1", "_w2", "_rid", "_sig", "span"],
                )

    return picked.select("_rid", "_sig", "_packed", "_spans").mapInArrow(rows, "_w1 bigint, _w2 bigint, _rid bigint, _sig bigint, span bigint")


def _spread(spans: pa.Array, words: Words, more: int) -> tuple[np.ndarray, np.ndarray]:
    """Every position that the spans of each document name, and its document."""
    spans = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    counts = np.array([len(s) if s.is_valid else 0 for s in spans], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *(s.values.to_numpy() for s in spans if s.is_valid and len(s))])
    doc = np.repeat(np.arange(len(spans)), counts)
    first, length = flat // _PACK + words.first[doc], flat % _PACK + more - 1
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(first, length) + inner, np.repeat(doc, length)


def _packed(texts: pa.Array) -> pa.Array:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return pa.array((press.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts), pa.binary())


def _unpacked(column: pa.Array) -> pa.Array:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    return pa.array((open_.decompress(x.as_py()) for x in column), pa.large_binary()).cast(pa.large_string())


def drop_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with repeated words out of ``text``, plus ``n_words`` (before) and ``n_removed``.

    Uses ``doc_id`` and ``text``; the other columns pass through.
    """
    docs = docs.drop(*(c for c in ("n_words", "n_removed") if c in docs.columns))
    scratch = Scratch(docs.sparkSession, "substring")
    # A row is known by two hashes, so ids may repeat or be null.
    whole = F.coalesce("text", F.lit(""))
    named = docs.withColumn("_rid", F.xxhash64("doc_id", whole)).withColumn("_sig", F.xxhash64(whole))
    suffixes = _suffixes(named.select("_rid", "_sig", F.col("text").alias("_text")), window, prefix)

    groups = suffixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n"), (F.min("context") != F.max("context")).alias("_mixed")).where("_n > 1").select("prefix", "_mixed")
    # Written first, so that both sides of the join are plain shuffles: a prefix that many
    # suffixes start with is then split among tasks.
    groups = scratch.keep(groups, "groups")
    shared = scratch.keep(suffixes.join(groups, "prefix"), "shared")
    whole_groups = shared.where("not _mixed").select("_rid", "_sig", "span")

    mixed = shared.where("_mixed")
    contexts = scratch.keep(mixed.groupBy("prefix", "context").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_rid", "_sig", "span")).alias("_one")), "contexts")
    repeats = mixed.join(contexts.where("_n > 1").select("prefix", "context"), ["prefix", "context"]).select("_rid", "_sig", "span")

    press = F.arrow_udf(_packed, "binary")
    texts = named.select("_rid", "_sig", press("text").alias("_packed"))
    ones = contexts.select("_one.*").groupBy("_rid", "_sig").agg(F.collect_list("span").alias("_spans"))
    windows = scratch.keep(_windows(texts.join(ones, ["_rid", "_sig"]), window), "windows")
    twice = scratch.keep(windows.groupBy("_w1", "_w2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_w1", "_w2"), "twice")
    deep = windows.join(twice, ["_w1", "_w2"]).select("_rid", "_sig", "span")

    covered = whole_groups.union(repeats).union(deep).groupBy("_rid", "_sig").agg(F.collect_set("span").alias("_spans"))
    covered = scratch.keep(covered, "covered")

    @F.arrow_udf("struct<text:string,n_words:bigint,n_removed:bigint>")
    def removed(packed: pa.Array, spans: pa.Array) -> pa.Array:
        release()
        texts_, counts, gone = [], [], []
        texts = _unpacked(packed)
        for a, b in text_chunks(texts):
            words = Words(texts.slice(a, b - a), lanes=0)
            n = len(words.starts)
            own = spans.slice(a, b - a)
            sizes = np.array([len(s) if s.is_valid else 0 for s in own], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *(s.values.to_numpy() for s in own if s.is_valid and len(s))])
            first = flat // _PACK + words.first[np.repeat(np.arange(b - a), sizes)]
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, first + flat % _PACK + window - 1, -1)
            out = np.cumsum(edges[:-1]) > 0
            raw, starts, ends = words.raw.tobytes(), words.starts.tolist(), words.ends.tolist()
            for d in range(b - a):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                left = np.flatnonzero(~out[lo:hi]) + lo
                texts_.append(b" ".join([raw[starts[k] : ends[k]] for k in left.tolist()]))
                counts.append(hi - lo)
                gone.append(hi - lo - len(left))
        return pa.StructArray.from_arrays([pa.array(texts_, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_words", "n_removed"])

    others = [c for c in named.columns if c != "text"]
    joined = named.select(*others, press("text").alias("_packed")).join(covered, ["_rid", "_sig"], "left")
    done = joined.withColumn("_done", removed("_packed", "_spans"))
    return done.select(*(F.col("_done.text").alias("text") if c == "text" else F.col(c) for c in docs.columns), "_done.n_words", "_done.n_removed")
