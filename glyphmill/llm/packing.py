"""Best-fit packing by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` rows) decides how to
pack. A configuration is a multiset of lengths that fits one sequence; the linear
program covers every length's count with as few configurations as it can.
Multiplicative weights solve it: a length's price falls exponentially with the
covered share of its demand, a knapsack dynamic program prices configurations
(one table gives the best configuration through every length), and rounds keep
the covered shares of all lengths level. The fractions are rounded down to whole
sequences; best fit decreasing packs what that leaves.

Pieces are matched to places by their rank among the pieces of their length.
Tokenisation writes a rank within its task; offsets per (task, length) make it
global, so no length, however common, meets in one task. Token ids never move.

Defined cases: null or empty text is one piece holding the separator alone;
texts of any length are cut, the first piece taking the remainder; repeated rows
are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, release
from .tokens import byte_bpe

CAPACITY = 1024
#: The id that ends every document.
SEPARATOR = 2
#: Rounds of the linear program; each covers an equal share of every length's demand.
ROUNDS = 6
#: How fast a covered length's price falls.
RATE = 2.0
#: Pieces of a length that may stay uncovered in a round; the rounding takes care of them.
LEAST = 1e-6
#: Lengths that use one pricing before the knapsack table is computed anew.
REPRICE = 48


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, folder: str | None = None) -> DataFrame:
    """The pieces of all documents: key, piece, start, length and ids (little-endian 32-bit).

    ``_part`` and ``_rank`` number the pieces of each length within a task; they
    hold once the result is written.
    """
    kind = docs.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = byte_bpe(folder), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            release()
            rows, number, starts, lengths, ranks, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                whole = np.append(encoder.encode_to_numpy(value.as_py() or "", allowed_special="all"), separator).astype("<u4")
                for k, (start, length) in enumerate(cut(len(whole), capacity)):
                    rows.append(row)
                    number.append(k)
                    starts.append(start)
                    lengths.append(length)
                    ranks.append(seen[length])
                    seen[length] += 1
                    ids.append(whole[start : start + length].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(ranks, pa.int64())],
                [key, "piece", "start", "length", "ids", "_part", "_rank"],
            )

    return docs.select(key, text).mapInArrow(pieces, f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary, _part int, _rank bigint")


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value in each capacity, and the length taken last.

    ``values[s]`` is the price of length s, minus infinity where none may be taken.
    Equal values take the longer piece, which leaves short ones for later.
    """
    sizes = np.flatnonzero(np.isfinite(values))[::-1]
    own, rising = values[sizes], sizes[::-1]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = len(sizes) - int(np.searchsorted(rising, c, "right"))
        best[c] = best[c - 1]
        if k < len(sizes):
            got = best[c - sizes[k:]] + own[k:]
            at = int(got.argmax())
            if got[at] > best[c] + 1e-12:
                best[c], last[c] = got[at], sizes[k + at]
    return best, last


def traced(last: np.ndarray, room: int) -> dict[int, int]:
    """The configuration that the table found for ``room``."""
    counts: dict[int, int] = {}
    while room > 0:
        if size := int(last[room]):
            counts[size] = counts.get(size, 0) + 1
            room -= size
        else:
            room -= 1
    return counts


Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


def fractional(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE, reprice: int = REPRICE) -> dict[Configuration, float]:
    """An approximate solution of the linear program by multiplicative weights.

    Round r brings the covered share of every length to r / rounds. The price of
    a length is its size times exp(-rate * covered share); one that has reached
    the round's goal has none. Longest first, the best priced configuration through a
    length that lags is taken until the first of its lengths reaches the goal.
    """
    demand = histogram.astype(float)
    covered, sizes = np.zeros(capacity + 1), np.arange(capacity + 1)
    there = (histogram > 0) & (sizes > 0)
    taken: dict[Configuration, float] = {}
    for goal in (np.arange(rounds) + 1) / rounds:
        stale = reprice
        for size in np.flatnonzero(there)[::-1].tolist():
            while (goal - covered[size]) * demand[size] > LEAST:
                if stale >= reprice:
                    open_ = there & ((goal - covered) * demand > LEAST)
                    _, last = price(np.where(open_, sizes / capacity * np.exp(-rate * covered), -np.inf), capacity)
                    stale = 0
                stale += 1
                counts = traced(last, capacity - size)
                counts[size] = counts.get(size, 0) + 1
                times = min((goal - covered[s]) * demand[s] / a for s, a in counts.items())
                if times <= LEAST / capacity:  # a length of it has reached the goal since the last pricing
                    stale = reprice
                    continue
                config = tuple(sorted(counts.items(), reverse=True))
                taken[config] = taken.get(config, 0.0) + times
                for s, a in counts.items():
                    covered[s] += a * times / demand[s]
                    if (goal - covered[s]) * demand[s] <= LEAST:
                        covered[s] = goal
                if covered[size] < goal:
                    stale = reprice
    return taken


def configurations(histogram: np.ndarray, capacity: int = CAPACITY) -> dict[Configuration, int]:
    """How many sequences to fill by each configuration: the program's solution, rounded.

    Fractions are rounded down; the pieces that this leaves (fewer than one
    sequence for each configuration) are packed by best fit decreasing.
    """
    left = histogram.astype(np.int64).copy()
    chosen: dict[Configuration, int] = {}

    def take(counts: dict[int, int], times: int) -> None:
        config = tuple(sorted(counts.items(), reverse=True))
        chosen[config] = chosen.get(config, 0) + times

    for config, share in fractional(histogram, capacity).items():
        if times := int(share + 1e-6):
            times = min([times, *(int(left[s]) // a for s, a in config)])
            if times:
                take(dict(config), times)
                for s, a in config:
                    left[s] -= a * times
    _best_fit(left, capacity, take)
    return chosen


def _best_fit(left: np.ndarray, capacity: int, take) -> None:
    """Pack what is left, largest first, each piece into the fullest sequence that has room."""
    open_bins: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = np.zeros(capacity + 1, np.int64)
    for size in range(capacity, 0, -1):
        for _ in range(int(left[size])):
            fit = np.flatnonzero(rooms[size:])
            if len(fit):
                room = size + int(fit[0])
                counts = open_bins[room].pop()
                rooms[room] -= 1
            else:
                room, counts = capacity, {}
            counts[size] = counts.get(size, 0) + 1
            open_bins[room - size].append(counts)
            rooms[room - size] += 1
    for bins in open_bins:
        for counts in bins:
            take(counts, 1)


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, chosen: dict[tuple[tuple[int, int], ...], int]) -> None:
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for config, times in chosen.items():
            offset = 0
            for size, copies in config:
                found.setdefault(size, []).append((ranks.get(size, 0), copies, sequence, offset))
                ranks[size] = ranks.get(size, 0) + copies * times
                offset += size * copies
            sequence += times
        self.sequences = sequence
        self.by_size = {size: np.array(rows, np.int64).T for size, rows in found.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                size = int(lengths[own[0]])
                first, copies, base, offset = self.by_size[size]
                at = np.searchsorted(first, ranks[own], "right") - 1
                nth = ranks[own] - first[at]
                sequences[own] = base[at] + nth // copies[at]
                offsets[own] = offset[at] + nth % copies[at] * size
        return sequences, offsets


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    spark = pieces.sparkSession
    tallies = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tallies.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(Places(configurations(histogram, capacity)))

    kept = [c for c in pieces.columns if c not in ("_part", "_rank", "sequence_id", "offset")]
    ranked = pieces.select(*kept, "_part", "_rank").join(offsets, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*kept, "_rank")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequences, offsets_ = places.value.of(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequences), pa.array(offsets_)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept)
    return ranked.mapInArrow(placed, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, key: str = "doc_id", folder: str | None = None, digest: bool = False) -> DataFrame:
    """Tokenise, cut and pack all documents; ``digest`` keeps a CRC-32 instead of the ids."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = tokenise(docs, key, folder=folder)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(scratch.keep(pieces, "pieces"), key)
