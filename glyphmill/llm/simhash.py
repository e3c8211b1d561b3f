"""SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint's bit is one if it is set in over half the hashes of the text's
word shingles. Texts with the same fingerprint are one class, so copies cost one
row however many there are. Two classes link when at most three bits differ.

Links are found among distinct fingerprints. Three differing bits leave at least
one of four 16-bit blocks equal, so each fingerprint goes to four buckets, one
for each (block, value). A task turns its fingerprints so that the shared block
comes first, sorts them by Gray rank and builds an index over them bottom up: a
node holds the bits that its members share (a mask) and their values (a
pattern). The index is joined with itself from the top: a pair of nodes
accumulates the differences of the bits both share and is pruned as a whole when
these exceed the limit, or when all members already hang together. What arrives
at the bottom is compared exactly. A task emits a spanning forest of its links,
at most one row for each fingerprint and block; the components of these rows are
the components of all links.

A bucket with more than ``bucket_rows`` fingerprints is dealt again by four
12-bit blocks of its other 48 bits (the same argument holds within it), and those
again by 9-bit blocks, so that a value that a third of all fingerprints share
does not meet in one task.

Defined cases: fewer words than a shingle make one shingle of the whole
sequence; no words (null or empty text) give fingerprint zero, which links like
any other; repeated rows fall into one class; null ids are left out of the
smallest id unless a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, Scratch, hinted, release
from .components import connected_components
from .wordseq import Words, mix, text_chunks

BITS = 64
SEED = 42
#: Differing bits up to which fingerprints link.
LIMIT = 3
#: Fingerprints that one bucket may hold before it is dealt again.
BUCKET_ROWS = 200_000
#: Children of an index node.
FANOUT = 8
#: Node pairs that are expanded at once.
FRONTIER = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[: len(words) - width + 1] - np.fromiter(map(len, words[: len(words) - width + 1]), np.int64) - 1).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        release()
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fingerprints(F.col(text)))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """A hierarchical index over distinct codes, and the links among them."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fanout = codes[self.order], fanout
        masks, patterns = np.full(len(codes), ~np.uint64(0)), self.codes
        self.levels = [(masks, patterns)]  # level 0: the codes, all bits shared
        while len(patterns) > 1:
            cuts = np.arange(0, len(patterns), fanout)
            both = np.bitwise_and.reduceat(patterns, cuts)
            none = np.bitwise_and.reduceat(~patterns, cuts)
            masks = (both | none) & np.bitwise_and.reduceat(masks, cuts)
            patterns = both & masks
            self.levels.append((masks, patterns))

    def components(self, limit: int = LIMIT, lead: int = 0) -> np.ndarray:
        """A label for each given code: codes that hang together by links have the same.

        A link is a pair that differs in at most ``limit`` bits; with ``lead``, only
        pairs whose first ``lead`` bits agree count.
        """
        n = len(self.codes)
        roots = np.arange(n)
        head = ~np.uint64(0) << np.uint64(BITS - lead) if lead else np.uint64(0)
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            if len(a) > FRONTIER:
                work += [(level, a[k : k + FRONTIER], b[k : k + FRONTIER]) for k in range(0, len(a), FRONTIER)][::-1]
                continue
            masks, patterns = self.levels[level]
            differ = (patterns[a] ^ patterns[b]) & masks[a] & masks[b]
            keep = (np.bitwise_count(differ) <= limit) & ((differ & head) == 0)
            if level == 0:
                keep &= a != b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                _join(roots, a, b)
                continue
            if level > 1 or len(a) > 64:  # a group that hangs together has nothing left to join
                span = self.fanout**level
                low, high = self._root_range(roots, a, span), self._root_range(roots, b, span)
                alive = ~((low[0] == low[1]) & (high[0] == high[1]) & (low[0] == high[0]))
                a, b = a[alive], b[alive]
            below = len(self.levels[level - 1][0])
            child = np.arange(self.fanout)
            left = (a[:, None] * self.fanout + child)[:, :, None]
            right = (b[:, None] * self.fanout + child)[:, None, :]
            left, right = np.broadcast_arrays(left, right)
            fits = (left <= right) & (left < below) & (right < below)
            work.append((level - 1, left[fits], right[fits]))
        labels = np.empty(n, np.int64)
        labels[self.order] = roots
        return labels

    @staticmethod
    def _root_range(roots: np.ndarray, nodes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest component among the members of nodes."""
        if span > 64:  # too wide to be worth the look
            return np.zeros(len(nodes), np.int64), np.ones(len(nodes), np.int64)
        distinct, back = np.unique(nodes, return_inverse=True)
        starts = distinct * span
        members = np.minimum(starts[:, None] + np.arange(span), len(roots) - 1)
        own = roots[members]
        return own.min(axis=1)[back], own.max(axis=1)[back]


def _join(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of pairs, in place."""
    while True:
        x, y = np.maximum(roots[a], roots[b]), np.minimum(roots[a], roots[b])
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        parent = np.arange(len(roots))
        parent[x[apart]] = y[apart]  # each component hooks onto a smaller one, the last named
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        roots[:] = parent[roots]


def _buckets(fps: DataFrame, bucket_rows: int) -> DataFrame:
    """(fp, code, lead, path, bucket): each fingerprint in its buckets.

    ``code`` is the fingerprint turned along ``path``, so that the ``lead`` bits
    that a bucket shares come first.
    """
    width = BITS // 4
    levels = []
    first = F.explode(F.array(*(F.lit(k) for k in range(4))))
    rows = fps.select("fp", first.alias("_k"))
    turned = F.when(F.col("_k") == 0, F.col("fp"))
    for k in range(1, 4):
        turned = turned.when(F.col("_k") == k, F.shiftleft("fp", width * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - width * k)))
    rows = rows.withColumn("code", turned.cast("long")).withColumn("lead", F.lit(width)).withColumn("path", F.col("_k"))
    rows = rows.withColumn("bucket", F.concat_ws(":", "_k", F.shiftrightunsigned("code", BITS - width)))
    lead = width
    while True:
        hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows).select("bucket")
        rest = BITS - lead
        if rest % 4 or lead >= 48 or hot.isEmpty():
            levels.append(rows)
            break
        levels.append(rows.join(hot, "bucket", "left_anti"))
        part = rest // 4
        # Within a hot bucket the pairs differ in the remaining bits only: turn those by a quarter each time.
        deeper = rows.join(hot, "bucket", "left_semi").select("fp", "code", "bucket", "path", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("_k"))
        low = F.col("code").bitwiseAND(F.lit((1 << rest) - 1))
        high = F.col("code").bitwiseAND(F.lit(-1 << rest))
        turned = F.when(F.col("_k") == 0, low)
        for k in range(1, 4):
            turned = turned.when(F.col("_k") == k, F.shiftleft(low, part * k).bitwiseAND(F.lit((1 << rest) - 1)).bitwiseOR(F.shiftrightunsigned(low, rest - part * k)))
        lead += part
        rows = deeper.withColumn("code", high.bitwiseOR(turned)).withColumn("lead", F.lit(lead)).withColumn("path", F.col("path") * 4 + F.col("_k"))
        rows = rows.withColumn("bucket", F.concat_ws(":", "bucket", "_k", F.shiftrightunsigned("code", BITS - lead)))
    wanted = ["fp", "code", "lead", "path", "bucket"]
    out = levels[0].select(*wanted)
    for level in levels[1:]:
        out = out.union(level.select(*wanted))
    return out


def link_forest(fps: DataFrame, limit: int = LIMIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): rows that span, in each bucket, the components of the distinct fingerprints ``fp``."""
    if limit > 3:
        raise ValueError("four blocks find at most three differing bits")
    spread = _buckets(fps, bucket_rows)
    # Buckets of one partition share an index: those turned the same way.
    spread = spread.repartition(F.col("bucket")).select("fp", "code", "lead", "path")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([*x]).to_numpy(zero_copy_only=False) for x in zip(*(b.columns for b in batches), strict=True)]
        if not columns:
            return
        fp, code, lead, path = columns
        for width in np.unique(lead):
            for way in np.unique(path[lead == width]):
                own = np.flatnonzero((lead == width) & (path == way))
                codes, first = np.unique(code[own].view(np.uint64), return_index=True)
                if len(codes) > 1:
                    yield _stars(fp[own][first], GrayIndex(codes).components(limit, int(width)))

    return spread.mapInArrow(linked, "a bigint, b bigint")


def _stars(names: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    """A row (member, smallest member) for each member but the smallest of every component."""
    order = np.lexsort((names, labels))
    names, labels = names[order], labels[order]
    first = np.concatenate([[True], labels[1:] != labels[:-1]])
    centre = names[first][np.cumsum(first) - 1]
    return pa.RecordBatch.from_arrays([pa.array(names[~first]), pa.array(centre[~first])], ["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, limit: int = LIMIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, fp, component, root, rid, sig): the smallest key that each row's links reach.

    ``root`` is one fingerprint that stands for the whole component; ``rid`` and
    ``sig`` are hashes that know the row again where keys repeat or are null.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    whole = F.coalesce(text, F.lit(""))
    hashed = docs.select(key, text, F.xxhash64(key, whole).alias("rid"), F.xxhash64(whole).alias("sig"))
    rows = scratch.keep(with_fingerprints(hashed, text, width).select(F.col(key).alias("_key"), "fp", "rid", "sig"), "rows")
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("_key").alias("_least")), "classes")
    roots = connected_components(link_forest(classes.select("fp"), limit, bucket_rows), scratch)
    # The smallest key of each component of linked classes, told to its members.
    member = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("_least").alias("component"))
    told = member.join(least, "root").select("fp", "component", "root")
    return rows.join(told, "fp").select(F.col("_key").alias(key), "fp", "component", "root", "rid", "sig")


# Looser similarity: long fingerprints.

#: 64-bit lanes of a long fingerprint, the bits of one band, and the lanes that candidates are compared by.
LANES, BAND_BITS, NEAR_LANES = 10, 12, 6
#: Standard deviations over the mean that candidates may differ by.
DEVIATIONS = 4
#: Node pairs of long codes that are expanded at once, and the lanes that are summed first.
LONG_FRONTIER, FIRST_LANES = 1 << 14, 3
#: Members above which a bucket is split into blocks that meet pair by pair.
HOT_BUCKET = 2_000
#: Shingles of one block of a component that is confirmed in blocks.
BLOCK_SHINGLES = 2_000_000
#: Rows, or shingles, that a task holds of whole buckets, or components, at once.
HELD_ROWS, HELD_SHINGLES = 400_000, 4_000_000


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[int, np.ndarray, np.ndarray]:
    """(texts, text of each shingle, hash of each shingle): the distinct word shingles of each text, sorted."""
    words = Words(texts, lanes=1, lower=True)
    counts = np.diff(words.first)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(words.n_docs), number)
    start = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    hashes = words.runs(start, np.minimum(start + width, words.first[doc + 1]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, bool)
    return words.n_docs, doc[new], hashes[new]


def long_fingerprints(texts: pa.Array, width: int = 5, lanes: int = LANES) -> np.ndarray:
    """(rows, lanes) of 64-bit words: the SimHash of each text's distinct word shingles, bit by bit over more hashes."""
    return _set_prints(*shingle_sets(texts, width), lanes)


def _set_prints(n: int, doc: np.ndarray, hashes: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros((n, lanes), np.uint64)
    if not len(doc):
        return out
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    half = np.diff(np.append(cuts, len(doc)))[:, None]
    for lane in range(lanes):
        bits = np.unpackbits(mix(hashes, 101 + lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        out[doc[cuts], lane] = np.packbits(2 * ones > half, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def differing_bits(similarity: float, bits: int, deviations: float = 1) -> int:
    """Bits in which shingle sets of that Jaccard similarity differ: the mean, and so many standard deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(share * bits + deviations * (share * (1 - share) * bits) ** 0.5)


class LongGrayIndex(GrayIndex):
    """The index over codes of several lanes, of which each lies in a bucket: links join codes of one bucket only."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray, fanout: int = FANOUT) -> None:
        ranks, odd = [], np.zeros(len(codes), np.uint64)
        for lane in codes.T:  # an odd number of ones before a lane turns its order round
            ranks.append(gray_rank(lane) ^ (np.uint64(0) - odd))
            odd = ranks[-1] & np.uint64(1)
        self.order, self.fanout = np.lexsort((*ranks[::-1], buckets)), fanout
        patterns = np.ascontiguousarray(codes[self.order].T)
        low = high = buckets[self.order]
        masks = np.broadcast_to(~np.uint64(0), patterns.shape)
        self.codes, self.levels = patterns, [(masks, patterns, low, high)]
        while patterns.shape[1] > 1:
            cuts = np.arange(0, patterns.shape[1], fanout)
            both, none = (np.bitwise_and.reduceat(x, cuts, axis=1) for x in (patterns, ~patterns))
            masks = (both | none) & np.bitwise_and.reduceat(masks, cuts, axis=1)
            patterns, low, high = both & masks, low[cuts], np.maximum.reduceat(high, cuts)
            self.levels.append((masks, patterns, low, high))

    def roots(self, limit: int) -> np.ndarray:
        """For each place of the order, one place that stands for its component."""
        roots = np.arange(self.codes.shape[1])
        child = np.arange(self.fanout)
        work = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            most = LONG_FRONTIER if level else LONG_FRONTIER * self.fanout**2
            if len(a) > most:
                work += [(level, a[k : k + most], b[k : k + most]) for k in range(0, len(a), most)][::-1]
                continue
            a, b = self._near(level, a, b, limit)
            if not len(a):
                continue
            if level == 0:
                _join(roots, a, b)
                continue
            span = self.fanout**level
            low, top = self._root_range(roots, a, span), self._root_range(roots, b, span)
            alive = ~((low[0] == low[1]) & (top[0] == top[1]) & (low[0] == top[0]))
            a, b = a[alive], b[alive]
            below = self.levels[level - 1][1].shape[1]
            left, right = np.broadcast_arrays((a[:, None] * self.fanout + child)[:, :, None], (b[:, None] * self.fanout + child)[:, None, :])
            fits = (left <= right) & (right < below) if level > 1 else (left < right) & (right < below)
            work.append((level - 1, left[fits], right[fits]))
        return roots

    def _near(self, level: int, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The node pairs that share a bucket and may hold a link: the bits that both fix differ in at most ``limit``."""
        masks, patterns, low, high = self.levels[level]
        meet = high[a] >= low[b]
        a, b = a[meet], b[meet]
        differ = np.zeros(len(a), np.int16)
        for lane, (mask, pattern) in enumerate(zip(masks, patterns, strict=True)):
            apart = pattern[a] ^ pattern[b]
            if level:
                apart &= mask[a] & mask[b]
            differ += np.bitwise_count(apart)
            if lane + 1 in (FIRST_LANES, len(patterns)):  # most pairs are over the limit after some lanes
                keep = differ <= limit
                a, b, differ = a[keep], b[keep], differ[keep]
        return a, b


def _partition_links(keys: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, centres): rows of one partition that hang together within a bucket."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = LongGrayIndex(prints, keys)
    roots = index.roots(limit)
    away = np.flatnonzero(roots != np.arange(len(roots)))
    return index.order[away], index.order[roots[away]]


def _dealt(bands: DataFrame, scratch: Scratch, hot_bucket: int) -> DataFrame:
    """``bands`` with every ``bucket`` of more than ``hot_bucket`` members split without losing a pair.

    The members of such a bucket are cut into blocks by a hash of the node, and each
    block meets each other, and itself, in a bucket of its own of some 2 * ``hot_bucket`` members.
    """
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_bucket)
    hot = scratch.keep(sizes.select("bucket", F.ceil(F.col("_n") / hot_bucket).cast("int").alias("_blocks")), "hot")
    if hot.isEmpty():
        return bands
    own, other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    split = bands.join(hot, "bucket").withColumn("_own", own).withColumn("_other", other)
    met = F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return bands.join(hot, "bucket", "left_anti").select("node", "fp", "bucket").union(split.select("node", "fp", met.alias("bucket")))


def band_keys(prints: np.ndarray) -> np.ndarray:
    """(rows, bands) of 64-bit keys: the place and value of each band of ``BAND_BITS`` bits."""
    rows, lanes = prints.shape
    bands = 64 * lanes // BAND_BITS
    bits = np.unpackbits(prints.view(np.uint8).reshape(rows, -1), axis=1, bitorder="little")[:, : bands * BAND_BITS].reshape(rows, bands, BAND_BITS)
    values = bits @ (1 << np.arange(BAND_BITS, dtype=np.int64))
    return (np.arange(bands, dtype=np.int64) << BAND_BITS) | values


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str, most: int, weight: str | None = None) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in tables of whole keys, of some ``most`` rows or sum of ``weight``; release follows each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += (pc.sum(batch.column(weight)).as_py() or 0) if weight else batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            release()
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum((pc.sum(b.column(weight)).as_py() or 0) if weight else b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _set_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A component label for each shingle set; sets of at least that Jaccard similarity are linked."""
    labels = np.full(len(sets), -1, np.int64)
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    seen = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    starts = np.cumsum(sizes) - sizes
    own = [ids[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    left = np.arange(len(sets))
    while len(left):
        seed, left = left[0], left[1:]
        labels[seed] = seed
        work = [seed]
        while work and len(left):
            at = work.pop()
            n = sizes[at]
            if not n:
                continue
            some = left[np.minimum(sizes[left], n) / np.maximum(sizes[left], n) >= similarity]
            if not len(some):
                continue
            seen[own[at]] = True
            both = np.add.reduceat(seen[np.concatenate([own[k] for k in some.tolist()])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            seen[own[at]] = False
            close = some[both / (sizes[some] + n - both) >= similarity]
            if len(close):
                labels[close] = seed
                work += close.tolist()
                left = left[labels[left] < 0]
    return labels


def _confirmed(sets: DataFrame, similarity: float, scratch: Scratch, block_shingles: int) -> DataFrame:
    """(a, b): rows that span the groups of exactly ``similarity`` within each candidate component.

    ``sets``: (node, root, shingles, n). A component of more than ``block_shingles``
    shingles is cut into blocks of which each meets each, so that a task holds two.
    """
    sizes = sets.groupBy("root").agg(F.sum("n").alias("_n"))
    large = scratch.keep(sizes.where(F.col("_n") > block_shingles).select("root", F.ceil(F.col("_n") / block_shingles).cast("int").alias("_blocks")), "large")
    met = sets.select("node", "root", "shingles", "n")
    if not large.isEmpty():
        own, other = F.pmod(F.xxhash64("node", F.lit(2)), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        split = met.join(large, "root").withColumn("_own", own).withColumn("_other", other)
        block = F.xxhash64("root", F.least("_own", "_other"), F.greatest("_own", "_other"))
        met = met.join(large, "root", "left_anti").select("node", "root", "shingles", "n").union(split.select("node", block.alias("root"), "shingles", "n"))
    met = met.repartition("root").sortWithinPartitions("root")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in _whole_keys(batches, "root", HELD_SHINGLES, "n"):
            node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            cuts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])).tolist()
            a, b = [], []
            for x, y in zip(cuts, [*cuts[1:], len(root)], strict=True):
                labels = _set_links(sets_[x:y], similarity)
                away = np.flatnonzero(labels != np.arange(y - x))
                a.append(node[x + away])
                b.append(node[x + labels[away]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return met.mapInArrow(linked, "a bigint, b bigint")


def similar_groups(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text", width: int = 5, lanes: int = LANES, hot_bucket: int = HOT_BUCKET, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, rid, sig, root): groups of texts that hang together by links of that Jaccard similarity of shingle sets.

    Fingerprints of 640 bits find candidates: the 53 bands of 12 bits are the
    buckets, of which a pair at 0.8 shares one with a chance of 99.96 %, a closer
    pair nearly always. A Gray-order hierarchical index over the buckets of a task
    finds the candidates: prints of one bucket that
    differ, in ``NEAR_LANES`` lanes, in no more bits than the threshold does,
    ``DEVIATIONS`` granted. A task emits at most one row for each print and band.
    Within the components of candidates, which hold every pair found and more, the
    shingle sets themselves are compared, so no link is below the similarity.
    A bucket of more than ``hot_bucket`` members, or a component of more than
    ``block_shingles`` shingles, is split into blocks, each compared with each;
    texts of equal shingle sets are one member. Of the shingles only those of
    candidates are shuffled, and they go once the links are known.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    whole = F.coalesce(text, F.lit(""))
    near = min(lanes, NEAR_LANES)
    limit = differing_bits(similarity, 64 * near, DEVIATIONS)
    kind = pa.struct([("fp", pa.binary()), ("shingles", pa.binary()), ("n", pa.int64())])

    @F.arrow_udf("struct<fp:binary,shingles:binary,n:bigint>")
    def prints(texts: pa.Array) -> pa.Array:
        release()
        out: list[dict] = []
        for a, b in text_chunks(texts):
            n, doc, hashes = shingle_sets(texts.slice(a, b - a), width)
            fps, ends = _set_prints(n, doc, hashes, lanes), np.searchsorted(doc, np.arange(n + 1)).tolist()
            out += [{"fp": fp.tobytes(), "shingles": hashes[x:y].tobytes(), "n": y - x} for fp, x, y in zip(fps, ends, ends[1:], strict=False)]
        return pa.array(out, kind)

    hashed = docs.select(F.col(key).alias("_key"), F.xxhash64(key, whole).alias("rid"), F.xxhash64(whole).alias("sig"), prints(F.col(text)).alias("_p"))
    read = scratch.keep(hashed.select("_key", "rid", "sig", "_p.*").withColumn("set", F.xxhash64("shingles", "fp")), "rows")
    rows = scratch.keep(read.select("_key", "rid", "sig", "set"), "members")
    # Equal sets are one class, known by the least row's hash.
    classes = scratch.keep(read.groupBy("set").agg(F.min("rid").alias("node"), F.first("fp").alias("fp")), "classes")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, lanes)
            if len(fps):
                keys = band_keys(fps)
                short = [row.tobytes() for row in np.ascontiguousarray(fps[:, :near])]
                times = pa.array(np.repeat(np.arange(len(fps)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(times), pa.array(short, pa.binary()).take(times), pa.array(keys.ravel())], ["node", "fp", "bucket"])

    bands = classes.select("node", "fp").mapInArrow(banded, "node bigint, fp binary, bucket bigint")
    banded_rows = scratch.keep(bands, "bands")
    dealt = _dealt(banded_rows, scratch, hot_bucket).repartition("bucket").sortWithinPartitions("bucket")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in _whole_keys(batches, "bucket", HELD_ROWS):
            node, bucket = table.column("node").to_numpy(), table.column("bucket").to_numpy()
            fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, near)
            members, centres = _partition_links(bucket, fp, limit)
            pairs = np.unique(np.stack([node[members], node[centres]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    candidates = connected_components(dealt.mapInArrow(linked, "a bigint, b bigint"), scratch)
    scratch.drop(banded_rows)
    # Every member of a component of two or more, the root included, with its set.
    within = candidates.union(candidates.select(F.col("root").alias("node"), "root").distinct())
    wanted = scratch.keep(classes.select("node", "set").join(within, "node"), "wanted")
    asked = hinted(read.select("set", F.col("rid").alias("node"), "shingles", "n"), wanted, ["set", "node"]).where("_maybe").drop("_maybe")
    sets = scratch.keep(asked.join(wanted, ["set", "node"]).dropDuplicates(["set", "node"]).select("node", "root", "shingles", "n"), "sets")
    scratch.drop(read)
    roots = connected_components(_confirmed(sets, similarity, scratch, block_shingles), scratch)
    told = classes.join(roots.withColumnRenamed("root", "_root"), "node", "left").select("set", F.coalesce("_root", "node").alias("root"))
    groups = Scratch(docs.sparkSession, "groups").keep(rows.join(told, "set").select(F.col("_key").alias(key), "rid", "sig", "root"), "groups")
    scratch.clear()
    return groups
