"""Quality rules: tokeniser fertility with rejection bands per language.

Public vocabularies measure each whole text:

* characters per token of the 50k byte-level BPE,
* the share of byte-fallback tokens of the 32k piece vocabulary,
* the entropy (bits) of the document's own token distribution.

Symbol noise and block capitals break into many short tokens, text in a script
or encoding the vocabulary never saw falls back to bytes, and repetition or a
poor vocabulary lowers the entropy that a text of its length should have. A
band per language holds the values that good text shows; a document outside any
band is rejected.

Bands are fitted on all labelled good rows. Their quantiles are exact: cells of
values are counted, and those that hold a wanted rank are cut finer, so that no
value is collected but the few that stand there. Entropy grows with length, so
its lower band is kept per power of two of the token count. A language without
enough labelled rows, or a null one, uses the band of all languages together;
without labels there is no band and only the base rule decides.

Defined cases: null or empty text has no words, zero measures and fails the
base rule; repeated rows are judged alike; extra columns stay as they are, but
for those that have the name of a result, which it replaces.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, hinted, release, shielded
from .tokens import byte_bpe, piece_chars, piece_counts

#: Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Least labelled rows of a language, or of a length class, for a band of its own.
MIN_ROWS = 40
#: Fraction bits of the cells that values are counted in, round by round; the last round counts the values themselves.
CELL_BITS = (8, 16, 24, 32)
#: Tokens at which the band of characters per token is twice as wide: short texts vary more.
SHORT = 80

_SYMBOL_BYTES = [ord(c) for c in SYMBOLS]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated 3-word windows)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() splits at ASCII white space only
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    same_lines = len(lines) - len(set(lines))
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(distinct := Counter(windows)) < len(windows):
            end = 0  # words before it are counted
            for k, window in enumerate(windows):
                if distinct[window] > 1:
                    repeated += k + 3 - max(end, k)
                    end = k + 3
    return len(words), chars, symbols, same_lines, repeated


def fertility(text: str | None, folder: str | None = None) -> tuple[int, float, float, float]:
    """(tokens, characters per token, byte-fallback share, token entropy in bits)."""
    if not text:
        return 0, 0.0, 0.0, 0.0
    ids = byte_bpe(folder).encode_to_numpy(text, allowed_special="all")
    n = len(ids)
    share = np.unique(ids, return_counts=True)[1] / n
    entropy = float(-(share * np.log2(share)).sum())
    fallback = 0.0
    if not piece_chars(folder).issuperset(text):  # else no character falls back, line breaks and tabs included, and the share is zero
        tokens, of_bytes = piece_counts(folder).count(text)
        fallback = of_bytes / max(1, tokens)
    return n, len(text) / n, fallback, max(0.0, entropy)


def measure(docs: DataFrame, text: str = "text", folder: str | None = None, base: bool = True) -> DataFrame:
    """Add the base counts (unless ``base`` is false) and the fertility measures to ``docs``."""
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if base else []
    measured = ["n_tokens", "chars_per_token", "fallback_share", "token_entropy"]
    kinds = [pa.int64()] * len(counted) + [pa.int64()] + [pa.float64()] * 3
    spec = ",".join(f"{c}:bigint" for c in [*counted, "n_tokens"]) + "," + ",".join(f"{c}:double" for c in measured[1:])

    @F.arrow_udf(f"struct<{spec}>")
    def measures(texts: pa.Array) -> pa.Array:
        release()
        rows = []
        for t in texts:
            value = t.as_py()
            rows.append((base_counts(value) if base else ()) + fertility(value, folder))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*counted, *measured])

    inner, restore = shielded(docs, {"_text": text}, [*counted, *measured])
    return restore(inner.withColumn("_m", measures("_text")).select("*", "_m.*"))


@dataclass(frozen=True)
class Band:
    """What good text of one language shows."""

    chars_median: float
    chars_low: float
    chars_high: float
    fallback_high: float
    entropy_low: tuple[tuple[int, float], ...]  # (power of two of the token count, least entropy)


def _power() -> Column:
    """Column: the power of two of the token count."""
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def order_statistics(values: DataFrame, shares: list[float], least: int = 1) -> dict[tuple, tuple[int, list[float]]]:
    """{series: (rows, quantiles)} of (lang, kind, value) rows for the series of ``least`` rows or more; values are not negative.

    The quantiles are those of ``np.quantile``, exact over all rows. What comes back
    is counts: of a round's cells only those that hold a wanted rank are counted finer.
    """
    spark = values.sparkSession

    def counted(rows: DataFrame, cell: Column) -> dict[tuple, list[tuple]]:
        found = defaultdict(list)
        for r in rows.groupBy("lang", "kind", "base", cell.alias("cell")).count().collect():
            found[r["lang"], r["kind"], r["base"]].append((r["cell"], r["count"]))
        return found

    def cells(bits: int) -> Column:
        return F.floor(F.col("value") * float(1 << bits)).cast("bigint")

    first = counted(values.withColumn("base", F.lit(0).cast("bigint")), cells(CELL_BITS[0]))
    sizes = {(lang, kind): n for (lang, kind, _), own in first.items() if (n := sum(c for _, c in own)) >= least}
    # Per series and cell: the ranks that are looked for, and how many values lie before the cell.
    wanted = {(*series, 0): {k for q in shares for k in (math.floor((n - 1) * q), math.ceil((n - 1) * q))} for series, n in sizes.items()}
    before = dict.fromkeys(wanted, 0)
    at: dict[tuple, dict[int, float]] = defaultdict(dict)
    found, last = first, False
    for bits in [*CELL_BITS[1:], None, None]:
        inner: dict[tuple, set[int]] = {}
        start: dict[tuple, int] = {}
        for place, ranks in wanted.items():
            seen, todo = before[place], sorted(ranks)
            for cell, n in sorted(found[place]):
                while todo and todo[0] < seen + n:
                    rank = todo.pop(0)
                    if last:
                        at[place[:2]][rank] = cell
                    else:
                        key = (*place[:2], cell)
                        inner.setdefault(key, set()).add(rank)
                        start[key] = seen
                seen += n
        if last or not inner:
            break
        coarse = cells(CELL_BITS[CELL_BITS.index(bits) - 1] if bits else CELL_BITS[-1])
        asked = spark.createDataFrame(list(inner), "lang string, kind int, base bigint")
        within = values.withColumn("base", coarse).join(F.broadcast(asked), ["lang", "kind", "base"])
        found, wanted, before, last = counted(within, cells(bits) if bits else F.col("value")), inner, start, bits is None

    def quantile(series: tuple, q: float) -> float:
        place = (sizes[series] - 1) * q
        low, high = at[series][math.floor(place)], at[series][math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {series: (n, [quantile(series, q) for q in shares]) for series, n in sizes.items()}


def fit_bands(good: DataFrame, share: float = 0.002, margin: float = 0.15) -> dict[str, Band]:
    """Bands from all rows of ``good``: lang, n_tokens, chars_per_token, fallback_share, token_entropy.

    The key "" holds the band of all languages together. A limit is a quantile moved
    out by a part of its distance from the median. ``good`` is read several times.
    """
    langs = F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("lang", F.lit(""))))).alias("lang")
    measures = good.select(langs, "chars_per_token", "token_entropy", _power().alias("power"))
    series = measures.selectExpr("lang", "stack(2, -1, chars_per_token, power, token_entropy) AS (kind, value)")
    found = order_statistics(series, [share, 0.5, 1 - share], MIN_ROWS)
    fallback = {r["lang"]: r["most"] for r in good.select(langs, "fallback_share").groupBy("lang").agg(F.max("fallback_share").alias("most")).collect()}
    bands = {}
    for (lang, kind), (_, (low, median, high)) in sorted(found.items()):
        if kind == -1:
            lows = [(p, a - margin * (b - a)) for (own, p), (_, (a, b, _)) in sorted(found.items()) if own == lang and p >= 0]
            bands[lang] = Band(median, low - margin * (median - low), high + margin * (high - median), max(0.02, 2 * fallback[lang]), tuple(lows))
    return bands


def labelled_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a label calls good."""
    return docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")


def sample_bands(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> dict[str, Band]:
    """Bands of all labelled good rows of ``docs``, which are measured for it and not kept.

    Texts are neither shuffled nor written: those whose id may be labelled good are
    measured where they are read, the exact join meets measures only.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    asked = hinted(docs.select("doc_id", "text", "lang"), labels.where("quality = 1").select("doc_id"), ["doc_id"]).where("_maybe").drop("_maybe")
    measured = scratch.keep(measure(asked, folder=folder).where(f"n_words >= {MIN_WORDS}").drop("text"), "measures")
    bands = fit_bands(scratch.keep(labelled_good(measured, labels), "good"))
    scratch.clear()
    return bands


def in_bands(bands: dict[str, Band]) -> Column:
    """Column: whether the measures lie within the band of the row's language."""
    if not bands:
        return F.lit(True)

    def within(band: Band) -> Column:
        wider = 1 + SHORT / F.greatest(F.col("n_tokens"), F.lit(1))
        away = F.col("chars_per_token") - band.chars_median
        ok = (away >= (band.chars_low - band.chars_median) * wider) & (away <= (band.chars_high - band.chars_median) * wider) & (F.col("fallback_share") <= band.fallback_high)
        if band.entropy_low:
            power = _power()
            low = F.lit(band.entropy_low[0][1] if band.entropy_low[0][0] <= math.log2(MIN_WORDS) else -1.0)
            for p, least in band.entropy_low:  # a longer text than any seen keeps the last band
                low = F.when(power >= p, least).otherwise(low)
            ok = ok & (F.col("token_entropy") >= low)
        return ok

    every = within(bands[""]) if "" in bands else F.lit(True)
    verdict = every
    for lang in sorted(set(bands) - {""}):
        verdict = F.when(F.col("lang") == lang, within(bands[lang])).otherwise(verdict)
    return F.coalesce(verdict, every)


def verdicts(measured: DataFrame, bands: dict[str, Band]) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured rows."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & in_bands(bands))


def judge(docs: DataFrame, bands: dict[str, Band], folder: str | None = None) -> DataFrame:
    """Add the counts, measures, ``base_failed`` and ``kept`` to ``docs``; a map without any exchange."""
    clash = [c for c in docs.columns if c.lower() in ("base_failed", "kept")]
    return verdicts(measure(docs.drop(*clash), folder=folder), bands)


def rate(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """Like ``judge`` by bands of all labelled good rows, each text measured once; ``text`` itself does not come back."""
    clash = [c for c in docs.columns if c.lower() in ("base_failed", "kept")]
    measured = Scratch(docs.sparkSession, "quality").keep(measure(docs.drop(*clash), folder=folder).drop("text"), "measures")
    good = labelled_good(measured, labels).where(f"n_words >= {MIN_WORDS}")
    return verdicts(measured, fit_bands(good))
