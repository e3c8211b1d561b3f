"""Bounded, ranked corrections: a similarity join and a window top-k.

Queries and candidates within k edits of each other share a string that deletes
up to k characters from either, so candidate pairs come from an equi-join. The
bounds on work are those of a walk over the candidates in order: a query stops
at the candidate past ``max_candidates``, or at the one whose matrix would
overrun ``max_cells``. What a candidate costs depends on its length and the
query's only, so the stop is computed once for each query length, by sums over
blocks of candidates and a running sum within the block where it falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import deletions, osa_distance
from ..functions.unicode import LOWERCASE, UPPERCASE, lower
from ..model import SuggestOptions

#: How a search ended.
COMPLETE, CANDIDATES, BUDGET, TOO_LONG = "complete", "candidate limit reached", "edit-distance budget reached", "query exceeds the scalar limit"


def ordered_candidates(candidates: DataFrame, options: SuggestOptions) -> DataFrame:
    """(word, frequency, suggestable, low, size, pos): candidates in source and byte order, from one.

    Ranks are taken in blocks by the first two characters, plus the sizes of the
    blocks before, so no task sorts them all.
    """
    have = candidates.columns
    base = candidates.select(
        "word",
        (F.nullif(F.col("frequency").cast("decimal(20,0)"), F.lit(0)) if "frequency" in have else F.lit(None).cast("decimal(20,0)")).alias("frequency"),
        (F.col("suggestable") if "suggestable" in have else F.lit(True)).alias("suggestable"),
        (F.col("source_ord") if "source_ord" in have else F.lit(0)).alias("source_ord"),
    )
    base = base.withColumn("_block", F.substring("word", 1, 2)).withColumn("low", lower(F.col("word"))).withColumn("size", F.length("low"))
    sizes = base.groupBy("source_ord", "_block").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each block: the distinct pairs of first characters.
    before = Window.orderBy("source_ord", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_ord", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("source_ord", "_block").orderBy("word")
    return base.withColumn("_rank", F.row_number().over(inner)).join(starts, ["source_ord", "_block"]).withColumn("pos", F.col("_rank") + F.col("_start"))


def cutoffs(lengths: DataFrame, ordered: DataFrame, options: SuggestOptions) -> DataFrame:
    """(query_size, stop, completeness): the first position that a query of a length does not score."""
    o = options
    charged = ordered.where(F.col("suggestable") & (F.col("size") <= o.max_scalars)).select("pos", "size")
    block = F.floor((F.col("pos") - 1) / 1024)
    by_size = charged.withColumn("block", block).groupBy("block", "size").agg(F.count(F.lit(1)).alias("n"))
    near = F.abs(F.col("query_size") - F.col("size")) <= o.max_distance
    cells = (F.col("query_size") + 1) * (F.col("size") + 1)
    # A query has at most ``max_scalars`` lengths, so this side is small.
    totals = by_size.join(F.broadcast(lengths), near).groupBy("query_size", "block").agg(F.sum(F.col("n") * cells).alias("cells"))
    run = Window.partitionBy("query_size").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = totals.withColumn("sum", F.sum("cells").over(run)).where(F.col("sum") > o.max_cells)
    falls = over.groupBy("query_size").agg(F.min_by(F.struct("block", (F.col("sum") - F.col("cells")).alias("spent")), "block").alias("f")).select("query_size", "f.*")
    inside = charged.withColumn("block", block).join(F.broadcast(falls), "block").where(near)
    step = Window.partitionBy("query_size").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = inside.withColumn("sum", F.sum(cells).over(step) + F.col("spent")).where(F.col("sum") > o.max_cells).groupBy("query_size").agg(F.min("pos").alias("budget_stop"))
    total = ordered.agg(F.max("pos").alias("total"))
    at = lengths.join(stops, "query_size", "left").crossJoin(total)
    limit = F.lit(o.max_candidates + 1).cast("long")
    budget = F.coalesce("budget_stop", F.lit(2**62))
    return at.select("query_size", F.least(limit, budget).alias("stop"), F.when(budget < limit, BUDGET).when(F.col("total") >= limit, CANDIDATES).otherwise(COMPLETE).alias("completeness"))


def display(candidate: Column, query: Column) -> Column:
    """The candidate in the query's casing: all upper, initial upper, or as it is."""
    first, rest = F.substring(candidate, 1, 1), F.substr(candidate, F.lit(2))
    return (
        F.when(query.rlike(f"^{UPPERCASE}+$"), F.upper(candidate))
        .when(query.rlike(f"^{UPPERCASE}{LOWERCASE}*$"), F.concat(F.upper(first), lower(rest)))
        .otherwise(candidate)
    )


def replaced(query: Column, rules: list[tuple[str, str, bool, bool]]) -> Column:
    """Array: what each replacement rule makes of a (lower-case) query, one site at a time."""
    sites = []
    for source, target, start, end in rules:
        source, target = source.lower(), target.lower()
        pieces = F.sequence(F.lit(1), F.greatest(F.length(query) - len(source) + 1, F.lit(1)))
        fits = _site(query, source, start, end)
        sites.append(F.transform(F.filter(pieces, fits), _replace(query, source, target)))
    return F.flatten(F.array(*sites)) if sites else F.array().cast("array<string>")


def _site(query: Column, source: str, start: bool, end: bool):
    def fits(k: Column) -> Column:
        ok = F.substr(query, k, F.lit(len(source))) == source
        if start:
            ok = ok & (k == 1)
        return ok & (k + len(source) - 1 == F.length(query)) if end else ok

    return fits


def _replace(query: Column, source: str, target: str):
    return lambda k: F.concat(F.substr(query, F.lit(1), k - 1), F.lit(target), F.substr(query, k + len(source)))


def neighbours(keyboard: str | None, maps: list[str]) -> list[tuple[str, str]]:
    """Pairs of characters that a keyboard layout or a group of look-alikes holds close, both ways."""
    pairs = set()
    for row in (keyboard or "").split("|"):
        pairs |= {*zip(row, row[1:], strict=False)}
    for group in maps:
        pairs |= {(a, b) for a in group for b in group if a != b}
    return sorted(pairs | {(b, a) for a, b in pairs})


def suggest(
    queries: DataFrame, candidates: DataFrame, options: SuggestOptions | None = None, replacements: list[tuple[str, str, bool, bool]] | None = None,
    keyboard: str | None = None, maps: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Corrections for the distinct words of ``queries`` (column ``word``).

    ``candidates``: word, optionally frequency, suggestable and source_ord. Returns
    (query, rank, word, distance, ranking_distance, frequency) and
    (query, completeness). Replacement hits cost nothing and have distance zero;
    that they cost nothing does not move the query's stop.
    """
    o = options or SuggestOptions()
    if o.max_distance > 3:
        raise ValueError("deletion neighbourhoods are built for up to three edits")
    asked = queries.select(F.col("word").alias("query")).distinct().withColumn("lq", lower(F.col("query"))).withColumn("query_size", F.length("lq"))
    short = asked.where(F.col("query_size") <= o.max_scalars)
    ordered = ordered_candidates(candidates, o)
    stops = cutoffs(short.select("query_size").distinct(), ordered, o)
    offered = ordered.where(F.col("suggestable") & (F.col("size") <= o.max_scalars))

    keys = short.select("query", "lq", "query_size", F.explode(deletions(F.col("lq"), o.max_distance)).alias("key"))
    known = offered.select("pos", "low", F.explode(deletions(F.col("low"), o.max_distance)).alias("key"))
    pairs = keys.join(known, "key").where(F.abs(F.col("query_size") - F.length("low")) <= o.max_distance).select("query", "pos").distinct()
    scored = pairs.join(offered, "pos").join(short, "query").withColumn("distance", osa_distance(F.col("lq"), F.col("low"), o.max_distance)).where("distance is not null")
    scored = scored.withColumn("exact", F.lit(False))
    if replacements:
        turned = short.select("query", F.explode(replaced(F.col("lq"), replacements)).alias("low")).distinct()
        hits = turned.join(offered, "low").join(short, "query").withColumn("distance", F.lit(0)).withColumn("exact", F.lit(True))
        scored = scored.unionByName(hits.select(*scored.columns)).groupBy("query", "pos", "lq", "query_size", "word", "low", "size", "frequency").agg(F.min("distance").alias("distance"))
    within = scored.join(stops, "query_size").where(F.col("pos") < F.col("stop"))

    ranking = F.col("distance")
    if close := neighbours(keyboard, maps or []):
        # One substitution: the only place where two texts of one length differ.
        k = F.array_position(F.zip_with(F.split("lq", ""), F.split("low", ""), lambda a, b: a != b), True)
        pair = F.concat(F.substr("lq", k.cast("int"), F.lit(1)), F.substr("low", k.cast("int"), F.lit(1)))
        one = (F.col("distance") == 1) & (F.length("lq") == F.length("low")) & (F.levenshtein("lq", "low") == 1)
        ranking = F.when(one & pair.isin([a + b for a, b in close]), 0).otherwise(F.col("distance"))
    shown = within.select("query", display(F.col("word"), F.col("query")).alias("word"), "distance", ranking.alias("ranking_distance"), "frequency")
    order = [F.col("ranking_distance"), F.col("distance"), F.col("frequency").desc_nulls_last(), F.col("word")]
    once = shown.withColumn("_n", F.row_number().over(Window.partitionBy("query", "word").orderBy(*order))).where("_n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= o.max_results)
    state = asked.join(stops, "query_size", "left").select("query", F.when(F.col("query_size") > o.max_scalars, TOO_LONG).otherwise(F.col("completeness")).alias("completeness"))
    return ranked.select("query", "rank", "word", "distance", "ranking_distance", "frequency"), state


def related_seeds(query: Column, candidate: Column, most: int) -> Column:
    """Whether a stem shares enough of its start or end with a query to be worth deriving from."""
    need = F.greatest(F.least(F.length(query), F.length(candidate)) - 2 * most, F.lit(0))
    same_start = F.substr(query, F.lit(1), need) == F.substr(candidate, F.lit(1), need)
    same_end = F.substr(query, F.length(query) - need + 1) == F.substr(candidate, F.length(candidate) - need + 1)
    return (need == 0) | same_start | same_end
