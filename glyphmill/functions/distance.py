"""Optimal string alignment distance, exact and bounded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str, most: int) -> int | None:
    """Edits (adjacent swaps count one, no place edited twice) or None if over ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        if min(row) > most and min(rows[-1]) > most:
            return None
        rows = [rows[-1], row]
    return rows[-1][-1] if rows[-1][-1] <= most else None


def osa_distance(a: Column, b: Column, most: int) -> Column:
    """Column: the distance, null if over ``most``; the built-in Levenshtein distance sifts first."""

    def distances(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array((None if x is None or y is None else osa(x, y, most) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)), pa.int32())

    # An edit here is at most two there, so nothing within reach is sifted out.
    near = F.levenshtein(a, b, 2 * most) >= 0
    plain = F.levenshtein(a, b, 1)
    return F.when(plain.isin(0, 1), plain).when(near, F.arrow_udf(distances, "int")(a, b))


def deletions(word: Column, most: int) -> Column:
    """All strings left after deleting up to ``most`` characters; words within that distance share one."""
    found = F.array(word)
    for _ in range(most):
        shorter = F.flatten(F.transform(found, lambda w: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: k <= F.length(w)),
            lambda k: F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1)),
        )))
        found = F.array_distinct(F.concat(found, shorter))
    return found
