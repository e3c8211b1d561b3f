"""Line dedup: lines found in many documents are dropped from all of them.

Native plan, no Python on the executors:

1. explode every text into (position, key hash), the key being the trimmed and
   lower-cased line, hashed to 128 bits;
2. count distinct documents per hash: pairs (hash, document) are made distinct
   first, dealt by both, so one very common line never meets in one task;
3. join the hashes over the threshold back to the exploded lines, which gives
   the dropped positions; both sides are plain shuffled sides, so the runtime
   splits a skewed hash, or broadcasts the hashes where it finds them small;
4. gather each document's dropped positions and put the text together again from
   the positions that stay.

Only hashes and positions are shuffled in 1-3; texts move once, in 4.

Defined cases: a null or empty text is one empty line; keys under ``min_chars``
code points are never dropped; a text whose lines all go becomes empty; repeated
rows of one id count as one document and are all cleaned; null ids count as one
document; extra columns stay, whatever their names, but for ``n_lines`` and
``n_dropped``, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, ascii_lower, shielded


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` (before) and ``n_dropped``.

    Uses the columns ``doc_id`` and ``text``; the others pass through.
    """
    docs, restore = shielded(docs, {"doc_id": "doc_id", "text": "text"}, ["n_lines", "n_dropped"])
    whole = F.coalesce("text", F.lit(""))
    # A row is known by its id and a hash of its text: ids may repeat or be null.
    row = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(whole).alias("_sig"), whole.alias("_text"))
    lines = row.select("_id", "_sig", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    lines = lines.where(F.length("_key") >= min_chars).select("_id", "_sig", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))

    common = (
        lines.select("_h1", "_h2", "_id").distinct()
        .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") >= min_docs).select("_h1", "_h2")
    )
    # Written first, so that both sides of the join are plain shuffles: a line that most
    # documents have is then split among tasks.
    common = Scratch(docs.sparkSession, "lines").keep(common, "common")
    dropped = lines.join(common, ["_h1", "_h2"]).groupBy("_id", "_sig").agg(F.collect_set("_pos").alias("_gone"))

    keyed = docs.withColumn("_sig", F.xxhash64(whole))
    joined = keyed.join(dropped.withColumnRenamed("_sig", "_sig2"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sig") == F.col("_sig2")), "left")
    parts = F.split(whole, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), "_gone")  # hashed, so linear in the lines
    text = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda k: F.get("_parts", k)), "\n"))
    out = joined.withColumn("_parts", parts).withColumn("n_lines", F.size("_parts").cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"))
    return restore(out.withColumn("text", text))


#: DuckDB: one row per document, as the registered query returns it.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM d),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
