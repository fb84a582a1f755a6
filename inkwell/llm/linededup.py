"""Line dedup: overlapping windows of three lines that occurred before are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import fresh, saved, table

WINDOW = 3
#: Line characters that count as blank.
BLANK = r"^[\x20\x09-\x0D]*$"


def _windows(text: Column, size: int) -> Column:
    """Structs (pos, lines, h1, h2) of the windows over the text's non-blank lines; lines: their places in the text."""
    lines = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: ~s["x"].rlike(BLANK),
    )
    return F.transform(lines, lambda s, i: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(1), s["x"]).alias("b")))


def _occurrences(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, whole, pos, lines, h1, h2) of all windows."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("whole"), _windows(F.col("text"), size).alias("l")).where(F.size("l") >= size)
    of = lambda i, field: [F.element_at("l", (i + k).cast("int"))[field] for k in range(1, size + 1)]
    window = lambda i: F.struct(i.alias("pos"), F.array(*of(i, "i")).alias("lines"), F.xxhash64(*of(i, "a")).alias("h1"), F.xxhash64(*of(i, "b")).alias("h2"))
    each = F.transform(F.sequence(F.lit(0), F.size("l") - size), window)
    return hashed.select("doc_id", "whole", F.explode(each).alias("w")).select("doc_id", "whole", "w.*")


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents with later occurrences of repeated windows removed, plus n_lines and n_removed.

    Windows are `size` consecutive non-blank lines, compared by 128 hash bits. The first occurrence, by doc_id and then
    place, stays; every line that any later occurrence covers goes. Blank lines stay. Documents with fewer non-blank
    lines, null and empty texts stay as they are (n_lines 0 for null). Rows that repeat both doc_id and text count as
    one and get the same result. A document whose lines all go keeps its row, with its blank lines or an empty text.
    Further columns stay, whatever their names; n_lines and n_removed replace columns of those names.
    """
    seen = saved(_occurrences(docs, size), "windows")
    at = F.struct("doc_id", "whole", "pos")
    repeated = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    later = seen.join(repeated, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    gone_id, gone_whole, gone = fresh(docs, "gone_id", "gone_whole", "gone")
    places = later.groupBy(F.col("doc_id").alias(gone_id), F.col("whole").alias(gone_whole)).agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias(gone))

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    both = docs.join(places, docs["doc_id"].eqNullSafe(places[gone_id]) & (F.xxhash64(docs["text"]) == places[gone_whole]), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = {c: F.col(f"`{c}`") for c in names} | {"text": text}
    return both.select(*(out[c].alias(c) for c in names), n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
WITH l AS (
  SELECT d.doc_id, d.text, u.i, u.x FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(x, i)),
b AS (
  SELECT doc_id, text, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM (SELECT DISTINCT * FROM l) WHERE NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')),
w AS (
  SELECT doc_id, pos, [i, lead(i) OVER o, lead(i, 2) OVER o] AS lines, x || chr(10) || lead(x) OVER o || chr(10) || lead(x, 2) OVER o AS win
  FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT doc_id, lines, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w WHERE win IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(lines) AS i FROM r WHERE nth > 1),
k AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS n_removed, count(*) AS n_lines
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
