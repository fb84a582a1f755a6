"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash of its id. A source whose target is q whole copies and a rest takes each document q times
and once more those below a hash threshold. The threshold comes from nested histograms: words summed by source and
hash bucket show in which bucket the budget ends, and only that bucket is refined, down to single hashes. Nothing is
sorted; the documents are filtered by comparing hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import fresh, join_small, saved, table

#: Hash bits, and bits resolved by each of the two histograms; the rest is resolved inside one small bucket.
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """60 bits of the id's MD5; rows of one id share it, null counts as an empty id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """The sources with nth, their place from 0 in order of code points, null last: sorted by ranges, each range's first
    place being the number of sources before it. Only those sums, one for each partition, are gathered."""
    parts = saved(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("nth", F.col("before") + F.col("own")).drop("part", "own", "before")


def _targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(key, source_size, target) of (key, source, source_size): shares by weight, filled up to cap times the source's size.

    Each round fixes the sources whose share is over their most and shares the rest again; a few sums reach the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = saved(_ranked(sizes).select("key", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "weights")
    full, level, seen = F.lit(False), 0.0, -1
    while True:
        total = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("share"), F.count(F.when(full, 1)).alias("n")).first()
        if total.n == seen or not total.share:
            break
        seen, level = total.n, float(total["all"] - (total.fixed or 0)) / float(total.share)
        full = full | (F.lit(level) >= F.col("most") / F.col("weight"))
    return weighed.select("key", "source_size", F.when(full, F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _boundary(sums: DataFrame, by: str) -> DataFrame:
    """The first `by` of each source at which the words so far exceed its rest; `before`: the words up to it."""
    through = F.sum("n").over(W.partitionBy("key").orderBy(by))
    over = sums.withColumn("through", through).where(F.col("through") > F.col("rest"))
    return over.groupBy("key").agg(F.min(F.struct(by, "through", "n")).alias("at")).select("key", f"at.{by}", "at.through", (F.col("at.through") - F.col("at.n")).alias("before"))


def plan_mix(narrow: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Of (key, source, place, size): one row for each source, (key, source_size, target, whole, cut).

    A document is taken `whole` times, and once more if its place is below `cut`. The table has as many rows as there
    are sources; it is joined by broadcast only if `join_small` finds it small.
    """
    sizes = narrow.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = _targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = saved(targets, "targets")

    first = narrow.groupBy("key", F.shiftright("place", BITS - STEP).alias("b1")).agg(F.sum("size").alias("n"))
    first = _boundary(join_small(first, targets, ["key"]), "b1")
    first = saved(first.select("key", "b1", F.col("before").alias("below")), "first")

    inside = join_small(narrow, first, ["key"]).where(F.shiftright("place", BITS - STEP) == F.col("b1"))
    second = inside.groupBy("key", "below", F.shiftright("place", BITS - 2 * STEP).alias("b2")).agg(F.sum("size").alias("n"))
    rests = targets.select("key", "rest")
    second = join_small(second, rests, ["key"]).withColumn("rest", F.col("rest") - F.col("below"))
    second = _boundary(second, "b2").join(first, "key").select("key", "b2", (F.col("below") + F.col("before")).alias("below"))
    second = saved(second, "second")

    inside = join_small(narrow, second, ["key"]).where(F.shiftright("place", BITS - 2 * STEP) == F.col("b2"))
    last = inside.groupBy("key", "below", "place").agg(F.sum("size").alias("n"))
    last = join_small(last, rests, ["key"]).withColumn("rest", F.col("rest") - F.col("below"))
    last = _boundary(last, "place").join(second, "key").join(rests, "key")
    past, short = F.col("below") + F.col("through") - F.col("rest"), F.col("rest") - F.col("below") - F.col("before")
    last = last.select("key", (F.col("place") + F.when(past < short, 1).otherwise(0)).alias("cut"))
    return saved(targets.join(last, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "mix")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", source_key(F.col("source")).alias("key"), F.col("source").cast("string").alias("source"), place(F.col("doc_id")).alias("place"), words(F.col("text")).alias("size"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of documents (doc_id, text, source, ...), a row for each row.

    Null texts have size 0; a null source is a source of its own, last in order. Rows of one id go together. The last
    hash taken is the one that brings the source nearest to its target. Empty tables give empty ones, and a source
    without words has target 0. Other columns are not looked at.
    """
    narrow = saved(_narrow(docs), "sizes")
    out = join_small(narrow, plan_mix(narrow, weights, cap), ["key"])
    copies = F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with their own columns, whatever their names.

    Sizes, ties and repeated ids are as in `mix_sources`; documents of null text or of a source without words are taken
    whole times only, so a mix of nothing but empty texts is empty. An empty table gives an empty one.
    """
    plan = plan_mix(saved(_narrow(docs).drop("doc_id"), "sizes"), weights, cap)
    mix, key, copy = fresh(docs, "mix", "key", "copy")
    plan = saved(plan.select(F.struct("whole", "cut").alias(mix), F.col("key").alias(key)), "mix")
    keyed = join_small(docs.withColumn(key, source_key(F.col("source"))), plan, [key])
    copies = F.col(mix)["whole"] + F.when(place(F.col("doc_id")) < F.col(mix)["cut"], 1).otherwise(0)
    return keyed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS BIGINT) * 3 AS most FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS DOUBLE)
          / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE)
          >= CAST(most AS DOUBLE) / CAST(weight AS DOUBLE) AS full_up
  FROM w WINDOW b AS (ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN full_up THEN CAST(most AS DOUBLE) ELSE
    CAST(sum(source_size) OVER () - sum(CASE WHEN full_up THEN most ELSE 0 END) OVER () AS DOUBLE)
    / CAST(sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER () AS DOUBLE) * weight END AS target
  FROM f),
q AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM q),
p AS (SELECT source, place, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, place),
c AS (SELECT source, place, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY place) AS BIGINT) AS through FROM p),
e AS (
  SELECT c.source, min(c.place) AS place, arg_min(c.through, c.place) AS through, arg_min(c.through - c.n, c.place) AS before
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE c.through > r.rest GROUP BY c.source),
x AS (
  SELECT r.*, coalesce(e.place + CASE WHEN e.through - r.rest < r.rest - e.before THEN 1 ELSE 0 END, 0) AS cut
  FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, x.source_size, x.target, CAST(d.size * (x.whole + CASE WHEN d.place < x.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
