"""Target-distribution importance resampling over hashed word features.

Texts stay in their Arrow buffers: a lookup table classifies all bytes, differences of the classes give where words start
and end, and table-driven CRCs advance over all words of a buffer at once, a byte a step; those of word pairs go on from
their first word. Counts by bucket of the documents and of the target give each bucket a gain, a text's weight is the mean
gain of its features, and adding Gumbel noise to the weights turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import forget, fresh, row_groups, saved, table, utf8

#: Hash buckets, percent of the long enough documents that are drawn, words that make one long enough, seed of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of texts whose words are handled at once; runs of which so few are left are ended one by one.
CHUNK, FEW = 2 << 20, 4
#: Width of the score ranges whose counts give a first bound of the draw.
RANGE = 64
_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
IN_WORD = ((_byte >= 48) & (_byte <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_byte >= 128)


def _crc_table() -> np.ndarray:
    """The remainders of all bytes by the reversed polynomial of CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> 1), out >> 1)
    return out


CRC = _crc_table()


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after these runs of bytes, all runs at once; longer ones first, so that the unfinished are a prefix."""
    order = np.argsort(-length, kind="stable")
    now, at, left = state[order], start[order], length[order]
    shorter = -left
    step, n = 0, len(order)
    while True:
        n = int(np.searchsorted(shorter[:n], -step))  # runs of more than `step` bytes
        if n <= FEW:
            break
        now[:n] = CRC[(now[:n] ^ data[at[:n] + step]) & 0xFF] ^ (now[:n] >> 8)
        step += 1
    for k in range(n):
        rest = data[at[k] + step : at[k] + left[k]]
        now[k] = zlib.crc32(rest, int(now[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[list[tuple[int, int, int, bool]]]:
    """(row, from, to, whether its first word was counted before) in lists of about CHUNK bytes. A longer text is cut
    between words; each part but the first begins with the last word of the one before, for the pair over the cut."""
    held, size = [], 0
    for row, (a, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        again = False
        to = a
        while e - to > CHUNK:
            to = _next(data, to + CHUNK, e, False)  # the end of the word there
            held.append((row, a, to, again))
            yield held
            held, size = [], 0
            last = _last(data, a, to, True)
            if last >= 0:
                a, again = _last(data, a, last, False) + 1, True
            else:
                a, again = to, False
        held.append((row, a, e, again))
        size += e - a
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _next(data: np.ndarray, at: int, end: int, inside: bool) -> int:
    """The first byte from `at` that is inside or outside words; `end` if none is."""
    while at < end:
        found = np.flatnonzero(IN_WORD[data[at : min(at + 4096, end)]] == inside)
        if len(found):
            return at + int(found[0])
        at = min(at + 4096, end)
    return end


def _last(data: np.ndarray, start: int, end: int, inside: bool) -> int:
    """The last byte before `end` that is inside or outside words; one before `start` if none is."""
    while end > start:
        found = np.flatnonzero(IN_WORD[data[max(start, end - 4096) : end]] == inside)
        if len(found):
            return max(start, end - 4096) + int(found[-1])
        end = max(start, end - 4096)
    return start - 1 if not inside else -1


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a column of texts: (row of each word, bucket of each word, row of each pair, bucket of each pair), part by part."""
    data, start, end = utf8(texts)
    for spans in _spans(data, start, end):
        row, begin, to, again = (np.array(x) for x in zip(*spans, strict=True))
        base = begin[0]
        part = data[base : to[-1]]
        word = np.zeros(len(part) + 2, np.int8)
        word[1:-1] = IN_WORD[part]
        first, after = np.flatnonzero(np.diff(word) > 0), np.flatnonzero(np.diff(word) < 0)
        # texts stand side by side: a word over a border is one of each
        borders = begin[1:] - base
        inner = borders[(borders > 0) & (borders < len(part))]
        inner = np.unique(inner[(word[inner] > 0) & (word[inner + 1] > 0)])
        first, after = np.sort(np.concatenate([first, inner])), np.sort(np.concatenate([after, inner]))
        if not len(first):
            continue
        low = LOWER[part]
        span = np.searchsorted(begin - base, first, side="right") - 1
        size = after - first
        state = advanced(np.full(len(first), 0xFFFFFFFF, np.uint32), low, first, size)
        two = np.flatnonzero(span[1:] == span[:-1])
        spaced = CRC[(state[two] ^ 0x20) & 0xFF] ^ (state[two] >> 8)
        pairs = advanced(spaced, low, first[two + 1], size[two + 1])
        new = np.ones(len(first), bool)
        new[np.flatnonzero(np.r_[True, span[1:] != span[:-1]] & again[span])] = False  # counted in the part before
        yield row[span[new]], (state[new] ^ 0xFFFFFFFF) % buckets, row[span[two]], (pairs ^ 0xFFFFFFFF) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts (column text). Each task sends its counts, at most a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in row_groups(batch, 0, CHUNK):
                for _, one, _, two in features(group.column(0), buckets):
                    total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # as many rows as there are buckets
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier a feature of each bucket is in the target, rounded down."""
    all_source, all_target, buckets = float(source.sum()), float(target.sum()), float(len(source))
    ratio = (target + 1.0) * (all_source + buckets) / ((source + 1.0) * (all_target + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of documents (doc_id, text): the mean gain of each, rounded down."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in row_groups(batch, 1, CHUNK):
                n = group.num_rows
                words, all_, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for row, one, pair_row, two in features(group.column(1), buckets):
                    words += np.bincount(row, minlength=n)
                    all_ += np.bincount(row, minlength=n) + np.bincount(pair_row, minlength=n)
                    np.add.at(total, row, gain[one])
                    np.add.at(total, pair_row, gain[two])
                mean = np.where(all_ > 0, total // np.maximum(all_, 1), 0)
                yield pa.RecordBatch.from_arrays([group.column(0), *(pa.array(x, pa.int64()) for x in (words, all_, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """A thousand times the Gumbel noise of an id, rounded down; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _bound(long_enough: DataFrame, most: int) -> int | None:
    """A score that at least `most` documents reach, and few more: from counts by ranges of scores. Weights and noise
    span some ten thousands, so these are some hundred counts."""
    sums = long_enough.groupBy(F.floor(F.col("score") / RANGE).alias("range")).count().orderBy(F.col("range").desc()).collect()
    held = 0
    for r in sums:
        held += r["count"]
        if held >= most:
            return r["range"] * RANGE
    return None


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of documents (doc_id, text) towards target texts (text).

    Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn, ranked from 1 by score,
    ties by smaller doc_id; the rank of all others is null. Rows are documents of their own: those that repeat an id and
    a score are ranked by features, then in any order, and a null id comes last. Null and empty texts, and those without
    words, have no features and weight 0. Very long texts are read whole, part by part. An empty table gives an empty
    one; an empty target still gives weights. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = saved(weights(docs, gain).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "scored")
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    drawn = percent * n // 100
    bound = _bound(scored.where(enough), drawn) if drawn else None
    if bound is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # the highest scores sorted by ranges; the places before each range are one sum for each partition
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    high = enough & (F.col("score") >= bound)
    parts = saved(scored.where(high).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    nth = F.row_number().over(W.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = parts.join(F.broadcast(before), "part").withColumn("nth", nth.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("nth") <= drawn, F.col("nth"))).drop("part", "before", "nth")
    return ranked.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents that `resample` draws, with their own columns, whatever their names; rows of one id go together."""
    key, = fresh(docs, "drawn_id")
    ids = resample(docs, target, **settings).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias(key))
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(key)), "left_semi")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = """
WITH RECURSIVE c(b, k, r) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END FROM c WHERE k < 8),
crc AS (SELECT list(r ORDER BY b) AS t FROM c WHERE k = 8),
w AS (
  SELECT doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL
  SELECT NULL, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
r AS (SELECT row_number() OVER () AS row, * FROM w),
f AS (
  SELECT row, unnest(words) AS feature FROM r UNION ALL
  SELECT row, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM r WHERE len(words) > 1),
g AS (SELECT row, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM g)),
i AS (
  SELECT feature, xor(list_reduce(
    list_transform(range(len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT)),
    lambda s, byte: xor(s // 256, t[xor(s % 256, byte) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM h, crc),
j AS (SELECT g.row, i.bucket, g.n FROM g JOIN i USING (feature)),
k AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t
  FROM j JOIN r USING (row) GROUP BY bucket),
l AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
         / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM k),
m AS (SELECT row, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM j JOIN l USING (bucket) GROUP BY row),
n AS (
  SELECT r.doc_id, len(words) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM r LEFT JOIN m USING (row) WHERE NOT target),
o AS (SELECT *, count(*) FILTER (n_words >= 20) OVER () AS many, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS nth FROM n)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND nth <= 25 * many // 100 THEN nth END AS rank FROM o
"""
