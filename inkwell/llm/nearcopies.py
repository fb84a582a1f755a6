"""Near copies by the similarity of their shingle sets: candidates from two indexes, each candidate pair checked exactly.

Two texts are near copies if their sets of SHINGLE-word runs have a Jaccard similarity of SIMILARITY or more. The Gray
index over SimHash fingerprints meets what differs in 3 bits; at this similarity most pairs differ in more, which no
choice of blocks reaches at scale, so bands of min-hashes stand beside it: a pair of similarity s shares one of BANDS
bands of ROWS min-hashes with probability 1 - (1 - s**ROWS)**BANDS, which is 0.9996 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import simhash
from inkwell.llm.common import forget, is_small, key_runs, saved
from inkwell.llm.components import HUB, HUB_SHARE, components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
#: Shingles whose min-hashes are computed at once; parts into which the pairs of a node with very many are dealt.
CHUNK, PARTS = 2048, 64
#: Nodes of a bucket, and their shingles, that one task holds at once; rows and bytes of a task's table.
BUCKET, GRAMS, RUN_ROWS, RUN_BYTES = 4096, 4_000_000, 2048, 32 << 20
_draw = np.random.default_rng(17)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words; of the whole text if it has fewer, none if it has no words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, parts, rest = xxhash.xxh64_digest, [], b""
    for at in range(0, len(data), simhash.PIECE):
        piece = rest + data[at : at + simhash.PIECE]
        words = piece.split()
        rest = words.pop() if words and at + simhash.PIECE < len(data) and not piece[-1:].isspace() else b""
        parts.append(np.frombuffer(b"".join([digest(w) for w in words]), np.uint64))
    w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    n = min(SHINGLE, len(w))
    if n == 0:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def bands(grams: np.ndarray) -> list[int]:
    """A key of each band, as signed longs; none without shingles."""
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), CHUNK):
        np.minimum(least, (grams[None, at : at + CHUNK] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[b * size : (b + 1) * size], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def _copy(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, copy, grams, fp, bands): copy names the shingle set and grams counts it, h1 and h2 name the row's id
    and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, counts, prints, keys = [], [], [], []
            for text in batch.column(3).to_pylist():
                grams = shingles(text)
                copies.append(_copy(grams))
                counts.append(len(grams))
                prints.append(simhash.fingerprint(text, SHINGLE))
                keys.append(bands(grams))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(copies, pa.binary()), pa.array(counts, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "h1", "h2", "copy", "grams", "fp", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    h1, h2 = simhash.identity(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, copy binary, grams long, fp long, bands array<long>")


def _sets(docs: DataFrame, each: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grams) of nodes (node), each from a document that has it."""
    named = saved(nodes.distinct().join(each.select("node", "copy", "least"), "node"), "named")
    ids = saved(named.select("least").distinct(), "ids")
    if is_small(ids):
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                grams = shingles(text)
                yield pa.RecordBatch.from_arrays([pa.array([_copy(grams)], pa.binary()), pa.array([grams.view(np.int64)], pa.list_(pa.int64()))], names=["copy", "grams"])

    found = rows.mapInArrow(run, "copy binary, grams array<long>").join(named.select("node", "copy"), "copy")
    return saved(found.select("node", "grams").dropDuplicates(["node"]), "sets")


def _alike(docs: DataFrame, each: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets are similar enough, by exact counts."""
    pairs = saved(pairs, "pairs")
    sets, n = _sets(docs, each, pairs.select(F.explode(F.array("u", "v")).alias("node"))), pairs.count()
    hubs = F.broadcast(pairs.groupBy("u").count().where(F.col("count") > max(HUB, n // HUB_SHARE)).select("u", F.lit(True).alias("hub")))  # HUB_SHARE rows at most
    left, right = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    part = F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(PARTS))).otherwise(0).cast("int")
    every = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = pairs.join(hubs, "u", "left").select("u", "v", part.alias("part"))
    left = left.join(hubs, "u", "left").select("u", "a", F.explode(every).alias("part"))
    both = F.size(F.array_intersect("a", "b"))
    found = dealt.join(left, ["u", "part"]).join(right, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("total"))
    return saved(found.where(F.col("both") >= SIMILARITY * (F.col("total") - F.col("both"))).select("u", "v"), "alike")


def _bucket_links(node: np.ndarray, root: np.ndarray, block: np.ndarray, apart: bool, grams: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between nodes of one bucket that have other roots and similar shingle sets, as many as connect what all such
    pairs would. Counts of shared shingles come from an inverted list; what is connected already is not looked at again.
    `apart`: only pairs of different blocks count."""
    size = np.array([len(g) for g in grams])
    end = np.cumsum(size)
    _, gram, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(node)), size)[np.argsort(gram, kind="stable")]
    first, group, out = np.cumsum(often) - often, np.unique(root, return_inverse=True)[1], []
    for i in range(len(node) - 1):
        other = group[i + 1 :] != group[i]
        if apart:
            other &= block[i + 1 :] != block[i]
        if not other.any():
            continue
        own = gram[end[i] - size[i] : end[i]]
        n = often[own]
        both = np.bincount(holder[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(node))[i + 1 :]
        near = i + 1 + np.flatnonzero(other & (both >= SIMILARITY * (size[i] + size[i + 1 :] - both)))
        for j in near.tolist():
            if group[j] != group[i]:
                out.append((int(node[i]), int(node[j])))
                group[group == group[j]] = group[i]
    return out


def _linked_in_buckets(docs: DataFrame, each: DataFrame, rest: DataFrame) -> DataFrame:
    """(u, v) links that still connect nodes of different roots in buckets (key, node, root). A bucket's nodes meet in one
    task with their shingle sets; one of more than BUCKET nodes or GRAMS shingles is cut into blocks that meet two by two. No
    pairs are made into rows but those that link."""
    n = rest.join(each.select("node", F.col("grams").alias("n_grams")), "node").groupBy("key").agg(F.count("*").alias("nodes"), F.sum("n_grams").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("nodes") / (BUCKET // 2), F.col("grams") / (GRAMS // 2))).cast("int")
    n = n.where((F.col("nodes") > BUCKET) | (F.col("grams") > GRAMS)).select("key", F.least(blocks, F.col("nodes").cast("int")).alias("blocks"))
    rows = rest.join(n, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    high, low = (lambda o: F.greatest(o, "block")), (lambda o: F.least(o, "block"))
    tile = lambda o: F.struct(high(o).cast("int").alias("high"), low(o).cast("int").alias("low"))
    rows = rows.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), tile))).select("key", "node", "root", "block", "t.high", "t.low")
    rows = rows.join(_sets(docs, each, rest.select("node")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "high", "low"]
        for whole in key_runs(batches, keys, RUN_ROWS, RUN_BYTES):
            column = {c: whole[c].to_numpy() for c in (*keys, "node", "root", "block")}
            new = np.any([column[k][1:] != column[k][:-1] for k in keys], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), whole.num_rows]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                grams = [np.asarray(g, np.int64) for g in whole["grams"].slice(a, b - a).to_numpy()]
                apart = column["high"][a] != column["low"][a]
                if b - a > 1:
                    out += _bucket_links(column["node"][a:b], column["root"][a:b], column["block"][a:b], apart, grams)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    rows = rows.select("key", "high", "low", "node", "root", "block", "grams")
    return saved(rows.repartition("key", "high", "low").sortWithinPartitions("key", "high", "low", "node").mapInArrow(run, "u long, v long"), "more")


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, root) of documents, a row for each row: root names the group of near copies.

    Buckets are the bands, and the fingerprints that the Gray index links to one. First each bucket's nodes are checked
    against its smallest one; then bands whose nodes are not all connected are gone through as wholes.
    """
    marks = saved(_marks(docs), "marks")
    each = marks.groupBy("copy").agg(F.min_by("doc_id", F.struct(F.isnull("doc_id"), "doc_id")).alias("least"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("grams").alias("grams"))
    each = saved(each.withColumn("node", F.monotonically_increasing_id()), "distinct")  # numbered once: the table is read from here on
    prints = saved(simhash.linked(each.select("fp").distinct()), "links").select(F.col("v").alias("key"), F.explode(F.array("u", "v")).alias("fp"))
    by_print = prints.union(each.select(F.col("fp").alias("key"), "fp")).distinct().join(each, "fp").select("key", "node", F.lit(False).alias("band"))
    members = each.select(F.explode("bands").alias("key"), "node", F.lit(True).alias("band")).union(by_print)
    tops = members.groupBy("key", "band").agg(F.min("node").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "band", "top")
    members = saved(members.join(tops, ["key", "band"]).where("node <> top"), "members")
    links = _alike(docs, each, members.select(F.col("top").alias("u"), F.col("node").alias("v")).distinct())
    root = saved(components(links), "roots")
    rest = members.where("band").select("key", "node").join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = saved(rest.join(mixed, "key"), "rest")
    more = _linked_in_buckets(docs, each, rest)
    if not more.isEmpty():
        root = components(root.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    placed = each.select("copy", "node").join(root, "node", "left").select("copy", F.coalesce("root", "node").alias("root"))
    out = saved(marks.select("doc_id", "h1", "h2", "copy").join(placed, "copy").select("doc_id", "h1", "h2", "root"), "grouped")
    forget(members, rest)
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of documents (doc_id, text), a row for each row.

    component_id is the smallest doc_id reachable over pairs of near copies, null only where no reachable row has one.
    Texts of the same shingle set, those without words among them, are one node however many they are. Rows of one
    doc_id are handled each by its own text. An empty table gives an empty one; other columns are not looked at.
    """
    rows = _grouped(docs)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near copies: the one with the smallest doc_id, null last, and of that
    id's rows in the group the one whose text has the smallest hash. Rows of one id in different groups stay each."""
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "h1", "h2")).alias("first")
    return simhash.kept(docs, _grouped(docs).groupBy("root").agg(first).select("first.h1", "first.h2"))
