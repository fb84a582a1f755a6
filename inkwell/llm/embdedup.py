"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

Copies are one vector with a weight. Every vector is hashed TABLES times: HASHES pseudo-random rotations (three rounds
of sign flips and a fast Hadamard transform) give the nearest signed axes, and the code joins them. A vector stands in
its own bucket and in the PROBES next-best ones. A narrow table of buckets shows which of them have a pair that could
count; only to these the vectors travel. There pairs are verified in double precision; a pair that meets in several
buckets is counted in the first only, which both rows can tell from their codes. Tasks give counts and spanning links,
never pairs. A bucket too large for one task is cut into blocks that are met block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import forget, key_runs, roots, run_pairs, saved, table
from inkwell.llm.components import components

COSINE = 0.93
TABLES, HASHES, PROBES, SEED = 10, 3, 3, 17
#: Rows of a bucket that one task holds at once, rows of a task's table, pairs verified at a time, tile of large runs.
BUCKET_ROWS, RUN_ROWS, PAIRS, TILE = 8192, 100_000, 200_000, 1024


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pair = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(np.float32(d))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their magnitude."""
    x = x.astype(np.float64)
    x = x / np.ldexp(1.0, np.frexp(np.abs(x).max(1, keepdims=True))[1] - 1)  # by a power of two: nothing is rounded
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES, 1 + PROBES) bucket codes: the best one, then those with one hash replaced by its second choice."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(units(x), ((0, 0), (0, wide - d))).astype(np.float32)
    rng = np.random.default_rng(SEED)
    out = np.empty((n, TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        best, loss = [], []
        for _ in range(HASHES):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), wide))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.take_along_axis(y, top, 1)
            turn = np.abs(value[:, 1]) > np.abs(value[:, 0])
            top[turn], value[turn] = top[turn, ::-1], value[turn, ::-1]
            best.append(top * 2 + (value < 0))
            loss.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
        base = sum(b[:, 0] * (2 * wide) ** h for h, b in enumerate(best))
        swaps = np.stack([base + (b[:, 1] - b[:, 0]) * (2 * wide) ** h for h, b in enumerate(best)], axis=1)
        order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")[:, :PROBES]
        out[:, t, 0], out[:, t, 1:] = base, np.take_along_axis(swaps, order, 1)
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch's column `embedding`, a few thousand rows of one length at a time."""
    lists = batch.column("embedding")
    size = np.diff(lists.offsets.to_numpy())
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            yield part, lists.take(pa.array(part)).flatten().to_numpy().reshape(-1, d)


def _bucketed(reps: DataFrame) -> DataFrame:
    """(key, gid, spot) of vectors, a row for each table and bucket; spot numbers both, own buckets first in each table."""
    spread = TABLES * (1 + PROBES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_length(batch):
                code = codes(x).reshape(-1)
                again = pa.array(np.repeat(rows, spread))
                spot = pa.array(np.tile(np.arange(spread, dtype=np.int16), len(rows)))
                yield pa.RecordBatch.from_arrays([batch.column("label").take(again), batch.column("gid").take(again), pa.array(np.full(len(code), x.shape[1], np.int32)), spot, pa.array(code)], names=["label", "gid", "dim", "spot", "code"])

    label = reps.schema["label"].dataType.simpleString()
    rows = reps.select("label", "gid", "embedding").mapInArrow(run, f"label {label}, gid long, dim int, spot short, code long")
    return rows.select(F.xxhash64("label", "dim", F.floor(F.col("spot") / (1 + PROBES)), "code").alias("key"), "gid", "spot")


def _packed(reps: DataFrame) -> DataFrame:
    """(gid, label, mult, dim, vec, codes): vectors and all their codes as bytes."""
    kind = np.float32 if reps.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_length(batch):
                own = pa.array([r.tobytes() for r in codes(x)])
                vec = pa.array([r.tobytes() for r in x.astype(kind)])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("gid", "label", "mult")), pa.array(np.full(len(rows), x.shape[1], np.int32)), vec, own], names=["gid", "label", "mult", "dim", "vec", "codes"])

    label = reps.schema["label"].dataType.simpleString()
    return reps.select("gid", "label", "mult", "embedding").mapInArrow(run, f"gid long, label {label}, mult long, dim int, vec binary, codes binary")


def _verify(batches: Iterator[pa.RecordBatch], cosine: float, single: bool) -> Iterator[pa.RecordBatch]:
    """(gid, links, root) of the rows of sorted buckets that found partners there."""
    for run in key_runs(batches, ["key", "tile"], RUN_ROWS):
        key, tile, block = (run[c].to_numpy() for c in ("key", "tile", "block"))
        rep, mult, spot, dim = (run[c].to_numpy() for c in ("gid", "mult", "spot", "dim"))
        ordinal, probe = spot // (1 + PROBES), spot % (1 + PROBES)
        own = np.frombuffer(b"".join(run["codes"].to_pylist()), np.int64).reshape(len(rep), TABLES, 1 + PROBES)
        code = own[np.arange(len(rep)), ordinal, probe]
        label = run["label"].combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        raw = run["vec"].to_pylist()
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        size = np.diff(np.r_[new, len(key)])
        kind = np.float32 if single else np.float64
        width = int(dim.max())
        unit = np.zeros((len(rep), width))
        for d in np.unique(dim):
            rows = np.flatnonzero(dim == d)
            unit[rows, :d] = units(np.frombuffer(b"".join([raw[r] for r in rows]), kind).reshape(-1, d))

        def candidates(new=new, size=size, unit=unit):
            few = size <= 64
            for at in np.flatnonzero(~few):
                first, end = new[at], new[at] + size[at]
                for a in range(first, end, TILE):
                    for b in range(a, end, TILE):
                        i, j = np.nonzero(unit[a : min(end, a + TILE)] @ unit[b : min(end, b + TILE)].T >= cosine)
                        later = i + a < j + b
                        yield i[later] + a, j[later] + b
            inside = np.repeat(few, size)
            rows = np.flatnonzero(inside)
            starts = np.concatenate([[0], np.cumsum(size[few])[:-1]]) if few.any() else np.empty(0, int)
            if len(rows):
                for i, j in run_pairs(starts, size[few], PAIRS):
                    i, j = rows[i], rows[j]
                    near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                    yield i[near], j[near]

        links, left, right = np.zeros(len(rep), np.int64), [], []
        for i, j in candidates():
            ok = (rep[i] != rep[j]) & (label[i] == label[j]) & (dim[i] == dim[j]) & (ordinal[i] == ordinal[j]) & (code[i] == code[j]) & ((probe[i] == 0) | (probe[j] == 0))
            ok &= (block[i] != block[j]) | (tile[i] == block[i] * (block[i] + 1) // 2 + block[i])
            i, j = i[ok], j[ok]
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            forth = (own[j] == own[i][:, :, :1]).any(2)  # i's own bucket is one of j's, by table
            back = (own[i] == own[j][:, :, :1]).any(2)
            first = np.argmax(forth | back, axis=1)
            row = np.arange(len(i))
            where = np.where(forth[row, first], own[i, first, 0], own[j, first, 0])
            once = (first == ordinal[i]) & (where == code[i])
            i, j = i[once], j[once]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            left.append(i)
            right.append(j)
        if left and (links > 0).any():
            root = roots(len(rep), np.concatenate(left), np.concatenate(right))
            has = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(links[has]), pa.array(rep[root[has]])], names=["gid", "links", "root"])


def linked_vectors(reps: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(gid, links, root) rows of distinct vectors (gid, label, mult, embedding); links add up, roots connect."""
    narrow = saved(_bucketed(reps), "buckets")
    own = F.col("spot") % (1 + PROBES) == 0
    live = narrow.groupBy("key").agg(F.count("*").alias("n"), F.sum(own.cast("long")).alias("own")).where("n > 1 and own > 0")
    live = live.select("key", F.when(F.col("n") > BUCKET_ROWS, F.ceil(F.col("n") / (BUCKET_ROWS // 2))).otherwise(1).cast("int").alias("blocks"))
    # block b meets block c in tile (b, c); a row goes to the tiles of its block
    rows = narrow.join(live, "key").withColumn("block", F.pmod(F.xxhash64("gid", F.lit(5)), F.col("blocks")).cast("int"))
    high, low = (lambda o: F.greatest(o, "block")), (lambda o: F.least(o, "block"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.floor(high(o) * (high(o) + 1) / 2) + low(o)).cast("int"))
    rows = rows.join(_packed(reps), "gid").withColumn("tile", F.explode(tiles)).drop("blocks")
    single = reps.schema["embedding"].dataType.elementType.simpleString() == "float"
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile")
    found = saved(rows.mapInArrow(lambda b: _verify(b, cosine, single), "gid long, links long, root long"), "links")
    forget(narrow)
    return found


def dedup_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label), a row for each row.

    Vectors that are null, empty, zero or hold null or non-finite components, those without label and those without id
    link with nothing: n_links 0, component_id their own id. Vectors of different length never link, those of any
    magnitude do. Rows that repeat a vector and label are copies and link with each other; n_links counts rows. Rows
    that repeat a vec_id are one node, whatever their vectors: what is reachable from one is from all. An empty table
    gives an empty one; other columns are not looked at.
    """
    takes_part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    named = vectors.select("vec_id", "label", "embedding", takes_part.alias("ok"))
    # gid names a vector and label by 64 hash bits
    part = named.where("ok").select("vec_id", F.xxhash64("label", "embedding").alias("gid"), "label", "embedding")
    reps = saved(part.groupBy("gid").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "vectors")
    found = linked_vectors(reps, cosine)
    ids = part.groupBy("vec_id").agg(F.min("gid").alias("v"), F.max("gid").alias("u")).where("u <> v").select("vec_id", "v")
    same = part.select("vec_id", "gid").join(ids, "vec_id").where("gid <> v").select(F.col("gid").alias("u"), "v")
    stars = components(found.select(F.col("gid").alias("u"), F.col("root").alias("v")).union(same))
    count = found.groupBy("gid").agg(F.sum("links").alias("links"))
    about = reps.select("gid", "least", "mult").join(count, "gid", "left").join(stars.withColumnRenamed("node", "gid"), "gid", "left")
    about = saved(about.select("gid", "least", F.coalesce("root", "gid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "about")
    about = about.join(about.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("gid", "n_links", "component_id")
    linking = part.select("vec_id", "gid").join(about, "gid").select("vec_id", "n_links", "component_id")
    alone = named.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))
