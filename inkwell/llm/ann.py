"""Approximate nearest neighbours by collision-counting hashing over single projections.

Vectors lie in cells, each those nearest to one pivot of a bounded sample, and in parts of cells of bounded size. In a
part each of PROJECTIONS random projections is one sorted array. A query's windows are centred on its own projections;
virtual rehashing widens them radius by radius, and only what a wider window adds is counted. A vector that collides in
enough arrays is verified by its true distance. A query ends when its k-th verified distance lies within the radius, at
which a true neighbour has collided often enough with high probability.

A query is searched in its own cell first; the k-th distance found there bounds the radius elsewhere. Of each cell the
ends of all its projections are known, so it is known in how many arrays any of its vectors can collide at that radius:
only cells that reach the threshold are searched. Nothing is capped: if windows must grow over a whole part, they do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import forget, join_small, saved, table
from inkwell.llm.embdedup import usable

NEAREST, EVERY = 10, 100
PROJECTIONS, SEED = 64, 23
#: Half a window's width as a share of the radius, and the growth of the radius.
HALF, GROWTH = 0.9, 1.25
#: First radius as a share of the part's typical distance; deviations by which the threshold lies below the mean.
FIRST, SLACK = 0.15, 2.0
#: Vectors of a part and queries that meet it at once; most pivots of one length of vector. Pivots are the rows with the
#: smallest hashes of their ids, one for each BLOCK_ROWS vectors.
BLOCK_ROWS, QUERY_ROWS, PIVOTS = 16384, 8192, 1024
#: Vectors with larger components, or none as large as the inverse, are compared one by one, in a cell of their own.
FAR = 1e100
OWN = -1


def threshold(projections: int = PROJECTIONS) -> int:
    """Collisions that a vector at exactly the radius reaches but for SLACK deviations."""
    p = math.erf(HALF / math.sqrt(2))
    return max(1, math.floor(projections * p - SLACK * math.sqrt(projections * p * (1 - p))))


def lines(d: int) -> np.ndarray:
    """The random projections of vectors of length d, as columns."""
    return np.random.default_rng(SEED).standard_normal((d, PROJECTIONS))


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; those whose squares would overflow or vanish are taken of scaled differences."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        apart = vectors - query
        out = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        top = np.abs(apart).max(1)
        odd = np.flatnonzero((top > 1e150) | ((top < 1e-150) & (top > 0)))
        if len(odd):
            scaled = apart[odd] / top[odd, None]
            out[odd] = np.where(np.isinf(top[odd]), np.inf, top[odd] * np.sqrt(np.einsum("ij,ij->i", scaled, scaled)))
    return out


def _far(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)
    return (top > FAR) | (top < 1 / FAR)


class Block:
    """Sorted projections of the vectors of one part."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plain: bool = False):
        self.ids, self.vectors, self.plain = ids, vectors, plain
        if plain:
            return
        self.lines = lines(vectors.shape[1])
        projected = (vectors @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(projected, self.order, 1)
        spread = vectors - vectors.mean(0)
        self.typical = float(np.sqrt(2 * np.einsum("ij,ij->i", spread, spread).mean())) or 1.0
        self.least = threshold()

    def search(self, query_id: int, query: np.ndarray, k: int, limit: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the nearest found within the limit, by distance and then id. A limit is the only radius."""
        n = len(self.ids)
        places, found = np.empty(0, np.int64), np.empty(0)

        def verify(new: np.ndarray) -> None:
            nonlocal places, found
            places, found = np.concatenate([places, new]), np.concatenate([found, distances(self.vectors[new], query)])
            best = np.lexsort((self.ids[places], found))[:k]
            places, found = places[best], found[best]

        if self.plain or _far(query[None])[0]:
            verify(np.flatnonzero(self.ids != query_id))
            return places, found
        at = query @ self.lines
        count = np.zeros(n, np.int32)
        open_ = self.ids != query_id
        radius, low, high = min(limit, FIRST * self.typical) if limit == math.inf else limit, None, None
        while True:
            half = HALF * radius
            new_low = [int(v.searchsorted(x - half)) for v, x in zip(self.value, at, strict=True)]
            new_high = [int(v.searchsorted(x + half, side="right")) for v, x in zip(self.value, at, strict=True)]
            if low is None:
                parts = [o[a:b] for o, a, b in zip(self.order, new_low, new_high, strict=True)]
            else:
                parts = [o[a:b] for o, a, b in zip(self.order, new_low, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, new_high, strict=True)]
            count += np.bincount(np.concatenate(parts), minlength=n)
            low, high = new_low, new_high
            new = np.flatnonzero(open_ & (count >= self.least))
            if len(new):
                open_[new] = False
                verify(new)
            if radius >= limit or (len(places) == k and found[-1] <= radius) or (min(high) == n and max(low) == 0):
                return places, found
            radius *= GROWTH


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def _search(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    if len(queries) and len(vectors):
        block = Block(vectors.vec_id.to_numpy(), _matrix(vectors.embedding), plain=key[1] == OWN)
        for query_id, query, k, limit in zip(queries.query_id.tolist(), _matrix(queries.embedding), queries.k.tolist(), queries.limit.tolist(), strict=True):
            places, found = block.search(query_id, query, k, limit)
            out += zip([query_id] * len(places), block.ids[places].tolist(), found.tolist(), strict=True)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By length of vector, the pivots: about one for each BLOCK_ROWS vectors, PIVOTS at most, of those that are not far."""
    most = min(PIVOTS, n // BLOCK_ROWS)
    if most < 2:
        return {}
    place = (F.xxhash64("vec_id", F.lit(SEED)) / float(1 << 63) + 1) / 2
    few = vectors.where(place < most / n).select("embedding").distinct().limit(2 * most)  # a sample, met by chance
    by: dict[int, list[np.ndarray]] = {}
    for row in few.collect():
        by.setdefault(len(row.embedding), []).append(np.asarray(row.embedding, np.float64))
    return {d: np.array(sorted(x.tolist() for x in rows if not _far(x[None])[0])) for d, rows in by.items()}


def _in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows (id, embedding) with dim and cell: the nearest pivot's number, 0 without pivots, OWN if far."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors of each length at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            cell = np.zeros(len(size), np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = lists.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                far, own = _far(x), shared.value.get(int(d), np.empty((0, d)))
                x[far] = 0
                if len(own):
                    cell[at] = np.argmin((own * own).sum(1) - 2 * x @ own.T, axis=1)
                cell[at[far]] = OWN
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell)], names=[*batch.schema.names, "dim", "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, dim int, cell int")


def _ends(cells: DataFrame) -> DataFrame:
    """(dim, cell, n, low, high): of each cell its vectors and the ends of all their projections. Tasks reduce what they
    read to one row for each cell before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            lists, dim, cell = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = lists.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                for c in np.unique(cell[at]):
                    rows = x[cell[at] == c]
                    y = rows @ lines(int(d)) if c != OWN else np.zeros((len(rows), PROJECTIONS))
                    n, low, high = seen.get((int(d), int(c)), [0, np.inf, -np.inf])
                    seen[int(d), int(c)] = [n + len(rows), np.minimum(low, y.min(0)), np.maximum(high, y.max(0))]
        rows = [(d, c, n, low.tolist(), high.tolist()) for (d, c), (n, low, high) in seen.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("dim", "cell", "n", "low", "high"), r, strict=True)) for r in rows], schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    own = cells.select("embedding", "dim", "cell").mapInArrow(run, "dim int, cell int, n long, low array<double>, high array<double>")
    each = own.select("dim", "cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("line", "ends"))
    ends = each.groupBy("dim", "cell", "line").agg(F.sum("n").alias("n"), F.min("ends.low").alias("low"), F.max("ends.high").alias("high"))
    whole = F.array_sort(F.collect_list(F.struct("line", "low", "high")))
    return ends.groupBy("dim", "cell").agg(F.max("n").alias("n"), whole.alias("e")).select("dim", "cell", "n", "e.low", "e.high")


def _near_cells(queries: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each query (query_id, embedding, dim, cell, k, limit) and cell, not its own, that may hold a vector that
    collides often enough at the limit."""
    by: dict[int, list] = {}
    for r in ends.collect():  # PIVOTS cells of each length at most
        by.setdefault(r.dim, []).append((r.cell, r.low, r.high))
    table = {d: tuple(map(np.array, zip(*rows, strict=True))) for d, rows in by.items()}
    shared = queries.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again, cells = [], []
            for i, (x, d, own, limit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("embedding", "dim", "cell", "limit")), strict=True)):
                if d in shared.value:
                    cell, low, high = shared.value[d]
                    fit = cell != own
                    if own != OWN and limit < math.inf:
                        at, half = np.asarray(x, np.float64) @ lines(d), HALF * limit
                        fit &= (((at - half <= high) & (at + half >= low)).sum(1) >= threshold()) | (cell == OWN)
                    again += [i] * int(fit.sum())
                    cells += cell[fit].tolist()
            some = batch.take(pa.array(again, pa.int64()))
            yield some.set_column(batch.schema.get_field_index("cell"), "cell", pa.array(cells, pa.int32()))

    return queries.mapInArrow(run, queries.schema)


def _met(queries: DataFrame, cells: DataFrame, ends: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of queries (query_id, embedding, dim, cell, k, limit) searched in their cells. A cell has
    parts of BLOCK_ROWS vectors, which all its queries meet, QUERY_ROWS of them at a time."""
    queries = saved(queries, "queries")
    rounds = F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("rounds")
    plan = queries.groupBy("dim", "cell").agg(rounds).join(ends.select("dim", "cell", "n"), ["dim", "cell"])
    plan = saved(plan.select("dim", "cell", "rounds", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts")), "plan")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    of = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    left = join_small(queries, plan, ["dim", "cell"]).withColumn("round", of("query_id", "rounds")).withColumn("part", each("parts"))
    again = plan.select("dim", "cell", F.col("rounds").alias("m"), F.col("parts").alias("p"))
    right = join_small(cells, again, ["dim", "cell"]).withColumn("part", of("vec_id", "p")).withColumn("round", each("m"))
    key = ["dim", "cell", "part", "round"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search, "query_id long, vec_id long, score double")
    return saved(found, "found")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors and queries (vec_id, embedding): each query's k nearest found.

    score is the Euclidean distance in double precision, infinite where it is beyond; ties go to the smaller vec_id.
    Candidates are all vectors but those with the query's own id. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do those without id, nor those of another length than the query. Queries
    without a candidate have no rows; empty tables give an empty one. Repeated rows are candidates each; other columns
    are not looked at.
    """
    fit = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    vectors = vectors.where(fit).select("vec_id", "embedding")
    queries = queries.where(fit).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    pivots = _pivots(vectors, vectors.count())
    cells = saved(_in_cells(vectors, pivots), "cells")
    ends = saved(_ends(cells), "ends")
    queries = saved(_in_cells(queries, pivots).withColumn("k", F.lit(k)).withColumn("limit", F.lit(math.inf)), "queries")
    own = _met(queries, cells, ends)
    near = W.partitionBy("query_id").orderBy("score", "vec_id")
    bound = own.withColumn("rank", F.row_number().over(near)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = queries.join(bound, "query_id", "left").withColumn("limit", F.coalesce("bound", "limit")).select(*queries.columns)
    other = _met(_near_cells(rest, ends), cells, ends)
    found = saved(own.union(other).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    forget(cells)
    return found


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
