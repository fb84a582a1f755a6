"""SimHash near-dedup with a Gray-order hierarchical index.

Two fingerprints that differ in at most 3 bits agree on one of four 16-bit blocks. Each distinct fingerprint goes to
its four (block, value) groups; inside a group the fingerprints are sorted by Gray rank, so neighbours share bits, and
a tree is built over them whose nodes hold the bits that all leaves below share. A search walks from the root, adds
up the differences node by node, and drops whole groups as soon as the sum passes the limit. Groups too large for one
task are cut by blocks of their remaining bits, which loses no pair. Tasks give spanning links only, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import fresh, key_runs, roots, saved, table
from inkwell.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Children of a tree node, rows of a task's tree, queries searched at a time, (query, node) pairs held at once.
FAN, TREE_ROWS, QUERIES, FRONTIER = 8, 200_000, 8192, 2_000_000
#: A group of more fingerprints is cut by its remaining bits. Bits left after each cut: 48, 36, 27.
GROUP_ROWS = 50_000
LEVELS = (16, 12, 9)
PIECE = 1 << 20
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.uint16)


def _bit_counts(words: list[bytes], shingle: int) -> np.ndarray:
    """How many shingle hashes of consecutive words have each of the 64 bits set, highest bit first."""
    digest = xxhash.xxh64_digest
    shingles = zip(*(words[i:] for i in range(shingle)), strict=False)
    raw = b"".join([digest(b" ".join(s), SEED) for s in shingles])
    lanes = np.frombuffer(raw, np.uint8).reshape(-1, 8) + _LANES
    return (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)[:, :, None] * _BITS).sum(1).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer. Long texts are hashed piece by piece, cut at white space."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE:
        words = data.split()
        if not words:
            return 0
        if len(words) < shingle:
            return xxhash.xxh64_intdigest(b" ".join(words), SEED)
        counts, n = _bit_counts(words, shingle), len(words) - shingle + 1
    else:
        counts, n, tail, rest = np.zeros(64, np.int64), 0, [], b""
        for at in range(0, len(data), PIECE):
            piece = rest + data[at : at + PIECE]
            words = piece.split()
            rest = words.pop() if words and at + PIECE < len(data) and not piece[-1:].isspace() else b""
            words = tail + words
            if len(words) >= shingle:
                counts += _bit_counts(words, shingle)
                n += len(words) - shingle + 1
                tail = words[-(shingle - 1) :]
            else:
                tail = words
        if n == 0:
            return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def identity(doc_id: Column, text: Column) -> list[Column]:
    """128 hash bits of a row's id and text, never null."""
    return [F.xxhash64(F.lit(k), doc_id, F.isnull(doc_id), text, F.isnull(text)) for k in (1, 2)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, fp) of (doc_id, text); fp holds the 64 bits as a long, h1 and h2 are the row's `identity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints)], names=["doc_id", "h1", "h2", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    h1, h2 = identity(F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, fp long")


class GrayTree:
    """A tree over fingerprints sorted by group and Gray rank; one root for each group."""

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        self.prints = prints
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.levels: list[dict] = []  # from the leaves up: value, mask of shared bits, first leaf, end leaf
        level = {"value": prints, "mask": np.full(len(prints), ONES), "first": np.arange(len(prints)), "end": np.arange(1, len(prints) + 1)}
        while True:
            self.levels.append(level)
            sizes = np.diff(np.r_[start, len(level["value"])])
            if sizes.max() == 1:
                break
            nodes = -(-sizes // FAN)
            starts = np.concatenate([[0], np.cumsum(nodes)[:-1]])
            cut = np.repeat(start - starts * FAN, nodes) + np.arange(nodes.sum()) * FAN
            same = ~(np.bitwise_and.reduceat(level["value"], cut) ^ np.bitwise_or.reduceat(level["value"], cut))
            mask = np.bitwise_and.reduceat(level["mask"], cut) & same
            end = np.r_[cut[1:], len(level["value"])]
            level["rest"] = level["mask"] & ~np.repeat(mask, end - cut)  # what a child adds to the bits of its parent
            level = {"value": level["value"][cut] & mask, "mask": mask, "first": level["first"][cut], "end": level["end"][end - 1], "child": cut, "child_end": end}
            start = starts
        self.root_of = np.repeat(np.arange(len(start)), level["end"] - level["first"])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, leaf) links that connect exactly what pairs within DISTANCE connect."""
        n = len(self.prints)
        left, right = [], []
        for step in (1, 2):  # neighbours in Gray order, so that dense groups are one component from the start
            near = np.flatnonzero((np.bitwise_count(self.prints[step:] ^ self.prints[:-step]) <= DISTANCE) & (self.root_of[step:] == self.root_of[:-step]))
            left.append(near)
            right.append(near + step)
        known = [np.concatenate(left), np.concatenate(right)]
        root = roots(n, *known)
        for at in range(0, n, QUERIES):
            uniform = []
            for level in self.levels:
                low, high = (f.reduceat(root, level["first"]) for f in (np.minimum, np.maximum))
                uniform.append(np.where(low == high, low, -1))
            found = self._search(np.arange(at, min(n, at + QUERIES)), root, uniform)
            if len(found[0]):
                known = [np.concatenate([known[0], found[0]]), np.concatenate([known[1], found[1]])]
                new = roots(n, root[found[0]], root[found[1]])
                root = new[root]
                keep = known[0] != known[1]
                known = [known[0][keep], known[1][keep]]
        return known[0], known[1]

    def _search(self, queries: np.ndarray, root: np.ndarray, uniform: list[np.ndarray]) -> list[np.ndarray]:
        top = len(self.levels) - 1
        stack = [(top, queries, self.root_of[queries], np.zeros(len(queries), np.uint8))]
        found = [np.empty(0, np.int64), np.empty(0, np.int64)]
        while stack:
            depth, q, node, sofar = stack.pop()
            if depth == 0:
                found = [np.concatenate([found[0], q]), np.concatenate([found[1], node])]
                continue
            level, below = self.levels[depth], self.levels[depth - 1]
            fan = level["child_end"][node] - level["child"][node]
            total = np.cumsum(fan)
            if total[-1] > FRONTIER and len(q) > 1:
                half = max(1, int(np.searchsorted(total, total[-1] // 2)))
                stack += [(depth, q[half:], node[half:], sofar[half:]), (depth, q[:half], node[:half], sofar[:half])]
                continue
            child = np.repeat(level["child"][node] - (total - fan), fan) + np.arange(total[-1])
            q = np.repeat(q, fan)
            live = (below["end"][child] > q + 1) & (uniform[depth - 1][child] != root[q])  # later leaves, not yet connected
            q, child, sofar = q[live], child[live], np.repeat(sofar, fan)[live]
            sofar = sofar + np.bitwise_count((self.prints[q] ^ below["value"][child]) & below["rest"][child])
            near = sofar <= DISTANCE
            if near.any():
                stack.append((depth - 1, q[near], child[near], sofar[near]))
        return found


def _gray_rank(x: Column) -> Column:
    """The rank whose Gray code is x."""
    for step in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, step))
    return x


def _cut(rows: DataFrame, left: int) -> DataFrame:
    """Rows (key, rest, fp), whose fingerprints may still differ in `left` low bits of rest: a row for each of 4 blocks."""
    width = -(-left // 4)
    mask = (1 << left) - 1 if left < 64 else -1
    blocks = []
    for b in range(4):
        turned = F.col("rest") if b == 0 else F.shiftleft("rest", b * width).bitwiseOR(F.shiftrightunsigned("rest", left - b * width))
        turned = turned.bitwiseAND(F.lit(mask))
        value = F.shiftrightunsigned(turned, left - width)
        low = turned.bitwiseAND(F.lit((1 << (left - width)) - 1))
        blocks.append(F.struct(F.xxhash64("key", F.lit(b), value).alias("key"), low.alias("rest")))
    return rows.select(F.explode(F.array(*blocks)).alias("b"), "fp").select("b.key", "b.rest", "fp")


def linked(prints: DataFrame) -> DataFrame:
    """(u, v) links of distinct fingerprints (fp): a spanning set of the pairs within DISTANCE."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, ["key"], TREE_ROWS):
            key, fp = run["key"].to_numpy(), run["fp"].to_numpy().view(np.uint64)
            new = np.r_[True, key[1:] != key[:-1]]
            alone = new & np.r_[new[1:], True]
            key, fp = key[~alone], fp[~alone]
            if len(fp):
                tree = GrayTree(key, fp)
                u, v = tree.links()
                root = roots(len(fp), u, v)
                u = np.flatnonzero(root != np.arange(len(fp)))
                signed = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[u]), pa.array(signed[root[u]])], names=["u", "v"])

    rows, left, parts = prints.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), 64, []
    for width in LEVELS:
        rows = _cut(rows, left)
        left -= width
        if width == LEVELS[-1]:
            parts.append(rows)
            break
        large = saved(rows.groupBy("key").count().where(F.col("count") > GROUP_ROWS).select("key"), "large")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, "key", "left_anti"))
        rows = saved(rows.join(large, "key", "left_semi"), "split")
    edges = [
        p.select("key", _gray_rank(F.col("rest")).alias("rank"), "fp").repartition("key").sortWithinPartitions("key", "rank").mapInArrow(index, "u long, v long")
        for p in parts
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, fp) of documents, and (fp, root, least) of fingerprints: the group's name and the fingerprint's
    smallest doc_id. A group of copies of any size is one fingerprint, met first by a partial aggregate."""
    prints = saved(fingerprints(docs), "prints")
    each = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = components(linked(each.select("fp")))
    return prints, each.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of documents (doc_id, text), a row for each row.

    Texts without words, null or empty, have fingerprint zero and link like any other. Rows of one doc_id are handled
    each by its own text. component_id is the smallest doc_id reachable, null only where no reachable row has one.
    An empty table gives an empty one; other columns are not looked at.
    """
    prints, placed = _grouped(docs)
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The documents whose `identity` is in winners (h1, h2), one row of each: of rows that repeat id and text the one
    whose other columns have the smallest hash. Both steps share one shuffle of the documents."""
    h1, h2 = fresh(docs, "h1", "h2")
    a, b = identity(F.col("doc_id"), F.col("text"))
    rows = docs.select("*", a.alias(h1), b.alias(h2)).join(winners.toDF(h1, h2), [h1, h2], "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = rows.groupBy(h1, h2).agg(F.min_by(row, F.xxhash64(F.lit(0), *others)).alias("row"))
    return best.select("row.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group: the one with the smallest doc_id, null last, and of that id's rows in
    the group the one whose text has the smallest hash. Rows of one id in different groups stay each."""
    prints, placed = _grouped(docs)
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "h1", "h2")).alias("first")
    return kept(docs, prints.join(placed, "fp").groupBy("root").agg(first).select("first.h1", "first.h2"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
