"""Measures what the approximate operators find against brute force: python tests/llm/recall.py FOLDER [near | vectors]."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from inkwell.llm import ann, embdedup, nearcopies, simhash  # noqa: E402


def near(folder):
    """Of all pairs of different shingle sets with similarity 0.8 or more (inverted lists of shingles, nothing left out):
    how many meet in a band, differ in 3 bits at most, or have the same component."""
    import duckdb

    sets, prints = {}, {}
    for (text,) in duckdb.sql(f"select text from '{folder}/documents.parquet'").fetchall():
        grams = nearcopies.shingles(text)
        sets.setdefault(grams.tobytes(), grams)
        prints.setdefault(grams.tobytes(), simhash.fingerprint(text, nearcopies.SHINGLE))
    sets, prints = list(sets.values()), list(prints.values())
    lists = defaultdict(list)
    for i, g in enumerate(sets):
        for x in g.tolist():
            lists[x].append(i)
    pairs = []
    for i, g in enumerate(sets):
        shared = Counter(j for x in g.tolist() for j in lists[x] if j < i)
        pairs += [(i, j) for j, n in shared.items() if n >= nearcopies.SIMILARITY * (len(g) + len(sets[j]) - n)]
    keys = [set(nearcopies.bands(g)) for g in sets]
    band, gray = [bool(keys[i] & keys[j]) for i, j in pairs], [(prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE for i, j in pairs]
    print(f"{len(sets)} sets, {len(pairs)} pairs: in a band {np.mean(band):.4f}, within {simhash.DISTANCE} bits {np.mean(gray):.4f}, either {np.mean(np.array(band) | np.array(gray)):.4f}")


def vectors(folder):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, label, x = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = 0
    for a in range(0, len(x), 2000):
        links += int(((unit[a : a + 2000] @ unit.T >= embdedup.COSINE) & (label[a : a + 2000, None] == label)).sum())
    links -= len(x)
    found = embdedup.dedup_vectors(table).agg(F.sum("n_links")).first()[0]
    got = defaultdict(set)
    for r in ann.nearest(table, table.where(f"vec_id % {ann.EVERY} = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in got:
        d = ((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1)
        d[ids == q] = np.inf
        hit += len(got[q] & set(ids[np.argsort(d, kind="stable")[: ann.NEAREST]].tolist()))
    print(f"links found {found} of {links}: {found / max(1, links):.4f}; nearest found {hit / max(1, ann.NEAREST * len(got)):.4f} of {len(got)} queries")


if __name__ == "__main__":
    for what in sys.argv[2:] or ["near", "vectors"]:
        {"near": near, "vectors": vectors}[what](sys.argv[1])
