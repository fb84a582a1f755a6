"""Near copies of the pipeline against all pairs by brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("inkwell.llm")
import corpus_pipeline  # noqa: E402
from inkwell.llm import common, nearcopies  # noqa: E402


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or (bool(a and b) and len(a & b) >= 0.8 * len(a | b))


@pytest.mark.parametrize("bucket", [4096, 4])
def test_pipeline_drops_near_copies_that_are_not_exact(spark, monkeypatch, bucket):
    monkeypatch.setattr(nearcopies, "BUCKET", bucket)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(None, "no id", "a"), (9000, None, "a"), (9001, " \n", "a"), (9002, "Short text", "a"), (9003, "short  TEXT", "b")]
    for group in range(25):
        base = [word() for _ in range(r.randint(60, 300))]
        for copy in range(6):  # from the same words to a similarity far below 0.8
            changed = list(base)
            for at in r.sample(range(len(base)), len(base) * copy // 100):
                changed[at] = word()
            rows.append((group * 10 + copy, " ".join(changed), "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sets = [grams(t) for _, t, _ in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])]
    root = common.roots(len(rows), np.array([a for a, _ in near]), np.array([b for _, b in near]))
    expected, last = {}, 1 << 60
    for k, (i, _, _) in enumerate(rows):
        expected[root[k]] = min(last if i is None else i, expected.get(root[k], last))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(last if x.doc_id is None else x.doc_id for x in kept) == sorted(expected.values())
    none = corpus_pipeline.drop_near_copies(spark, docs.limit(0), "")
    assert none.count() == 0 and none.columns == docs.columns


def test_shingles_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    whole = nearcopies.shingles(text)
    assert len(whole) == len(grams(text))
    monkeypatch.setattr(nearcopies.simhash, "PIECE", 37)
    assert (nearcopies.shingles(text) == whole).all()


def test_links_in_a_bucket_connect_what_all_pairs_connect():
    r = np.random.default_rng(8)
    for apart in (False, True):
        for _ in range(30):
            n = int(r.integers(2, 25))
            base = r.integers(0, 1 << 40, (3, 40))
            sets = [np.unique(np.concatenate([base[k % 3][: int(r.integers(30, 41))], r.integers(0, 1 << 40, int(r.integers(0, 5)))])) for k in range(n)]
            node, root, block = np.arange(n) * 7, r.integers(0, 5, n), r.integers(0, 2, n)
            links = nearcopies._bucket_links(node, root, block, apart, sets)
            def near(i, j):
                both = len(np.intersect1d(sets[i], sets[j]))
                return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

            pairs = [(i, j) for i in range(n) for j in range(i) if (not apart or block[i] != block[j]) and near(i, j)]
            joined = lambda found: common.roots(n + 5, np.r_[np.array([a for a, _ in found], int), np.arange(n)], np.r_[np.array([b for _, b in found], int), n + root])  # noqa: E731, B023
            roots = joined(pairs), joined([(u // 7, v // 7) for u, v in links])
            assert (roots[0] == roots[1]).all()
            assert len(links) < n


def test_line_stage_leaves_columns_of_its_own_names_alone(spark):
    text = "one\ntwo\nthree\nfour"
    docs = spark.createDataFrame([(1, text, 7, "a", 18), (2, text + "\nfive", 8, "b", 23)], "doc_id long, text string, n_removed int, N_Lines string, n_chars long")
    out = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, 7, "a", 18), (2, "five", 8, "b", 4)]
