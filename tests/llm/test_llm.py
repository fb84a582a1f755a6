"""The operators against brute force, exact round trips and held-out accuracy, and the edge cases of their docstrings."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("inkwell.llm")
from inkwell.llm import ann, bpe, common, embdedup, langid, linededup, mixing, nearcopies, quality, simhash, tokencount, toxicity  # noqa: E402
from inkwell.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, size string"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def make_docs(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], DOCS)


BASE = prose(400, 1)
EDGES = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "word", "a"), (5, "two words", "b"), (6, BASE, "a"), (7, BASE, None), (8, BASE + " end", "a"),
    (9, prose(60_000, 2), "a"), (10, "x" * 50_000, "b"), (11, prose(30, 3), "c"), (11, prose(30, 3), "c"), (None, prose(20, 4), "a"), (12, "ÄÖ ΟΔΟΣ İ 日本語 <|endoftext|>it's", "d"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return make_docs(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make_docs(spark, [])


def test_run_pairs_and_roots():
    got = set()
    for i, j in common.run_pairs(np.array([0, 3, 4]), np.array([3, 1, 4]), 3):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == {(0, 1), (0, 2), (1, 2)} | {(a, b) for a in range(4, 8) for b in range(a + 1, 8)}
    assert common.roots(5, np.array([3, 4]), np.array([1, 3])).tolist() == [0, 1, 2, 1, 1]


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    root = common.roots(len(nodes), np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]))
    loops = {x for a, b in pairs if a == b for x in (a,)} - {x for a, b in pairs if a != b for x in (a, b)}
    expected = {x: nodes[root[at[x]]] for x in nodes if x not in loops}
    assert {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()} == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_mix(rows, weights=(1, 2, 3), cap=3):
    size = [(i, s, len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")) for i, t, s in rows]
    total = defaultdict(int)
    for _, s, n in size:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(cap * total[s] for s in capped)
        level = rest / max(1, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * weight[s] > cap * total[s]}
        if not over:
            break
        capped |= over
    return size, total, {s: cap * total[s] if s in capped else level * weight[s] for s in order}


def test_mixing(spark, edges, empty):
    rows = [(i, prose(rng.randint(1, 60), i), f"s{i % 7 if i % 3 else 0}") for i in range(20, 900)] + EDGES
    got = mixing.mix_sources(make_docs(spark, rows)).collect()
    size, total, target = brute_mix(rows)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for i, _, n in size)
    source = {(i or -1): s for i, s, _ in size}
    taken = Counter()
    for r in got:
        s = source[r.doc_id or -1]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s], rel=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(n for i, t, n in size if t == s)
    again = mixing.mix_sources(make_docs(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(make_docs(spark, rows))
    assert mixed.columns == make_docs(spark, rows).columns
    copies = {r.doc_id: r.copies for r in got}
    expected = Counter()
    for i, t, _ in rows:
        expected[(i, t)] += copies[i]
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +expected
    clash = make_docs(spark, rows).select("doc_id", "text", "source", *(F.lit("mine").alias(c) for c in ["mix", "Key", "copy", "_mix", "size", "place"]))
    assert mixing.mixed_documents(clash).columns == clash.columns
    assert Counter(mixing.mixed_documents(clash).select("doc_id", "text", "mix", "Key").collect()) == Counter({(*k, "mine", "mine"): n for k, n in (+expected).items()})
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def brute_lines(rows):
    blank = set(" \t\n\x0b\x0c\r")
    seen, out, first = set(), {}, {}
    for i, t in sorted({(i, t) for i, t, _ in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = t.split("\n")
        real = [k for k, x in enumerate(lines) if set(x) - blank]
        gone = set()
        for p in range(len(real) - 2):
            win = tuple(lines[k] for k in real[p : p + 3])
            if win in seen:
                gone |= set(real[p : p + 3])
            seen.add(win)
        out[(i, t)] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        first[(i, t)] = len(gone)
    return out, first


def test_line_dedup(spark, edges, empty):
    r = random.Random(5)
    rows = [(100 + i, "\n".join(r.choice(["", "  ", "a", "b", "c", "dd", "e e"]) for _ in range(r.randint(0, 12))), "a") for i in range(150)] + EDGES
    got = linededup.dedup_lines(make_docs(spark, rows)).collect()
    text, gone = brute_lines(rows)
    expected = Counter((i, text.get((i, t)), gone.get((i, t), 0)) for i, t, _ in rows)
    assert Counter((x.doc_id, x.text, x.n_removed) for x in got) == expected
    clash = make_docs(spark, rows).select("doc_id", "text", *(F.lit(i).alias(c) for i, c in enumerate(["gone", "gone_id", "Gone_Whole", "h1", "lines"])))
    again = linededup.dedup_lines(clash)
    assert again.columns == [*clash.columns, "n_lines", "n_removed"]
    assert Counter((x.doc_id, x.text, x.n_removed) for x in again.collect()) == expected
    assert linededup.dedup_lines(empty).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    count = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        count += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if count[b] * 2 > len(grams))


def test_simhash_of_long_texts(monkeypatch):
    text = prose(3000, 9) + "  \n " + prose(50, 8)
    whole = brute_print(text)
    for size in (1 << 20, 1000, 37):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole


def test_simhash(spark, edges, empty):
    rows = EDGES + [(200 + i, " ".join((BASE + f" tail{i}").split()[i % 5 :]), "a") for i in range(60)] + [(900, "", "b"), (901, None, "b")]
    got = simhash.near_duplicates(make_docs(spark, rows)).collect()
    prints = [(i, brute_print(t)) for i, t, _ in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(prints)
    distinct = sorted({p for _, p in prints})
    near = [(a, b) for a in range(len(distinct)) for b in range(a) if (distinct[a] ^ distinct[b]).bit_count() <= 3]
    root = common.roots(len(distinct), np.array([a for a, _ in near]), np.array([b for _, b in near]))
    least = {}
    for i, p in prints:
        k = root[distinct.index(p)]
        least[k] = min(least.get(k, 1 << 60), i if i is not None else 1 << 60)
    assert all((r.component_id if r.component_id is not None else 1 << 60) == least[root[distinct.index(r.fp % (1 << 64))]] for r in got)
    kept = simhash.one_of_each(make_docs(spark, rows)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else 1 << 60 for r in kept) == sorted(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_each_keeps_every_text_of_a_repeated_id(spark):
    b, q = prose(80, 71), prose(80, 72)
    docs = make_docs(spark, [(1, b, "a"), (1, q, "a"), (2, b, "a"), (3, q, "a"), (None, b, "c"), (None, None, "c"), (1, b, "b")]).toDF("doc_id", "text", "h1", "H2", "fp", "root", "first", "row")
    for keep in (simhash.one_of_each, nearcopies.one_of_each):
        got = keep(docs)
        assert got.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == {(1, b): 1, (1, q): 1, (None, None): 1}
        assert sorted(map(str, got.collect())) == sorted(map(str, keep(docs.repartition(3)).collect()))


@pytest.mark.parametrize("cap", [50_000, 40])
def test_gray_index_finds_every_link(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "GROUP_ROWS", cap)
    r = random.Random(cap)
    center = [r.getrandbits(64) for _ in range(20)]
    prints = {0, (1 << 64) - 1} | {c for c in center}
    for c in center[:4]:
        for _ in range(250):
            x = c
            for b in r.sample(range(64), r.randint(1, 7)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = common.roots(len(prints), np.array([a for a, _ in near]), np.array([b for _, b in near]))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(prints.index(e.u % (1 << 64)), prints.index(e.v % (1 << 64))) for e in simhash.linked(df).collect()]
    assert (common.roots(len(prints), np.array([a for a, _ in links]), np.array([b for _, b in links])) == root).all()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_bpe_and_counts(spark, edges, empty, library):
    r = random.Random(11)
    bits = ["a", "A", "ß", "é", "é", "İ", "Σ", " ", "\n", " ", "\x1c", "\x85", "'s", "'LL", "1", "٣", "!", "...", "<|endoftext|>", "<|", "日本語", "👍🏽", "aaaaaaa", "ing", "the", "　", "½"]
    rows = EDGES + [(300 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 40))), "a") for i in range(300)]
    docs = make_docs(spark, rows)
    expected = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(x) for x in bpe.encoding_digests(docs).collect()) == expected
    counts = tokencount.token_counts(docs).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in counts) == Counter({k: n for k, n in Counter((k[0], k[1]) for k in expected.elements()).items()})
    assert all(x.over_limit == (x.n_tokens > 2048) for x in counts)
    encoded = bpe.encode_documents(docs)
    decoded = bpe.decode_documents(encoded).collect()
    assert Counter((x.doc_id, hashlib.sha256(x.text.encode()).hexdigest()) for x in decoded) == Counter((k[0], k[3]) for k in expected.elements())
    for f in (bpe.encoding_digests, bpe.encode_documents, tokencount.token_counts):
        assert f(empty).count() == 0


def test_pieces_keep_words():
    data = prose(5000, 5).encode()
    assert b" ".join(bpe.pieces(data, 100)).split() == data.split()
    assert list(bpe.pieces(b"x" * 500, 100)) == [b"x" * 500] and list(bpe.pieces(b"", 100)) == [b""]


VECTORS = "vec_id long, embedding array<float>, label int, key string, links string"


def vector_rows(seed=1):
    r = np.random.default_rng(seed)
    base = r.standard_normal((60, 16)).astype(np.float32)
    rows = []
    for i in range(400):
        x = base[i % 60] + r.standard_normal(16).astype(np.float32) * [0.02, 0.1, 0.25][i % 3]
        rows.append((i, x.tolist(), i % 60 % 3, "k", "l"))
    rows += [(500 + i, rows[0][1], 0, "k", "l") for i in range(5)]  # copies
    rows += [(600, None, 0, "k", "l"), (601, [], 0, "k", "l"), (602, [0.0] * 16, 0, "k", "l"), (603, [float("nan")] * 16, 0, "k", "l"), (604, [None] * 16, 0, "k", "l"), (605, rows[0][1], None, "k", "l"), (606, [1.0, 2.0], 0, "k", "l"), (607, [float("inf")] * 16, 0, "k", "l")]
    return rows


@pytest.mark.parametrize("cap", [8192, 8])
def test_embedding_dedup(spark, monkeypatch, cap):
    monkeypatch.setattr(embdedup, "BUCKET_ROWS", cap)
    rows = vector_rows()
    got = {r.vec_id: r for r in embdedup.dedup_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label) for i, v, label, *_ in rows if (i < 600)]
    x, label = np.array([v for _, v, _ in good]), np.array([k for _, _, k in good])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i, _, _ in good)
    assert len(got) == len(rows) and 0.95 * link.sum() <= found <= link.sum()
    assert all(got[i].n_links <= link[k].sum() for k, (i, _, _) in enumerate(good))
    assert all(got[i].n_links >= 5 for i in (0, 500, 504))
    for i in range(600, 608):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    root = common.roots(len(good), *np.nonzero(link))
    same = np.mean([got[i].component_id == good[root[k]][0] for k, (i, _, _) in enumerate(good)])
    assert same > 0.95
    assert embdedup.dedup_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_dedup_at_any_magnitude_and_with_repeated_ids(spark):
    kind = "vec_id long, embedding array<double>, label string"
    rows = [(1, [1e200, 1e200], "a"), (2, [1e200, 1.01e200], "a"), (3, [1e-200, 1e-200], "a"), (4, [1e200, 1e200], "b"), (5, [5e-324, 5e-324], "b"), (6, [-3.0], "a"), (7, [2.0], "a"), (8, [9.0], "a"), (9, [1e308, -1e308], "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.dedup_vectors(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9)}
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, "a"), (2, x, "a"), (2, y, "a"), (3, y, "a"), (3, y, "a"), (4, [0.0, 0.0, 1.0], "a")]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embdedup.dedup_vectors(spark.createDataFrame(rows, kind)).collect())
    assert got == {(1, 1, 1): 1, (2, 1, 1): 1, (2, 2, 1): 1, (3, 2, 1): 2, (4, 0, 4): 1}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 32)).astype(np.float32)
    assert np.allclose(np.linalg.norm(embdedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    assert np.allclose(embdedup.hadamard(embdedup.hadamard(x)), x, atol=1e-5)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    good = {i: np.array(v, float) for i, v, *_ in rows if i < 600 or i == 605}
    hit = total = 0
    for q in [i for i in good if i % 50 == 0]:
        best = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({i for _, i in best} & {r.vec_id for r in own})
        total += 10
    assert hit / total >= 0.9
    assert {r.query_id for r in got} == {i for i in good if i % 50 == 0}
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few).count() == 6
    tie = spark.createDataFrame([(9, [1.0]), *((i, [float(1 + i % 3)]) for i in range(100, 130))], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(ann.nearest(tie, tie.where("vec_id = 9")).collect(), key=lambda r: r["rank"])] == [(k + 1, 102 + 3 * k, 0.0) for k in range(10)]
    assert ann.nearest(spark.createDataFrame([], VECTORS), spark.createDataFrame([], VECTORS)).count() == 0


def brute_nearest(rows, queries, k=10):
    """Distances in unbounded precision."""
    from decimal import Decimal

    out = {}
    for q in queries:
        own = dict(rows)[q]
        away = sorted((sum((Decimal(a) - Decimal(b)) ** 2 for a, b in zip(v, own)).sqrt(), i) for i, v in rows if i != q and len(v) == len(own))
        out[q] = [(i, float(d)) for d, i in away[:k]]
    return out


def test_nearest_at_any_magnitude(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(4).tolist()) for i in range(30)]
    rows += [(100 + i, (r.standard_normal(4) * 1e307).tolist()) for i in range(14)] + [(200 + i, (r.standard_normal(4) * 1e-200).tolist()) for i in range(14)] + [(300, [1e308, 1e308, 0.0, 0.0]), (302, [3.0]), (304, [5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 2 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q, best in brute_nearest(rows, [i for i, _ in rows if i % 2 == 0]).items():
        own = sorted(got.get(q, []))
        assert [i for _, i, _ in own] == [i for i, _ in best]
        assert [s for *_, s in own] == pytest.approx([d for _, d in best], rel=1e-9)


def test_nearest_over_several_cells_of_default_size(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal((300, 24))
    x = (base[r.integers(0, 300, 40_000)] + 0.4 * r.standard_normal((40_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    assert len(x) > 2 * ann.BLOCK_ROWS
    got = {}
    for row in ann.nearest(df, df.where("vec_id % 400 = 0")).collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    x, hit = x.astype(float), 0
    for q in range(0, len(x), 400):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(got[q]))
    assert hit >= 0.95 * 10 * len(got) and len(got) == 100


def test_cells_out_of_reach_are_not_searched(spark):
    ends = spark.createDataFrame([(2, c, 5, [v - 1.0] * 64, [v + 1.0] * 64) for c, v in enumerate([0.0, 3.0, 500.0])], "dim int, cell int, n long, low array<double>, high array<double>")
    queries = spark.createDataFrame([(7, [0.1, 0.1], 2, 0, 10, 4.0), (8, [0.1, 0.1], 2, 0, 10, float("inf"))], "query_id long, embedding array<double>, dim int, cell int, k int, limit double")
    assert {(r.query_id, r.cell) for r in ann._near_cells(queries, ends).collect()} == {(7, 1), (8, 1), (8, 2)}


SYLLABLES = {"en": ["th", "ing", "er", "wh", "ea"], "fr": ["eau", "é", "que", "oi", "ç"], "ru": ["при", "вет", "ст", "ж", "ов"]}


def speech(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_language_id(spark, empty):
    rows = [(i, speech(lang := ["en", "fr", "ru"][i % 3], 60, i), lang) for i in range(150)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(train)
    mixed = speech("en", 30, "m") + ". " + speech("fr", 12, "m") + "\n" + speech("ru", 9, "m")
    docs = make_docs(spark, [*EDGES, (700, mixed, "a"), (701, "12345 !!", "a"), (703, "1\u0301 \u0302", "a"), (702, speech("ru", 40, "x"), "a")])
    got = {r.doc_id: r for r in langid.label_spans(docs, model).collect()}
    assert [s.lang for s in got[700].spans] == ["en", "fr", "ru"] and got[700].lang_pred == "en" and 0 < got[700].score < 1
    assert got[702].lang_pred == "ru"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 701, 703))
    held = langid.label_spans(train, model).join(train.select("doc_id", "lang"), "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    nothing = langid.learn(train.limit(0))
    assert {r.lang_pred for r in langid.label_spans(docs, nothing).collect()} == {"und"}
    assert langid.label_spans(empty, model).count() == 0


def test_viterbi_against_all_paths(monkeypatch):
    from itertools import product

    r = np.random.default_rng(2)
    size = np.array([5, 1, 0, 6])
    score = r.standard_normal((12, 3)).astype(np.float32) * 8
    first = np.r_[0, np.cumsum(size)[:-1]]
    path = langid._viterbi(score, first, size)
    for f, n in zip(first, size):
        worth = lambda p: sum(score[f + t, s] for t, s in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert n == 0 or worth(path[f : f + n]) == pytest.approx(max(map(worth, product(range(3), repeat=int(n)))), abs=1e-3)


def labelled(spark, n=260):
    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        bad, toxic = i % 4 == 0, i % 3 == 0
        words = (["##spam##"] * 40 if bad else [r.choice(WORDS) for _ in range(r.randint(20, 120))])
        if toxic:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(["zurk", "zurks", "blarg"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(not bad), int(toxic)))
    return make_docs(spark, rows), spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 0), (5001, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, edges, empty):
    docs, labels = labelled(spark)
    net = toxicity.learn(docs, labels)
    got = toxicity.toxicity(docs, net).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    out = toxicity.toxicity(edges, net).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.score == 0 for r in out if r.doc_id in (1, 2, 3))
    kept = toxicity.without_toxic(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.toxicity(docs, net).where("predicted = 0").collect()}
    assert toxicity.toxicity(empty, net).count() == 0
    untrained = toxicity.learn(docs, labels.limit(0))
    assert toxicity.toxicity(docs, untrained).count() == docs.count()


def test_toxicity_scores_every_window(monkeypatch):
    text, start, size = toxicity.windows(np.array([0, 100, 100]), np.array([100, 0, 10]))
    assert text.tolist() == [0] * 6 + [2] and start.tolist() == [0, 16, 32, 48, 64, 68, 100] and size.tolist() == [32] * 6 + [10]


def test_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network({b"a": 0, b"c": 1}, np.array([0.5, -0.5]), r.standard_normal(1 << toxicity.GRAM_BITS), r)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs([b"a", b"bb", b"c", b"dd"])[0].astype(np.float64)
    ids, mask, y = r.integers(0, 4, (5, 6)), np.arange(6) < r.integers(1, 7, 5)[:, None], np.array([0, 1, 1, 0, 1.0])

    def loss():
        logit = net.logits(net.gates(x), ids, mask).astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(y > 0, logit, -logit))))

    g, d_x = net.gradients(x, ids, mask, y)
    for v, d in [(net.p[k], g[k]) for k in ("rec_f", "rec_b", "in_f", "in_b", "bias_f", "bias_b", "att", "out")] + [(x, d_x)]:
        for i in np.ndindex(*[min(2, n) for n in v.shape]):
            old, v[i] = v[i], v[i] + 1e-2
            up = loss()
            v[i] = old - 1e-2
            down = loss()
            v[i] = old
            assert d[i] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_quality(spark, edges, empty):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels)
    assert model.rules
    got = quality.quality(docs, model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    out = quality.quality(edges, model).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert "Python" not in quality.quality(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert quality.quality(empty, model).count() == 0
    assert {r.score for r in quality.quality(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    copies = make_docs(spark, [(1000 + i, BASE + "\n" + prose(3, i), "b") for i in range(8)])
    docs = docs.unionByName(copies).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(step.count())
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    left = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/toxicity").collect()]
    assert len(toxic & set(left)) < 0.1 * len(toxic) and len({r.doc_id for r in docs.collect()} - toxic - set(left)) < 0.05 * docs.count()
    near = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/simhash_dedup").collect()]
    assert sum(1000 <= i < 1008 for i in near) == 1 and len(near) == len(set(near))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in step.collect())
