"""Every registered query of the operators on a small folder of tables: columns, types, rules of its result; the scores of
the classifiers against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

pytest.importorskip("inkwell.llm")
import __spark_entry__ as entry  # noqa: E402
from inkwell.llm import common, quality, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(i):
    r = random.Random(i)
    lang = ["th ing er wh ea".split(), "eau é que oi ç".split()][i % 2]
    words = ["".join(r.choice(lang) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 90))]
    if i % 4 == 1:
        words += ["##"] * 40
    if i % 3 == 0:
        for _ in range(3):
            words.insert(r.randint(0, len(words)), "zurk")
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, text_of(i), ["en", "fr"][i % 2], f"s{i % 5}" if i % 11 else None) for i in range(240)]
    rows += [(300 + i, text_of(0), "en", "s0") for i in range(6)] + [(400, None, "en", "s1"), (401, "", None, None), (402, "日本語　🄰 12", "en", "s2"), (403, "x" * 3000, "fr", "s3"), (404, chr(0x32010) * 4, "zz", "s4")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 1), int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    r = np.random.default_rng(3)
    base = r.standard_normal((20, 16))
    vectors = [(i, (base[i % 20] + 0.05 * (i % 7) * r.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(310)] + [(400, None, 1), (500, [0.0] * 16, 0), (600, [1.0] * 16, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows, vectors


@pytest.fixture(scope="module")
def run(spark, tables):
    def call(name):
        df = entry.queries()[next(n for n in entry.queries() if n.split("_")[0] == name)](spark, tables[0])
        return dict(df.dtypes), df.collect()

    return call


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(run, tables):
    kinds, got = run("op1")
    assert {k: kinds[k] for k in ("doc_id", "size", "source_size", "target", "taken")} == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    source, size, taken, target = {i: s for i, _, _, s in tables[1]}, Counter(), Counter(), {}
    assert {r.doc_id: r.size for r in got} == {i: len(WORD.findall(t or "")) for i, t, *_ in tables[1]}
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in got if source[r.doc_id] == s) for s in size) and sum(target.values()) == pytest.approx(sum(size.values()))


def plain_toxicity(net, text):
    """A text's score: windows one by one, steps one by one."""
    words = toxicity.words_of(text)
    if not words:
        return 0.0
    p, h = net.p, toxicity.HIDDEN

    def vector(w):
        row = net.vocabulary.get(w, -1)
        grams, _ = toxicity._grams([w.decode()])
        return np.concatenate([p["word"][row], p["gram"][grams].mean(0), [net.odds[row] if row >= 0 else 0.0], [net.gram_odds[grams].mean()]])

    def layer(xs, side):
        state, states = np.zeros(h), []
        for x in xs:
            a, u = x @ p[f"in_{side}"] + p[f"bias_{side}"], state @ p[f"rec_{side}"]
            z, r = 1 / (1 + np.exp(-(a[:h] + u[:h]))), 1 / (1 + np.exp(-(a[h : 2 * h] + u[h : 2 * h])))
            c = np.tanh(a[2 * h :] + r * u[2 * h :])
            state = z * state + (1 - z) * c
            states.append(state)
        return states

    best, starts = -math.inf, [*range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STEP), max(0, len(words) - toxicity.WINDOW)]
    for start in starts:
        xs = [vector(w) for w in words[start : start + toxicity.WINDOW]]
        states = [np.concatenate(s) for s in zip(layer(xs, "f"), layer(xs[::-1], "b")[::-1])]
        e = np.array([s @ p["att"] for s in states])
        w = np.exp(e - e.max())
        best = max(best, float((w / w.sum()) @ np.array(states) @ p["out"] + p["out_bias"][0]))
    return 1 / (1 + math.exp(-best))


def test_op2(spark, run, tables, monkeypatch):
    kinds, got = run("op2")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and len(got) == len(tables[1])
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, r.doc_id % 3 == 0) for r in got if r.doc_id < 240 and r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.9
    read = lambda n: spark.read.parquet(f"{tables[0]}/{n}.parquet")
    net = toxicity.learn(read("documents"), read("labels"))
    score = {r.doc_id: r.score for r in got}
    for i, text, *_ in tables[1][:40] + tables[1][-6:]:
        assert score[i] == pytest.approx(plain_toxicity(net, text), abs=2e-4)
    long = " ".join(text_of(i) for i in range(0, 60))
    whole = toxicity.score_texts(net, [long, "", long + " zurk"])
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 100)  # part by part: a window may start elsewhere, no word is left out
    parts = toxicity.score_texts(net, [long, "", long + " zurk"])
    assert parts[1] == 0 and np.allclose(whole, parts, atol=0.05)
    assert [r.predicted for r in toxicity.toxicity(read("documents"), net).where("doc_id in (0, 3)").collect()] == [1, 1]


def test_op2_learns_from_long_texts(spark):
    """One passage in a text of 40,000 characters, at a place of its own in each."""
    plain = lambda i: [text_of(i * 4 + 2 + k).replace("zurk", "th") for k in range(0, 1000, 4)]
    rows = []
    for i in range(60):
        parts = plain(i)
        parts.insert((i * 37) % len(parts), "zurk zurk zurk zurk" if i % 2 else "th th")
        rows.append((i, " ".join(parts), i % 2))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    net = toxicity.learn(docs, labels)
    assert b"zurk" in net.vocabulary
    assert np.mean([r.predicted == r.doc_id % 2 for r in toxicity.toxicity(docs, net).collect()]) > 0.9


def test_samples_hold_whole_texts(spark):
    """Rows by hash until the characters of a label are used up; longer texts are no rows of the sample; one row an id."""
    docs = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(100)] + [(3, "y" * 5), (200, "z" * 5000), (201, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(i, i % 2) for i in [*range(100), 200, 201]], "doc_id long, label int")
    got = common.sampled(docs, ids, 1000).collect()
    assert all(r.text == ("y" * 5 if r.doc_id == 3 else "x" * (10 + r.doc_id)) for r in got)
    for label in (0, 1):
        size = sum(len(r.text) for r in got if r.label == label)
        assert 800 < size <= 1000
    assert {r.doc_id for r in common.sampled(docs, ids, 10**6).collect()} == {*range(100), 200}


def test_op8_learns_from_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, share, names: seen.append(len(y)))
    quality.learn(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int"))
    assert seen == [sum(not out(i) for i in (1, 2))]


def test_op3(run, tables):
    kinds, got = run("op3")
    assert {k: kinds[k] for k in ("doc_id", "held_out", "lang_pred", "score")} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    found = {r.doc_id: r for r in got}
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got) and len(found) == len(tables[1])
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {400, 401}
    assert found[404].lang_pred != "und"  # letters far behind the basic plane
    assert np.mean([found[i].lang_pred == lang for i, _, lang, _ in tables[1] if i < 240 and out(i)]) > 0.9


def test_op4(run, tables):
    kinds, got = run("op4")
    assert {k: kinds[k] for k in ("doc_id", "fingerprint", "component_id")} == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}

    def brute(text):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: brute(t) for i, t, *_ in tables[1]}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    least = {i: i for i in prints}
    for _ in prints:
        new = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == least:
            break
        least = new
    assert {r.doc_id: r.component_id for r in got} == least


def test_op5_and_op10(run, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kinds, got = run("op5")
    counts, counted = run("op10")
    assert kinds == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert counts == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    found, known = {r.doc_id: r for r in got}, {r.doc_id: r for r in counted}
    for i, text, *_ in tables[1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tuple(found[i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert tuple(known[i]) == (i, len((text or "").encode()), len(ids), len(ids) > 2048)


def test_op6(run, tables):
    kinds, got = run("op6")
    assert kinds == {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_removed": "bigint"} and len(got) == len(tables[1])
    assert {r.doc_id: r.text for r in got}[403] == "x" * 3000 and {r.doc_id: r.text for r in got}[400] is None


def test_op7(run, tables):
    kinds, got = run("op7")
    assert {k: kinds[k] for k in ("query_id", "rank", "vec_id", "score")} == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    good = {i: np.array(v, float) for i, v, _ in tables[2] if v is not None and any(v)}
    by, hit = defaultdict(list), 0
    for r in got:
        assert r.score == pytest.approx(float(np.linalg.norm(good[r.query_id] - good[r.vec_id])), rel=1e-12)
        by[r.query_id].append((r["rank"], r.score, r.vec_id))
    assert set(by) == {i for i in good if i % 100 == 0}
    for q, rows in by.items():
        rows.sort()
        assert [k for k, *_ in rows] == list(range(1, 11)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
        best = sorted((float(np.linalg.norm(v - good[q])), i) for i, v in good.items() if i != q)[:10]
        hit += len({i for _, i in best} & {i for *_, i in rows})
    assert hit >= 9 * len(by)


def test_op8(spark, run, tables):
    kinds, got = run("op8")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} and len(got) == len(tables[1])
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    read = lambda n: spark.read.parquet(f"{tables[0]}/{n}.parquet")
    model = quality.learn(read("documents"), read("labels"))

    def statistics(text):
        text = text or ""
        words, lines = re.split(r"[\x20\x09-\x0D]+", text), text.split("\n")
        chars, count = max(1, len(text)), lambda pattern: len(re.findall(pattern, text))
        return {
            "chars": len(text), "words": len(words), "word_length": len(text) / len(words), "line_words": len(words) / len(lines), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines),
            "capitals": count("[A-Z]") / chars, "digits": count("[0-9]") / chars, "marks": count("[!?]") / chars, "stops": count("[.,;:]") / len(words), "symbols": count(r"[#$%&*+=<>^~@_\\|{}\[\]/]") / chars,
            "bars": count("[|]") / len(words), "beyond_ascii": count(r"[^\x00-\x7F]") / chars,
        }

    score = {r.doc_id: r.score for r in got}
    for i, text, *_ in tables[1]:
        s = statistics(text)
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if all((s[n] > cut) == above for n, above, cut in rule))
        assert score[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_op9(run, tables):
    kinds, got = run("op9")
    assert {k: kinds[k] for k in ("vec_id", "n_links", "component_id", "kept")} == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"} and len(got) == len(tables[2])
    good = [(i, np.array(v, float) / np.linalg.norm(v), k) for i, v, k in tables[2] if v is not None and any(v) and k is not None]
    links = {i: {j for j, y, m in good if j != i and m == k and x @ y >= 0.93} for i, x, k in good}
    found = {r.vec_id: r for r in got}
    assert all(found[i].n_links <= len(links.get(i, ())) for i in found)
    assert sum(r.n_links for r in got) >= 0.95 * sum(map(len, links.values()))
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in got)
    assert all((found[i].n_links, found[i].component_id) == (0, i) for i in (400, 500, 600))


def test_samples_do_not_depend_on_partitions(spark, tables):
    from inkwell.llm.common import held_out, training_ids
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("toxic"))
    want = defaultdict(list)
    for r in rows.where(~held_out(F.col("doc_id"))).select("*", F.xxhash64("doc_id").alias("h")).collect():
        want[r.toxic].append((r.h, r.doc_id))
    for n in (1, 7):
        got = defaultdict(set)
        for r in training_ids(rows.unionAll(rows).repartition(n), "toxic", 1500).collect():
            got[r.label].add(r.doc_id)
        assert got == {k: {i for _, i in sorted(v)[:1500]} for k, v in want.items()}


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from inkwell.llm import common

    conf = SimpleNamespace(get=lambda key, default: default)
    on = lambda master, at=None: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: at))
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(on(master))
        assert common.shared_dir(on(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(on("local[4]")).startswith("file:///")
