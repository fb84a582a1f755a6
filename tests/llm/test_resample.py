"""Importance resampling against plain loops over words, with every odd table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("inkwell.llm")
from inkwell.llm import resample as R  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in found]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)}
    out = []
    for i, text in docs:
        n, found = plain_features(text)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_enough = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0], x[2]))
    for k, x in enumerate(long_enough[: 25 * len(long_enough) // 100]):
        x[5] = k + 1
    return out


def some_text(i):
    r = random.Random(i)
    parts = ["The", "quick", "Über", "日本語", "ß", "a1", "x", "CRC", "don't", "e-mail", "—", "\x00", "@", "`q{", "ÀB"]
    return r.choice([" ", "\n", ". ", "　"]).join(r.choice(parts) for _ in range(r.randint(0, 80)))


def test_against_plain_loops(spark):
    docs = [(i, some_text(i)) for i in range(300)]
    docs += [(5, some_text(7)), (5, some_text(7)), (None, some_text(9) + " word" * 30), (400, None), (401, ""), (402, " .,"), (403, "w" * 70000), (404, "long words " * 30000)]
    target = [some_text(1000 + i) for i in range(20)] + [None, ""]
    rows = [(i, t, 1, "x", -1) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, score string, n_words int").repartition(5)
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([tuple(r) for r in got], key=key) == sorted([tuple(x) for x in plain(docs, target)], key=key)


def test_texts_in_parts(monkeypatch):
    texts = ["", "one two three " * 40, None, "x" * 500, "a " + "y" * 900 + " b " + "z" * 10, "end", "end", ". .", "é" * 300 + " " + "q " * 200]
    whole = [plain_features(t) for t in texts]
    for chunk in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(R, "CHUNK", chunk)
        words, found = [0] * len(texts), [Counter() for _ in texts]
        for row, one, pair_row, two in R.features(pa.array(["skipped", *texts]).slice(1)):
            for r, b in zip(row.tolist(), one.tolist()):
                words[r] += 1
                found[r][b] += 1
            for r, b in zip(pair_row.tolist(), two.tolist()):
                found[r][b] += 1
        assert words == [n for n, _ in whole] and found == [Counter(f) for _, f in whole], chunk


def test_crc_of_many_runs():
    data = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    start = np.random.default_rng(2).integers(0, 4000, 200)
    length = np.r_[np.random.default_rng(3).integers(0, 40, 195), 999, 500, 0, 1, 2]
    got = R.advanced(np.full(200, 0xFFFFFFFF, np.uint32), data, start, length) ^ 0xFFFFFFFF
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(start, length)]
    assert R.advanced(np.empty(0, np.uint32), data, start[:0], length[:0]).tolist() == []


def test_empty_tables_and_drawn_documents(spark):
    schema = "doc_id long, text string, drawn_id string, part int"
    none = spark.createDataFrame([], schema)
    target = spark.createDataFrame([("green tea and rice " * 2000,)], "text string")
    assert R.resample(none, target).collect() == []
    assert R.drawn_documents(none, target).columns == ["doc_id", "text", "drawn_id", "part"]
    docs = spark.createDataFrame([(i, ("green tea and rice " if i % 4 == 0 else "grey stone under water ") * 8, "own", 3) for i in range(40)], schema)
    ranks = R.resample(docs, spark.createDataFrame([], "text string")).where("rank is not null")
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, 11))
    drawn = R.drawn_documents(docs, target).collect()
    assert len(drawn) == 10 and sum(r.doc_id % 4 == 0 for r in drawn) >= 8 and {r.drawn_id for r in drawn} == {"own"}
    assert R.resample(docs.limit(3), target).where("rank is not null").count() == 0  # a quarter of three is none
