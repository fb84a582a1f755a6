"""Fill-in-middle against slices of strings, rank and select against counts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("inkwell.llm")
from inkwell.llm import fim  # noqa: E402


def plain(i, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(text), "plain", None, None, text
    if h[3] % 100 < 20:
        return i, len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_rank_and_select():
    r = random.Random(2)
    for size in (0, 1, 7, 63, 64, 65, 511, 512, 513, 3000):
        text = "".join(r.choice("aé一𐀀") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        marks = fim.Boundaries(data)
        first = [k for k, b in enumerate(text.encode()) if b & 0xC0 != 0x80]
        assert marks.total == size
        every = np.arange(len(data) + 1)
        assert marks.rank(every).tolist() == np.searchsorted(first, every).tolist()
        assert marks.select(np.arange(size + 1)).tolist() == [*first, len(data)]


def test_documents(spark, monkeypatch):
    r = random.Random(3)
    marks = ["<P>", "<S>", "<M>", "<", ">", "S>", "<S", "P", "M>"]
    rows = [(i, "".join(r.choice(["a", "é", "一", "𐀀", " ", "\n", *(marks if i % 3 == 0 else marks[3:])]) for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(5, "twice"), (5, "twice"), (None, "no id"), (501, None), (502, ""), (503, "é" * 1_000_000), (504, "<P> marked")]
    docs = spark.createDataFrame([(i, t, "own", 0) for i, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    key = lambda x: (x[0] is None, x[0], x[1])
    for size in (64, 8 << 20):
        monkeypatch.setattr(fim, "GROUP_BYTES", size)
        out = fim.fill_in_middle(docs)
        assert sorted(map(tuple, out.collect()), key=key) == sorted((plain(i, t) for i, t in rows), key=key)
    back = fim.fill_in_middle(docs).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((x.doc_id, x.text) for x in back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fim.fill_in_middle(docs.where("false")).collect() == []
