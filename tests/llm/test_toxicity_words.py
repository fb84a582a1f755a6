"""No character of a text is left out of the toxicity words, whatever its script."""

import random

import numpy as np
import pytest

pytest.importorskip("inkwell.llm")
from inkwell.llm import toxicity  # noqa: E402


def test_unicode_space_and_punctuation_part_words():
    assert toxicity.words_of("Eins zwei　三、四。«cinq»—six sept\u0085huit_9") == [w.encode() for w in "eins zwei 三 四 cinq six sept huit 9".split()]
    assert toxicity.words_of("naïve กำลัง नमस्ते") == [w.encode() for w in "naïve กำลัง नमस्ते".split()]
    assert toxicity.words_of("x" * 16) == [b"x" * 16] and toxicity.words_of(None) == [] == toxicity.words_of(" 　。")


def test_long_runs_are_read_whole():
    r = random.Random(1)
    for n in (17, 18, 30, 31, 40, 41, 1000):
        run = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n))
        words = [w.decode() for w in toxicity.words_of(run)]
        assert max(map(len, words)) == toxicity.PIECE
        assert [w[k : k + 3] for w in words for k in range(len(w) - 2)] == [run[k : k + 3] for k in range(n - 2)]


def test_a_passage_inside_a_run_counts():
    r = random.Random(2)
    clean = lambda n: "".join(chr(r.randint(0x4E00, 0x4E80)) for _ in range(n))
    bad = "愚蠢混蛋滚开白痴"
    texts = [clean(40) + (bad * 3 if i % 2 else clean(24)) + clean(40) for i in range(160)]
    net = toxicity.train(texts[:120], np.array([i % 2 for i in range(120)]))
    score = toxicity._scores(net, [toxicity.words_of(t) for t in texts[120:]])
    assert np.mean((score > 0) == np.array([i % 2 for i in range(120, 160)])) > 0.9


def test_runs_of_any_length_score_alike():
    """Nothing changes at any length of a run: one more harmless character moves a score a little at most."""
    r = random.Random(3)
    clean = lambda n: "".join(chr(r.randint(0x4E00, 0x4E80)) for _ in range(n))
    bad = "愚蠢混蛋滚开白痴"
    texts = [clean(r.randint(5, 80)) + (bad if i % 2 else clean(8)) + clean(r.randint(5, 80)) for i in range(400)]
    net = toxicity.train(texts, np.array([i % 2 for i in range(400)]))
    for n in range(8, 60):
        run = (bad + clean(60))[:n]
        a, b = toxicity._scores(net, [toxicity.words_of(run), toxicity.words_of(run + run[-1])])
        assert (a > 0) and (b > 0), n
