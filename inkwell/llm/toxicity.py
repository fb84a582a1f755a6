"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector of its own (frequent words), the mean of learned vectors of its character trigrams,
and smoothed log odds, of the word and of its trigrams,
in the training texts. The network scores windows of WINDOW words, each overlapping the
next by half; a text's score is that of its most toxic window, in training (multiple-instance learning) as later. What
a word adds to the gates is computed once for each distinct word of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import held_out, sampled, table, training_ids

WINDOW, STEP = 32, 16
#: Documents learned from for each label, and their characters in all; words with vectors; buckets of character trigrams.
SAMPLE, SAMPLE_CHARS, VOCABULARY, LEAST_DOCS, GRAM_BITS = 1200, 8_000_000, 20_000, 3, 13
WORD_DIM, CHAR_DIM, HIDDEN, BATCH, RATE, SEED = 8, 8, 8, 256, 0.01, 11
#: Rounds through the texts, and the gradient steps at least; few texts are gone through more often.
EPOCHS, STEPS = 8, 120
#: Share of the other windows that show one of their words over and over.
REPEATED = 0.15
#: Windows scored at once; words of texts handled at once.
SCORED, CHUNK_WORDS = 4096, 400_000
#: Runs are read in pieces of so many characters, each beginning with the last OVER of the one before: no trigram is lost.
PIECE, OVER = 16, 2


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram buckets of all words in order, how many each word has)."""
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 2) - size - 2
    keep = np.ones(len(codes), bool)  # middles of trigrams: all but the two marks of each word
    keep[first] = keep[first + size + 1] = False
    at = np.flatnonzero(keep)
    h = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA77) + codes[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64), size


#: ASCII punctuation and control characters separate words as white space does; beyond ASCII, what Unicode calls
#: punctuation, separators and control characters, and the zero-width space.
_APART = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_FAR_APART = re.compile("[\u200b" + "".join(re.escape(chr(c)) for c in range(128, 0x20000) if unicodedata.category(chr(c)) in ("Cc", "Zs", "Zl", "Zp", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")) + "]")


def _pieces(word: bytes) -> list[bytes]:
    run = word.decode("utf-8", "surrogatepass")
    return [run[at : at + PIECE].encode("utf-8", "surrogatepass") for at in range(0, max(1, len(run) - OVER), PIECE - OVER)]


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = _FAR_APART.sub(" ", text)
    words = text.encode("utf-8", "surrogatepass").translate(_APART).split()
    if max(map(len, words), default=0) > PIECE:
        words = [p for w in words for p in (_pieces(w) if len(w) > PIECE else (w,))]  # no more bytes, no more characters
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _segments(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Means over runs of rows; runs may be empty."""
    total = np.zeros((len(size), values.shape[1]), np.float32)
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some], axis=0)
    return total / np.maximum(size, 1)[:, None].astype(np.float32)


class Network:
    """Parameters: word and trigram vectors, two recurrent layers (input, recurrent, bias), attention, output."""

    def __init__(self, vocabulary: dict[bytes, int], odds: np.ndarray, gram_odds: np.ndarray, rng: np.random.Generator):
        self.vocabulary, self.odds, self.gram_odds = vocabulary, odds.astype(np.float32), gram_odds.astype(np.float32)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM + 2
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "gram": draw(1 << GRAM_BITS, CHAR_DIM, scale=0.3),
            "in_f": draw(d, 3 * h, scale=0.3), "in_b": draw(d, 3 * h, scale=0.3), "rec_f": draw(h, 3 * h, scale=0.3), "rec_b": draw(h, 3 * h, scale=0.3),
            "bias_f": np.zeros(3 * h, np.float32), "bias_b": np.zeros(3 * h, np.float32), "att": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "out_bias": np.zeros(1, np.float32),
        }
        self.p["word"][-1] = 0  # words without a vector of their own

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs by word, vocabulary row, trigrams, trigrams of each word)."""
        row = np.array([self.vocabulary.get(w, -1) for w in words], np.int64)
        gram, size = _grams([w.decode("utf-8", "surrogatepass") for w in words])
        x = np.concatenate([self.p["word"][row], _segments(self.p["gram"][gram], size), np.append(self.odds, np.float32(0))[row][:, None], _segments(self.gram_odds[gram][:, None], size)], axis=1)
        return x, row, gram, size

    def _layer(self, a: np.ndarray, rec: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States of a recurrent layer over gate inputs a (windows, steps, 3 * HIDDEN)."""
        n, steps, h = len(a), a.shape[1], HIDDEN
        state, out = np.zeros((n, h), np.float32), np.empty((n, steps, h), np.float32)
        for t in range(steps):
            u = state @ rec
            gate = _sigmoid(a[:, t, : 2 * h] + u[:, : 2 * h])
            z, r = gate[:, :h], gate[:, h:]
            c = np.tanh(a[:, t, 2 * h :] + r * u[:, 2 * h :])
            new = c + z * (state - c)
            if mask is not None:
                new = np.where(mask[:, t, None], new, state)
            if keep is not None:
                keep.append((state, z, r, c, u[:, 2 * h :]))
            out[:, t] = state = new
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = states @ self.p["att"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", w, states)
        return pooled @ self.p["out"] + self.p["out_bias"][0], w, pooled

    def logits(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Of windows of word ids (windows, steps), given each word's gate inputs forth and back."""
        forth = self._layer(gates[0][ids], self.p["rec_f"], mask, None)
        back = self._layer(gates[1][ids[:, ::-1]], self.p["rec_b"], None if mask is None else mask[:, ::-1], None)[:, ::-1]
        return self._pool(np.concatenate([forth, back], axis=2), mask)[0]

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["in_f"] + self.p["bias_f"], x @ self.p["in_b"] + self.p["bias_b"]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, balance: float = 1.0) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log loss, in which label 1 weighs `balance`: by parameter, and by word input."""
        p, h, g = self.p, HIDDEN, {}
        turned, turned_mask = ids[:, ::-1], mask[:, ::-1]
        gate_f, gate_b = self.gates(x)
        kept_f, kept_b = [], []
        forth = self._layer(gate_f[ids], p["rec_f"], mask, kept_f)
        back = self._layer(gate_b[turned], p["rec_b"], turned_mask, kept_b)[:, ::-1]
        states = np.concatenate([forth, back], axis=2)
        logit, w, pooled = self._pool(states, mask)
        d = ((_sigmoid(logit) - y) * np.where(y > 0, balance, 1) / len(y)).astype(np.float32)
        g["out"], g["out_bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["out"]
        d_w = np.einsum("nth,nh->nt", states, d_pool)
        d_e = w * (d_w - (w * d_w).sum(1, keepdims=True))
        g["att"] = np.einsum("nt,nth->h", d_e, states)
        d_states = w[:, :, None] * d_pool[:, None] + d_e[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        for side, kept, own, own_mask, ds in (("f", kept_f, ids, mask, d_states[:, :, :h]), ("b", kept_b, turned, turned_mask, d_states[:, ::-1, h:])):
            rec, d_rec, d_next = p[f"rec_{side}"], np.zeros_like(p[f"rec_{side}"]), np.zeros((len(y), h), np.float32)
            d_gate = np.zeros((*ids.shape, 3 * h), np.float32)
            for t in range(ids.shape[1] - 1, -1, -1):
                state, z, r, c, uc = kept[t]
                dh, m = d_next + ds[:, t], own_mask[:, t, None]
                live = dh * m
                d_c = live * (1 - z) * (1 - c * c)
                d_z = live * (state - c) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_gate[:, t] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_rec += state.T @ d_u
                d_next = dh * ~m + live * z + d_u @ rec.T
            by_word = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(by_word, own.ravel(), d_gate.reshape(-1, 3 * h))
            g[f"rec_{side}"], g[f"in_{side}"], g[f"bias_{side}"] = d_rec, x.T @ by_word, by_word.sum(0)
            d_x += by_word @ p[f"in_{side}"].T
        return g, d_x


def windows(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, words) of the overlapping windows of texts that lie one after the other; the last one ends with
    its text, and a text with no words has none."""
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STEP)), 0)
    text = np.repeat(np.arange(len(size)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(nth * STEP, np.maximum(size[text] - WINDOW, 0))
    return text, first[text] + start, np.minimum(size[text], WINDOW)


def _score(net: Network, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logits of windows; those of full length go without a mask."""
    out = np.empty(len(start), np.float32)
    step = np.arange(WINDOW)
    for full in (True, False):
        rows = np.flatnonzero((size == WINDOW) == full)
        for at in range(0, len(rows), SCORED):
            part = rows[at : at + SCORED]
            if full:
                out[part] = net.logits(gates, ids[start[part, None] + step], None)
            else:
                inside = step < size[part, None]
                out[part] = net.logits(gates, ids[np.where(inside, start[part, None] + step, start[part, None])], inside)
    return out


def train(texts: list[str], labels: np.ndarray) -> Network:
    """Trains on texts and labels 0 and 1; without both labels the network stays as drawn."""
    rng = np.random.default_rng(SEED)
    split = [words_of(t) for t in texts]
    seen, hits = Counter(), Counter()
    gram_seen, gram_hits = np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)
    for words, y in zip(split, labels, strict=True):
        own = set(words)
        grams = np.unique(_grams([w.decode("utf-8", "surrogatepass") for w in own])[0])
        seen.update(own)
        gram_seen[grams] += 1
        if y:
            hits.update(own)
            gram_hits[grams] += 1
    ones, zeros = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    chosen = [w for w, n in sorted(seen.items(), key=lambda e: (-e[1], e[0])) if n >= LEAST_DOCS][:VOCABULARY]
    odds = np.array([np.log((hits[w] + 2) / (ones + 4)) - np.log((seen[w] - hits[w] + 2) / (zeros + 4)) for w in chosen])
    gram_odds = np.log((gram_hits + 2) / (ones + 4)) - np.log((gram_seen - gram_hits + 2) / (zeros + 4))
    net = Network({w: i for i, w in enumerate(chosen)}, odds, gram_odds, rng)
    if not len(labels) or labels.min() == labels.max():
        return net
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
    words = list(number)
    size = np.array([len(w) for w in split], np.int64)
    text, start, length = windows(np.cumsum(size) - size, size)
    step = np.arange(WINDOW)
    own = net.inputs(words)[0][:, -2:].sum(1)
    inside = step < length[:, None]
    rank = np.where(inside, own[ids[np.where(inside, start[:, None] + step, start[:, None])]], -9).max(1)
    anchor = rank  # the odds alone to begin with, and beside the score later: few texts are learned by heart otherwise
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    turn, balance = 0, np.float32(min(10.0, max(1.0, (len(labels) - labels.sum()) / labels.sum())))
    epochs = max(EPOCHS, min(8 * EPOCHS, -(-STEPS * BATCH // (2 * len(labels)))))
    for epoch in range(epochs):
        if epoch > epochs // 4:
            rank = anchor + _score(net, net.gates(net.inputs(words)[0]), ids, start, length)
        order = np.lexsort((rank, text))
        top = order[np.r_[text[order][1:] != text[order][:-1], True]]  # each text's most toxic window
        others = rng.permutation(np.flatnonzero(labels[text] == 0))[: len(top)]
        chosen_rows = rng.permutation(np.concatenate([top, others]))
        for at in range(0, len(chosen_rows), BATCH):
            rows = chosen_rows[at : at + BATCH]
            mask = step < length[rows, None]
            seq = ids[np.where(mask, start[rows, None] + step, start[rows, None])]
            same = rng.random(len(rows)) < REPEATED * (labels[text[rows]] == 0)  # one word again and again isn't toxic by itself
            seq[same] = seq[same, :1]
            local, where = np.unique(seq, return_inverse=True)
            x, row, gram, grams = net.inputs([words[i] for i in local])
            g, d_x = net.gradients(x, where.reshape(mask.shape), mask, labels[text[rows]].astype(np.float32), balance)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], row, d_x[:, :WORD_DIM])
            g["word"][-1] = 0
            np.add.at(g["gram"], gram, np.repeat(d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / np.maximum(grams, 1)[:, None], grams, axis=0))
            turn += 1
            for k, v in net.p.items():  # Adam
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] * g[k] - s)
                v -= (RATE * (0.5 if epoch >= epochs // 2 else 1) * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Trains on a bounded sample of labelled documents outside the held-out fifth: SAMPLE of each label and SAMPLE_CHARS of
    their characters at most. What is sampled is learned from whole."""
    ids = training_ids(labels.where("toxic in (0, 1)"), "toxic", SAMPLE)
    rows = sampled(docs, ids, SAMPLE_CHARS).toPandas().sort_values(["doc_id", "text"])
    return train(rows.text.tolist(), rows.label.to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64))


def _scores(net: Network, texts: list[list[bytes]]) -> np.ndarray:
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    size = np.array([len(w) for w in texts], np.int64)
    out = np.full(len(texts), -np.inf)
    text, start, length = windows(np.cumsum(size) - size, size)
    if len(text):
        gates = net.gates(net.inputs(list(number))[0])
        np.maximum.at(out, text, _score(net, gates, ids, start, length))
    return out


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """The score of each text, that of its most toxic window; CHUNK_WORDS words are in memory as windows at a time."""
    best = np.full(len(texts), -np.inf)
    held: list[list[bytes]] = []
    owner: list[int] = []
    n = 0
    for i, text in enumerate(texts):
        words = words_of(text)
        for at in range(0, len(words), CHUNK_WORDS):
            held.append(words[max(0, at - WINDOW) : at + CHUNK_WORDS])  # parts overlap as windows do
            owner.append(i)
            n += len(held[-1])
            if n >= CHUNK_WORDS:
                np.maximum.at(best, owner, _scores(net, held))
                held, owner, n = [], [], 0
    if held:
        np.maximum.at(best, owner, _scores(net, held))
    return 1 / (1 + np.exp(-best))


def toxicity(docs: DataFrame, net: Network, limit: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text), a row for each row.

    Words are runs without white space and punctuation, in lower case, read in pieces of PIECE characters that overlap:
    most words are one piece, texts without spaces many. Null and empty texts score 0. Every text is scored whole, in
    overlapping windows; very long ones part by part, parts overlapping as windows do. Repeated rows give repeated
    results, an empty table an empty one; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by VOCABULARY and GRAM_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, net: Network, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns, whatever their names: null and empty texts among
    them, very long ones scored whole, rows that repeat each for itself. An empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(score_texts(shared.value, texts.tolist()))

    return docs.where(score(F.col("text")) < limit)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
