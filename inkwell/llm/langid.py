"""Language ID of mixed-language text.

Words are runs of letters. Script ranges leave each word the languages that use its script; each of these scores the
word by its character trigrams; Viterbi over the words, with a penalty for switching, labels spans. Everything runs
on code point arrays of whole batches; Viterbi steps run over all documents of a batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import held_out, sampled, saved, table, training_ids

#: Documents learned from for each language and in all, their characters for each language, buckets of trigrams,
#: smoothing, and the penalties of a switch and of a script that a language hardly uses.
SAMPLE, SAMPLE_ALL, SAMPLE_CHARS, BITS, SMOOTH, SWITCH, FOREIGN = 400, 8000, 4_000_000, 17, 0.5, 8.0, 40.0
#: A language uses a script if so much of its letters are in it. Most score that one word can add.
SHARE, WORD_MOST = 0.01, 12.0
CHARS = 4_000_000
# First code points of script ranges, in order; a range lasts to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB00, "latin"), (0x20000, "han"),
]


@cache
def _kinds() -> np.ndarray:
    """The first letter of each code point's general category."""
    return np.array([k[0] for k in map(unicodedata.category, map(chr, range(0x110000)))])


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case if it is a letter or mark, else 0; and the number of its script."""
    lower = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(np.isin(_kinds(), ("L", "M"))).tolist():
        small = chr(c).lower()
        lower[c] = ord(small) if len(small) == 1 else c
    names = sorted({s for _, s in SCRIPTS})
    at = np.searchsorted([c for c, _ in SCRIPTS], np.arange(0x110000), side="right") - 1
    return lower, np.array([names.index(s) for _, s in SCRIPTS], np.uint8)[at]


@cache
def _marks() -> np.ndarray:
    """Whether a code point is a combining mark."""
    return _kinds() == "M"


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each letter, first letter of each word, first and end position of each word)."""
    lower, _ = _characters()
    c = np.zeros(len(codes) + 2, np.uint32)
    c[1:-1] = lower[codes]
    at = np.flatnonzero(c[1:-1])
    mixed = c[at] * np.uint32(0x9E3779B1) + c[at + 1] * np.uint32(0x85EBCA77) + c[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1]) if len(at) else np.empty(0, np.int64)
    end = at[np.r_[first[1:], len(at)] - 1] + 1 if len(at) else np.empty(0, np.int64)
    return bucket, first, at[first], end


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        _, script = _characters()
        count = np.zeros((1 << BITS, len(self.langs)))
        scripts = np.zeros((script.max() + 1, len(self.langs)))
        for text, lang in zip(texts, langs, strict=True):
            codes, k = _codes(text), self.langs.index(lang)
            bucket, first, start, end = _words(codes)
            if len(first):
                count[:, k] += np.bincount(bucket, minlength=1 << BITS)
                scripts[:, k] += np.bincount(script[codes[start]], weights=end - start, minlength=len(scripts))
        p = np.log(count + SMOOTH) - np.log(count.sum(0) + SMOOTH * (1 << BITS))
        self.score = (p - p.mean(1, keepdims=True)).astype(np.float32) if self.langs else p.astype(np.float32)
        uses = scripts >= SHARE * np.maximum(scripts.sum(0), 1)
        self.script = np.where(uses | ~uses.any(1, keepdims=True), 0, -FOREIGN).astype(np.float32)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by language, first and end character) of the words of a text."""
        codes = _codes(text)
        _, script = _characters()
        bucket, first, start, end = _words(codes)
        if not len(first):
            return np.empty((0, len(self.langs)), np.float32), start, end
        if (marks := _marks()[codes[start]]).any():  # runs of marks without a letter are no words
            lone = [k for k in np.flatnonzero(marks) if _marks()[codes[start[k] : end[k]]].all()]
            keep = np.ones(len(first), bool)
            keep[lone] = False
            if not keep.any():
                return np.empty((0, len(self.langs)), np.float32), start[:0], end[:0]
            score = np.add.reduceat(self.score[bucket], first, axis=0)[keep]
            start, end = start[keep], end[keep]
        else:
            score = np.add.reduceat(self.score[bucket], first, axis=0)
        score = np.clip(score, -WORD_MOST, WORD_MOST) + self.script[script[codes[start]]]
        return score, start, end

    def spans(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Of each text, its words' first and end characters and languages."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        score, start, end = self.words("\n".join(texts))
        cut = np.searchsorted(start, ends)
        first = np.r_[0, cut[:-1]]
        path = _viterbi(score, first, cut - first)
        begin = ends - [len(t) + 1 for t in texts]
        return [start[a:b] - o for a, b, o in zip(first, cut, begin, strict=True)], [end[a:b] - o for a, b, o in zip(first, cut, begin, strict=True)], [path[a:b] for a, b in zip(first, cut, strict=True)]


def _viterbi(score: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best language of each word, for sequences that start at `first`; a switch costs SWITCH."""
    path = np.zeros(len(score), np.int16)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = int(size[0]) if len(size) else 0
    if not steps or score.shape[1] == 1:
        return path
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences with more than t words
    stay = np.zeros(score.shape, bool)
    source = np.zeros(len(score), np.int16)
    best = score[first[: live[0]]].copy()
    last = best
    for t in range(1, steps):
        n = live[t]
        if n < len(best):
            last[: len(best)] = best
            best = best[:n]
        at = first[:n] + t
        top = best.argmax(1)
        least = best[np.arange(n), top] - SWITCH
        keep = best >= least[:, None]
        stay[at], source[at] = keep, top
        best = np.where(keep, best, least[:, None]) + score[at]
    last[: len(best)] = best
    now = last.argmax(1)
    for t in range(steps - 1, 0, -1):
        n = live[t]
        at = first[:n] + t
        state = now[:n]
        path[at] = state
        now[:n] = np.where(stay[at, state], state, source[at])
    path[first[: live[0]]] = now[: live[0]]
    return path


def learn(docs: DataFrame) -> Model:
    """Learns from a bounded sample of documents (doc_id, text, lang) outside the held-out fifth: SAMPLE of each language
    and SAMPLE_ALL at most (but for one of each language), with SAMPLE_CHARS characters of a language and as many for all
    as 16 languages may have. What is sampled is learned from whole. The model takes half a MB for each language."""
    ids = training_ids(docs.where(F.col("text").isNotNull()).select("doc_id", "lang"), "lang", SAMPLE)
    langs = max(1, ids.select("label").distinct().count())
    if langs * SAMPLE > SAMPLE_ALL:
        nth = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = saved(ids.withColumn("nth", nth).where(F.col("nth") <= max(1, SAMPLE_ALL // langs)).drop("nth"), "sample")
    rows = sampled(docs, ids, min(SAMPLE_CHARS, 16 * SAMPLE_CHARS // langs)).toPandas().sort_values(["doc_id", "text"])
    return Model(rows.text.tolist(), rows.label.tolist())


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHARS:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans, lang_pred, score) of documents (doc_id, text), a row for each row.

    spans: array of (start, stop, lang), character offsets of maximal runs of words of one language. lang_pred: the
    language with most letters, ties to the first by name; score: its share of all letters. Null, empty and letterless
    texts get `und`, score 0 and no spans, and so does everything if nothing could be learned. Very long texts are
    labelled whole. Repeated rows give repeated results, an empty table an empty one; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the number of languages only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.langs, pa.string())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                starts, ends, paths = m.spans(texts[a:b]) if m.langs else ([np.empty(0, int)] * (b - a),) * 3
                cuts = [np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.empty(0, int) for p in paths]
                size = [0, *np.cumsum([len(c) for c in cuts])]
                start = np.concatenate([s[c] for s, c in zip(starts, cuts, strict=True)])
                stop = np.concatenate([e[np.r_[c[1:], len(e)] - 1] if len(c) else e[:0] for e, c in zip(ends, cuts, strict=True)])
                lang = np.concatenate([p[c] for p, c in zip(paths, cuts, strict=True)])
                fields = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), names.take(pa.array(lang, pa.int64()))], ["start", "stop", "lang"])
                best, score = [], []
                for s, e, p in zip(starts, ends, paths, strict=True):
                    letters = np.bincount(p, weights=e - s, minlength=len(m.langs)) if len(p) else None
                    best.append(m.langs[int(letters.argmax())] if len(p) else "und")
                    score.append(float(letters.max() / letters.sum()) if len(p) else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(size, pa.int32()), fields), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "spans", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,stop:int,lang:string>>, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = label_spans(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
