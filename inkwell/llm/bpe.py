"""BPE encoding and decoding with a pair occurrence index.

A text is cut at ASCII white space, over which no token of a word-end BPE reaches, so each distinct word of a batch is
encoded once. All new words of a batch lie in one symbol array. An index maps every merge rank to all positions where
its pair stands; the active ranks are applied in ascending order, each at all its positions at once, and only the
lists of the neighbouring pairs change. The vocabulary file is a parameter and is read on the executors.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkwell.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Words whose encoding a worker keeps between batches, bytes of texts that share one index, and bytes of a text that are
#: split into words at a time. They bound a worker's memory whatever the batches are.
KEPT_WORDS, INDEX_BYTES, PIECE = 200_000, 6 << 20, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: White space beyond ASCII, and characters on whose classes the two regular expression libraries may differ.
INNER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RARE = re.compile("[^\x00-\u0557]")
_loaded: dict[str, Vocabulary] = {}


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, cut at ASCII white space only."""
    at = 0
    while len(data) - at > size:
        space = SPACE.search(data, at + size)
        if space is None:
            break
        yield data[at : space.start()]
        at = space.end()
    yield data[at:] if at else data


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE with word ends, as a tokenizers file describes it."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.normalizer = Tokenizer.from_file(path).normalizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split, self.library_split = regex.compile(pattern), Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        chars = _byte_characters()
        self.inner = np.array([ids[c] for c in chars], np.int64)
        self.last = np.array([ids[c + suffix] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        # of a pair that is listed twice the later rank holds, as in a map filled in order
        order = np.lexsort((np.arange(len(key)), key))
        keep = order[np.r_[key[order][1:] != key[order][:-1], True]]
        self.keys, self.ranks = key[keep], keep
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.spelled = {i: b"%d " % i for i in self.tokens}
        self.shown = {b"%d" % i: t.encode() for i, t in self.tokens.items()}
        self.pairs = {r: (k >> 20, k & 0xFFFFF) for r, k in zip(self.ranks.tolist(), self.keys.tolist(), strict=True)}

    @staticmethod
    def load(name: str) -> Vocabulary:
        import public_tokenizers

        if name not in _loaded:
            _loaded[name] = Vocabulary(public_tokenizers.path(name))
        return _loaded[name]

    def decode_spelled(self, ids: bytes) -> bytes:
        """The text of decimal ids with spaces between, special tokens included. Without a decoder in the file tokens are
        joined by spaces, so the text of ids in a row is that of their parts, joined by spaces too."""
        return b" ".join([self.shown[i] for i in ids.split() if i in self.shown])

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return self.decode_spelled(b" ".join([b"%d" % i for i in ids])).decode()

    def encode_words(self, words: list[bytes]) -> Iterator[bytes]:
        """Of words without ASCII white space, the decimal ids, each followed by a space. One pair occurrence index covers
        the distinct parts of all words."""
        parts: dict[str, int] = {}  # each part is merged once
        plans: list[list[int] | int] = []  # of each word, its parts; special ids as -1 - id
        for sections in self._sections(words):
            plan = []
            for k, section in enumerate(sections):
                if k % 2:
                    plan.append(-1 - self.special[section])
                elif section:
                    found = self.split.findall(section) if not RARE.search(section) else [s for s, _ in self.library_split.pre_tokenize_str(section)]
                    plan += [parts.setdefault(part, len(parts)) for part in found]
            plans.append(plan)
        ids, ends = self.merge([p.encode() for p in parts])
        spelled = list(map(self.spelled.__getitem__, ids.tolist()))
        ends = ends.tolist()
        cuts = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
        spelled = [b"".join(spelled[a:b]) for a, b in cuts]
        for plan in plans:
            if len(plan) == 1 and plan[0] >= 0:
                yield spelled[plan[0]]
            else:
                yield b"".join([spelled[p] if p >= 0 else self.spelled[-1 - p] for p in plan])

    def _sections(self, words: list[bytes]) -> Iterator[list[str]]:
        """Each word as ordinary and special sections in turn, the ordinary ones normalized."""
        texts = [w.decode("utf-8") for w in words]
        joined = [i for i, t in enumerate(texts) if not t.isascii() and not INNER_SPACE.search(t)]
        fixed: dict[int, str] = {}
        for at in range(0, len(joined), 4096):
            group = joined[at : at + 4096]
            out = self.normalizer.normalize_str("\n".join([texts[i] for i in group])).split(" ")
            if len(out) != len(group):
                out = [self.normalizer.normalize_str(texts[i]) for i in group]
            fixed.update(zip(group, out, strict=True))
        for i, t in enumerate(texts):
            if "<" in t and self.special_split.search(t):
                yield [s if k % 2 else self.normalizer.normalize_str(s) for k, s in enumerate(self.special_split.split(t))]
            elif t.isascii():
                yield [t.lower()]
            else:
                yield [fixed[i] if i in fixed else self.normalizer.normalize_str(t)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts in order, and where each part's ids end."""
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        end = np.cumsum([len(p) for p in parts])
        symbol = self.inner[raw]
        symbol[end - 1] = self.last[raw[end - 1]]
        n = len(symbol)
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[end - 1] = n  # a wall behind and before each part
        before[np.r_[0, end[:-1]]] = n
        symbol = np.append(symbol, -1).astype(np.int32)
        following, before = np.append(following, np.int32(n)), np.append(before, np.int32(n))

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(where: np.ndarray) -> None:
            """Lists the pairs that start at these positions under their ranks."""
            where = where[(where < n)]
            where = where[following[where] < n]
            rank = self._rank(symbol[where], symbol[following[where]])
            known = rank >= 0
            where, rank = where[known], rank[known]
            if not len(where):
                return
            order = np.argsort(rank, kind="stable")
            where, rank = where[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, a, b in zip(rank[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rank)], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(where[a:b])

        enter(np.arange(n, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            left, right = self.pairs[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            then = following[at]
            ok = (symbol[at] == left) & (symbol[then] == right)  # others were changed by lower ranks
            at, then = at[ok], then[ok]
            if left == right and len(at) > 1:  # overlapping pairs: from the left, each symbol once
                at = np.sort(at)
                free, taken = -1, []
                for p, q in zip(at.tolist(), following[at].tolist(), strict=True):
                    if p != free:
                        taken.append(p)
                        free = q
                    # the pair that starts at a used symbol is gone
                at = np.array(taken, np.int32)
                then = following[at]
            if not len(at):
                continue
            symbol[at] = self.made[r]
            symbol[then] = -1
            after = following[then]
            following[at] = after
            before[after] = at
            before[n] = n
            enter(np.concatenate([before[at], at]))
        alive = symbol[:n] >= 0
        return symbol[:n][alive], np.cumsum(np.add.reduceat(alive, np.r_[0, end[:-1]]))


class Encoder:
    """Encodes whole texts through a bounded store of word encodings."""

    def __init__(self, name: str):
        self.vocabulary = Vocabulary.load(name)
        self.ids: dict[bytes, bytes] = {}
        self.text: dict[bytes, bytes] = {}

    def learn(self, texts: list[bytes]) -> None:
        """Encodes the words of these texts that are not known yet; what is known is dropped when it is too much."""
        if len(self.ids) > KEPT_WORDS:
            self.ids.clear()
            self.text.clear()
        new: set[bytes] = set()
        for text in texts:
            for piece in pieces(text):
                new |= set(piece.split()).difference(self.ids)
        words = list(new)
        decode = self.vocabulary.decode_spelled
        for w, ids in zip(words, self.vocabulary.encode_words(words), strict=True):
            self.ids[w], self.text[w] = ids, decode(ids) + b" " if ids else b""

    def digests(self, text: bytes) -> tuple[int, str, str]:
        """Tokens, and the SHA-256 of the ids and of the decoded text, word by word decoded from the ids."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        gap = b""
        for piece in pieces(text):
            words = piece.split()
            some = b"".join(map(self.ids.__getitem__, words))
            if some:
                n += some.count(b" ")
                ids.update(gap + some[:-1])
                decoded.update(gap + b"".join(map(self.text.__getitem__, words))[:-1])
                gap = b" "
        return n, ids.hexdigest(), decoded.hexdigest()

    def encode(self, text: bytes) -> np.ndarray:
        return np.fromstring(b"".join([b"".join(map(self.ids.__getitem__, p.split())) for p in pieces(text)]), np.int32, sep=" ")


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch, as many at a time as share an index."""
    column = column.cast(pa.binary())
    size = np.maximum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]), 0) if len(column) else np.empty(0, np.int64)
    group = (np.cumsum(size) - size) // INDEX_BYTES
    cuts = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), len(column)] if len(column) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield [t or b"" for t in column.slice(a, b - a).to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text); null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids: list[np.ndarray] = []
            for texts in _groups(batch.column(1)):
                encoder.learn(texts)
                ids += map(encoder.encode, texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the decoded texts; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.load(vocabulary)
        for batch in batches:
            texts = pa.array([known.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents (doc_id, text), a row for each row.

    Null texts count as empty: no tokens, digests of the empty string. Very long texts are encoded whole, piece by
    piece. Repeated rows give repeated results, an empty table an empty one; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for texts in _groups(batch.column(1)):
                encoder.learn(texts)
                rows += map(encoder.digests, texts)
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
