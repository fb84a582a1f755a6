"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking.

Merging ends with the one sequence of tokens whose neighbours all stay apart when their joined text is merged anew. An
Aho-Corasick automaton gives the longest token from each place of a word. A token is taken if it stands its neighbour
by that check, else the next shorter one is tried; places from which nothing leads to the end are marked in a bitfield
and never entered again. Words are cut where no token of the vocabulary reaches over, so each distinct word is encoded
once. The model file is a parameter and is read on the executors.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import row_groups, table

MODEL = "piece_bpe_32k.model"
#: Words and token pairs that a worker keeps between texts, characters of a text cut into words at a time, and bytes of
#: texts whose results share a batch. They bound a worker's memory whatever the texts are.
KEPT_WORDS, KEPT_PAIRS, STRETCH, GROUP_BYTES = 300_000, 1_000_000, 1 << 20, 8 << 20
SPACE = "▁"
#: What the library shows for an unknown token, and for each byte that is no part of a character.
UNKNOWN, BROKEN = " ⁇ ", "\ufffd"
codecs.register_error("inkwell-bytewise", lambda error: (BROKEN, error.start + 1))
_loaded: dict[str, Model] = {}


class Words(dict):
    """A store that makes what it does not hold yet."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        out = self[word] = self.make(word)
        return out


class Model:
    """A merge-type model: tokens with scores, higher ones merged first, equal ones from the left."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = library.normalize
        size = library.get_piece_size()
        self.byte, self.shown, self.score = {}, [b""] * size, {}
        self.token: dict[str, int] = {}
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.shown[i] = bytes([int(piece[3:5], 16)])
            elif library.is_unknown(i):
                self.unknown = i
                self.shown[i] = UNKNOWN.encode()
            elif not library.is_control(i) and not library.is_unused(i):
                self.token[piece], self.score[piece] = i, library.get_score(i)
                self.shown[i] = piece.replace(SPACE, " ").encode()
        # characters that are no tokens themselves, but may be merged into one: numbered behind the tokens
        self.alone = {c: size + n for n, c in enumerate(sorted({c for t in self.token for c in t} - self.token.keys()))}
        self.text = {i: t for t, i in (self.token | self.alone).items()}
        self.spelled = [b"%d," % i for i in range(size)]
        self._index()
        self.words = self._cuts()
        self.ids, self.decoded = Words(self._spell), Words(self._show)

    @staticmethod
    def load(name: str) -> Model:
        import public_tokenizers

        if name not in _loaded:
            _loaded[name] = Model(public_tokenizers.path(name))
        return _loaded[name]

    def _index(self) -> None:
        """The automaton of all tokens, their lengths, and for each the longest token that it starts with, -1 for none."""
        import ahocorasick

        size = max(self.text) + 1
        self.automaton, self.length, self.shorter = ahocorasick.Automaton(), [0] * size, [-1] * size
        for i, t in self.text.items():
            self.automaton.add_word(t, (len(t) - 1, i))
            self.length[i] = len(t)
            starts = (t[:n] for n in range(len(t) - 1, 0, -1))
            self.shorter[i] = next((self.token.get(p, self.alone.get(p, -1)) for p in starts if p in self.token or p in self.alone), -1)
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}

    def _cuts(self) -> re.Pattern | None:
        """A pattern of the words of a normalized text: no token holds a space behind another character, nor one of the
        ASCII characters at which words end. None if the vocabulary has such tokens, and texts are encoded in one."""
        if any(SPACE in t.lstrip(SPACE) for t in self.token):
            return None
        held = {c for t in self.token for c in t}
        walls = "".join(re.escape(c) for c in map(chr, range(128)) if c not in held)
        return re.compile(f"{SPACE}*[^{SPACE}{walls}]+|{SPACE}+|[{walls}]+" if walls else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """A short text's tokens by merging: the highest score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their joined text is merged; -1 on the left is the start of a word."""
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        pair = [self.text[i] for i in (left, right) if i >= 0]
        known = self.apart[left << 20 | right] = self.merged("".join(pair)) == pair
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of a stretch of normalized text."""
        longest = [-1] * len(word)
        for last, (before, token) in self.automaton.iter(word):
            longest[last - before] = token  # ends ascend, so the longest from a place comes last
        if -1 not in longest:
            out = self._backtracked(longest, 0, len(word))
        else:
            out, at = [], 0
            while at < len(word):
                if longest[at] < 0:
                    out += self._as_bytes(word[at])
                    at += 1
                    continue
                end = at
                while end < len(word) and longest[end] >= 0:
                    end += 1
                out += self._backtracked(longest, at, end)
                at = end
        if self.alone:
            out = [i for token in out for i in (self._as_bytes(self.text[token]) if token >= len(self.shown) else (token,))]
        return out

    def _as_bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def _backtracked(self, longest: list[int], start: int, end: int) -> list[int]:
        """The tokens between two places: from each place the longest that fits and leads on, else the next shorter one."""
        failed = None  # a bit for each place from which the end is out of reach, made at the first one
        tokens: list[int] = []
        at, token, left = start, longest[start], -1
        apart, shorter, length = self.apart, self.shorter, self.length
        while at < end:
            while token >= 0:
                known = apart.get(left << 20 | token)
                if known is None:
                    known = self.fits(left, token)
                if known:
                    to = at + length[token]
                    if failed is None or not failed[to - start >> 3] >> (to - start & 7) & 1:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, left = to, token
                token = longest[at] if at < end else -1
            else:
                if failed is None:
                    failed = bytearray((end - start >> 3) + 1)
                failed[at - start >> 3] |= 1 << (at - start & 7)
                token = tokens.pop()  # a valid sequence always exists, so the first place never fails
                left = tokens[-1] if tokens else -1
                at -= length[token]
                token = shorter[token]
        return tokens

    def _spell(self, word: str) -> bytes:
        ids = self.encode_word(word)
        self.decoded[word] = b"".join([self.shown[i] for i in ids])
        return b"".join([self.spelled[i] for i in ids])

    def _show(self, word: str) -> bytes:
        self._spell(word)
        return self.decoded[word]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The words of a normalized text, those of about STRETCH characters at a time."""
        if self.words is None:
            yield [text] if text else []
            return
        at = 0
        while at < len(text):
            to = text.find(SPACE, at + STRETCH)
            while to > 0 and text[to - 1] == SPACE:  # a run of spaces goes with the word behind it
                to -= 1
            to = len(text) if to <= at else to
            if len(self.ids) > KEPT_WORDS:
                self.ids.clear()
                self.decoded.clear()
            yield self.words.findall(text[at:to])
            at = to

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        spelled = [b"".join(map(self.ids.__getitem__, words)) for words in self.stretches(self.normalize(text))]
        return np.array(b"".join(spelled).split(b",")[:-1], np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Control tokens have none, and end a run of bytes; the space before a text, added by encoding,
        goes."""
        first = next((i for i in ids if self.shown[i]), None)
        runs = [b""]
        for i in ids:
            if self.shown[i]:
                runs[-1] += self.shown[i]
            else:
                runs.append(b"")
        text = "".join([r.decode("utf-8", "inkwell-bytewise") for r in runs])
        return text[1:] if self.spaced and self.text.get(first, "").startswith(SPACE) else text

    @property
    def spaced(self) -> bool:
        """Whether encoding puts a space before a text."""
        return self.normalize("a").startswith(SPACE)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Tokens of a text, and the SHA-256 of its ids and of the text that is decoded from them."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        gap, drop = b"", self.spaced
        for words in self.stretches(self.normalize(text)):
            some = b"".join(map(self.ids.__getitem__, words))
            if some:
                n += some.count(b",")
                ids.update(gap + some[:-1])
                shown = b"".join(map(self.decoded.__getitem__, words))
                decoded.update(shown[1:] if drop and shown[:1] == b" " else shown)
                gap, drop = b",", False
        return n, ids.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text), a row for each row.

    Null and empty texts have no ids. Very long texts are encoded whole, stretch by stretch. Repeated rows give repeated
    results, an empty table an empty one; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.load(model)
        for batch in batches:
            for group in row_groups(batch, 1, GROUP_BYTES):
                ids = [known.encode(t or "") for t in group.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([group.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), a row for each row; null and empty ids give an empty text, repeated rows repeated
    results, an empty table an empty one; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.load(model)
        for batch in batches:
            texts = pa.array([known.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents (doc_id, text), a row for each row; all cases as in
    `encode_documents`, with the digests of the empty string where there is no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.load(model)
        for batch in batches:
            for group in row_groups(batch, 1, GROUP_BYTES):
                n, ids, decoded = zip(*(known.digests(t or "") for t in group.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [group.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
