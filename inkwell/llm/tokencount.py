"""Token counts: batch encoding in Arrow functions that give lengths only.

Texts are cut into words at ASCII white space, a boundary that no token crosses; words that a worker has not met yet
are encoded by the library in batches of about BATCH_BYTES, and only the number of their tokens is kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.bpe import VOCABULARY, pieces
from inkwell.llm.common import table

#: Bytes given to the library at once, bytes of a text split at a time, and counts that a worker keeps between batches.
BATCH_BYTES, PIECE, KEPT_WORDS = 1 << 19, 1 << 20, 1_000_000
LIMIT = 2048


def balanced(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The words in lists of about `size` bytes."""
    batch, held = [], 0
    for w in words:
        batch.append(w)
        held += len(w) + 16
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Counter:
    """Counts tokens through a bounded store of the counts of words."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers

        path = public_tokenizers.path(name)
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_word = True
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(e) for e in library.encode(texts, num_threads=1)]
            self.by_word = False  # white space belongs to its pieces: whole texts are encoded
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [n for batch in balanced(texts, BATCH_BYTES) for n in self.lengths([t.decode() for t in batch])]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new: set[bytes] = set()
        for text in texts:
            for piece in pieces(text, PIECE):
                new |= set(piece.split()).difference(self.known)
        for batch in balanced(list(new), BATCH_BYTES):
            self.known.update(zip(batch, self.lengths([w.decode() for w in batch]), strict=True))
        return [sum([sum(map(self.known.__getitem__, p.split())) for p in pieces(text, PIECE)]) for text in texts]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents (doc_id, text), a row for each row.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings inside texts are found as the library finds them.
    Very long texts are counted whole, piece by piece. Repeated rows give repeated results, an empty table an empty
    one; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = _counters[vocabulary].count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
