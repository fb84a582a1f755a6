"""Fill-in-middle transformation by rank and select over the code points of a batch.

The first bytes of all code points of an Arrow buffer are ones of a packed bitvector. A directory holds the ones before
each block and, inside the block, before each word, so rank and select take a few vector operations for all rows at once:
the ones of a text are its length, and selecting the two drawn ranks gives the bytes at which it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import row_groups, table, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and percent of those that start with their suffix.
RATE, SPM_RATE = 90, 20
#: Words of 64 bits in a block of the directory; bytes of texts whose outputs are built at a time.
WORDS, GROUP_BYTES = 8, 8 << 20


class Boundaries:
    """The bytes of a buffer that begin a code point, as a packed bitvector with a two-level directory of counts."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        packed = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        room = (self.size // (64 * WORDS) + 1) * WORDS  # at least one bit of padding, so that rank(size) has a word
        self.words = np.zeros(room, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).reshape(-1, WORDS).astype(np.int64)
        self.inside = (np.cumsum(ones, axis=1) - ones).astype(np.uint16).ravel()
        self.blocks = np.concatenate([[0], np.cumsum(ones.sum(axis=1))])

    @property
    def total(self) -> int:
        return int(self.blocks[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of these bytes."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[word // WORDS] + self.inside[word] + np.bitwise_count(self.words[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte of each of these ones, counted from 0; the end of the buffer for the number of all ones."""
        if not len(self.words) or not self.total:
            return np.full(len(nth), self.size, np.int64)
        past = nth >= self.total
        nth = np.where(past, 0, nth)
        block = np.searchsorted(self.blocks, nth, side="right") - 1
        left = nth - self.blocks[block]
        word = block * WORDS
        word = word + (self.inside[word[:, None] + np.arange(WORDS)] <= left[:, None]).sum(axis=1) - 1
        left = (left - self.inside[word]).astype(np.uint64)
        bits, at = self.words[word], np.zeros(len(nth), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.uint64)
            up = left >= ones
            left = np.where(up, left - ones, left)
            bits = np.where(up, bits >> np.uint64(half), bits)
            at = np.where(up, at + np.uint64(half), at)
        return np.where(past, self.size, (word << 6) + at.astype(np.int64))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """The four first groups of eight digits of the SHA-256 of seed and id, as numbers; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text), a row for each row.

    n counts code points. Form is `plain` for empty texts, texts that hold one of the three marks, and those that the
    draw leaves alone: their output is the text, and both lengths are null. `psm` is prefix, suffix, middle, `spm`
    suffix, prefix, middle, each behind its mark. Null texts count as empty. Rows of one id are drawn alike, but cut by
    their own lengths. Very long texts are cut whole; an empty table gives an empty one; other columns are not looked at.
    """
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def cut(ids: pa.Array, texts: pa.Array, forms: pa.Array, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
        data, start, end = utf8(texts)
        marks = Boundaries(data)
        first = marks.rank(start)
        n = marks.rank(end) - first
        one, two = h1 % (n + 1), h2 % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        a, b = marks.select(first + low), marks.select(first + high)
        a, b = np.where(low == n, end, a), np.where(high == n, end, b)  # behind the last one of a text
        raw, out = memoryview(data), []
        for kind, x, y, z, e in zip(forms.to_pylist(), start.tolist(), a.tolist(), b.tolist(), end.tolist(), strict=True):
            if kind == "psm":
                out.append(b"".join((p, raw[x:y], s, raw[z:e], m, raw[y:z])))
            elif kind == "spm":
                out.append(b"".join((s, raw[z:e], p, raw[x:y], m, raw[y:z])))
            else:
                out.append(bytes(raw[x:e]))
        plain = np.array(forms.to_pylist(), object) == "plain"
        columns = [ids, pa.array(n, pa.int64()), forms, pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in row_groups(batch, 1, GROUP_BYTES):
                yield cut(*group.columns[:3], group.column(3).to_numpy(), group.column(4).to_numpy())

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form come from. A mark inside an output stands where the transformation put it:
    texts that hold marks are plain, and no part of a text makes a mark with one beside it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # "", then the three parts
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = (F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
n AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM h),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1, n - b) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
