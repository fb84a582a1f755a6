"""Shared pieces: tables in the shared folder, joins behind a size check, key runs, label splits, texts as buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes that `join_small` broadcasts; larger tables are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20
_own_dir: list[str] = []
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one only in local mode (tests) where none is configured: on a cluster
    each executor would write to its own disk."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="inkwell-"))
    return f"file://{_own_dir[0]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing reads any more, so that rounds do not fill the shared folder."""
    for df in tables:
        path = _written.pop(df, None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table does not have, whatever its own columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(df: DataFrame) -> bool:
    """Whether a saved table may be broadcast: by its rows, and then by the bytes of their values."""
    if df.count() > BROADCAST_ROWS:
        return False
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins a saved table, broadcast only if `is_small` says so; else by a shuffle that AQE may split."""
    return left.join(F.broadcast(right) if is_small(right) else right, on, how)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int, size: int | None = None) -> Iterator[pa.Table]:
    """Cuts a partition sorted by `keys` into tables of about `rows` rows, or `size` bytes if that is less, that hold every
    key's rows together."""
    import numpy as np

    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            n += batch.num_rows
        if n < rows and (size is None or sum(b.nbytes for b in kept) < size):
            continue
        whole = pa.Table.from_batches(kept).combine_chunks()
        same = np.ones(n, dtype=bool)
        for k in keys:
            column = whole[k].to_numpy()
            same &= column == column[-1]
        cut = int(n - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
            whole = whole.slice(cut)
        kept, n = whole.to_batches(), whole.num_rows
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def run_pairs(starts, sizes, most: int) -> Iterator[tuple]:
    """Index pairs i < j inside runs of a sorted table, as arrays of at most about `most` pairs at a time."""
    import numpy as np

    first = np.repeat(starts, sizes)
    size = np.repeat(sizes, sizes)
    i = np.arange(len(first)) + (starts[0] if len(starts) else 0)
    after = size - (i - first) - 1  # partners behind each row
    total = np.cumsum(after)
    at = 0
    while at < len(i):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        left = np.repeat(i[at:to], after[at:to])
        begin = np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
        yield left, left + 1 + (np.arange(len(left)) - begin)
        at = to


def roots(n: int, left, right):
    """Smallest index of each index's component, by vectorised hooking and pointer jumping."""
    import numpy as np

    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def training_ids(rows: DataFrame, label: str, most: int) -> DataFrame:
    """A bounded sample to learn from: at most `most` rows (doc_id, label) of each label, by smallest hash of doc_id.

    Only rows with id and label outside the held-out fifth are taken; rows that repeat both count once. Labels are few
    by nature (classes, languages). Counts by label give a hash below which a few more than `most` rows lie; only those
    are ranked, so no task sorts all rows of a label.
    """
    from pyspark.sql import Window as W

    pool = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    pool = saved(pool.distinct().withColumn("place", F.xxhash64("doc_id")), "labelled")
    share = F.least(F.lit(1.0), (most + 8 * most**0.5 + 64) / F.count("*"))
    bounds = saved(pool.groupBy("label").agg(((share - 0.5) * float(1 << 64)).alias("below")), "bounds")
    few = join_small(pool, bounds, ["label"]).where(F.col("place") <= F.col("below"))
    nth = F.row_number().over(W.partitionBy("label").orderBy("place", "doc_id"))
    return saved(few.withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", "label"), "sample")


def sampled(docs: DataFrame, ids: DataFrame, chars: int) -> DataFrame:
    """(doc_id, text, label) of sampled ids (doc_id, label), one row for each, texts whole.

    The sample of a label holds `chars` characters at most: of its rows in the order of their hashes as many as fit. A text
    that is longer by itself is no row of the sample. Of an id with several texts the shortest counts, ties by hash. What
    is ranked are lengths, as many as there are sampled rows.
    """
    from pyspark.sql import Window as W

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    size = F.struct(F.length("text").alias("size"), F.xxhash64("text").alias("h"))
    sizes = join_small(texts.select("doc_id", size.alias("s")), ids, ["doc_id"]).groupBy("doc_id", "label").agg(F.min("s").alias("s")).where(F.col("s.size") <= chars)
    in_all = F.sum("s.size").over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = saved(sizes.withColumn("in_all", in_all).where(F.col("in_all") <= chars).select("doc_id", "label", "s"), "chosen")
    found = join_small(texts.withColumn("own", size), chosen, ["doc_id"]).where(F.col("own") == F.col("s"))
    return found.select("doc_id", "label", "text").dropDuplicates(["doc_id", "label"])


def row_groups(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of its text column; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy()
    group = (np.cumsum(lengths) - lengths) // size
    cuts = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), len(group)] if len(group) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def utf8(texts: pa.Array) -> tuple:
    """The bytes of a text column, and where each row starts and ends in them; nulls are empty."""
    import numpy as np

    wide = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    whole = wide.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and whole.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    return data, offsets[:-1], offsets[1:]
