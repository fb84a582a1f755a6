"""Tables of files (doc_id, content, info) from folders, URIs, HTTP responses and other tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.routing import FIELDS, INFO, merge


def info(**hints: Column) -> Column:
    """A hint record; missing fields are null."""
    return F.struct(*(hints.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS))


def from_folder(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """Files below a folder; the size guard reaches the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return described(files)


def described(files: DataFrame) -> DataFrame:
    """Files of a binaryFile scan or stream, hints taken from their paths."""
    local = F.regexp_replace("path", "^file:(//)?", "")
    name = T.basename(F.col("path"))
    return files.select(F.xxhash64("path").alias("doc_id"), "content", info(extension=T.extension(name), filename=name, local_path=local).alias("info"))


def from_table(rows: DataFrame, doc_id: str, content: str, hints: Column | None = None) -> DataFrame:
    """Rows with a text or binary column."""
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(content).cast("binary").alias("content"), (hints if hints is not None else info()).cast(INFO).alias("info"))


def from_data_uris(rows: DataFrame, doc_id: str, uri: str) -> DataFrame:
    parsed = T.data_uri(F.col(uri))
    return rows.select(F.col(doc_id).alias("doc_id"), parsed.alias("u")).select("doc_id", F.col("u.data").alias("content"), info(mimetype=F.col("u.mimetype"), charset=F.col("u.charset")).alias("info"))


def response_info(url: Column, headers: Column) -> Column:
    """Hints of a response: media type and charset, the name in its disposition, else that of its path. headers: map with
    lower-case keys."""
    kind = F.try_element_at(headers, F.lit("content-type"))
    disposition = F.try_element_at(headers, F.lit("content-disposition"))
    named = F.nullif(F.regexp_replace(F.trim(F.regexp_extract(F.coalesce(disposition, F.lit("")), r"(?i)filename=([^;]+)", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    ext = F.when(named.isNotNull(), T.extension(named)).otherwise(T.extension(path))
    name = F.coalesce(named, F.when(ext.isNotNull(), T.basename(path)))
    charset = F.nullif(F.trim(F.regexp_extract(F.coalesce(kind, F.lit("")), r";\s*charset=([^;]+)", 1)), F.lit(""))
    return info(mimetype=F.nullif(F.trim(F.split_part(kind, F.lit(";"), F.lit(1))), F.lit("")), charset=charset, filename=name, extension=ext, url=url)


def from_responses(rows: DataFrame, doc_id: str, url: str, headers: str, body: str) -> DataFrame:
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(body).cast("binary").alias("content"), response_info(F.col(url), F.col(headers)).alias("info"))


def fetched(rows: DataFrame, doc_id: str, url: str, fetch) -> DataFrame:
    """Files behind addresses, got by an injected function url -> (bytes, headers); failures have null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, heads = [], []
            for u in batch.column(1).to_pylist():
                try:
                    body, head = fetch(u)
                except Exception:  # noqa: BLE001  a failed fetch is a row without content
                    body, head = None, {}
                bodies.append(body)
                heads.append([(k.lower(), v) for k, v in head.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary()), pa.array(heads, pa.map_(pa.string(), pa.string()))], names=["doc_id", "url", "body", "headers"])

    kind = rows.schema[doc_id].dataType.simpleString()
    got = rows.select(F.col(doc_id).alias("doc_id"), F.col(url).alias("url")).mapInArrow(run, f"doc_id {kind}, url string, body binary, headers map<string,string>")
    return from_responses(got, "doc_id", "url", "headers", "body")


def with_hints(files: DataFrame, hints: Column) -> DataFrame:
    """A caller's hints win over what was found."""
    return files.withColumn("info", merge(hints, F.col("info")))
