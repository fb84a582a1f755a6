"""Joins inside packages: spine and manifest, parts and relationships, footnotes and bodies, all within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions import text as T


def spine_parts(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, nth, href) of spine (doc_id, nth, idref) and manifest (doc_id, idref, href); unknown references drop out."""
    return spine.join(manifest, ["doc_id", "idref"]).select("doc_id", "nth", "href")


def related(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Elements (doc_id, part_no, rel_id) with the `target` that their own part's relationships name, null without one."""
    return elements.join(relations.select("doc_id", "part_no", "rel_id", "target"), ["doc_id", "part_no", "rel_id"], "left")


def missing_notes(notes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Notes (doc_id, note_id, text) that the body (doc_id, markdown) neither refers to nor holds; separators are left out."""
    real = notes.where(~F.col("note_id").isin("-1", "0") & (F.trim("text") != ""))
    seen = F.contains("markdown", F.concat(F.lit("(#footnote-ref-"), "note_id", F.lit(")"))) | F.contains("markdown", F.trim("text"))
    return real.join(bodies, "doc_id").where(~seen).select("doc_id", "note_id", F.trim("text").alias("text"))


def alphabetical(path: Column) -> Column:
    """A key by which paths sort alphabetically, without regard to case first."""
    return F.collate(path, "UNICODE")


def chart_rows(names: Column, series: Column) -> Column:
    """Rows of a chart's categories and its series' values, which meet by ordinal: a missing category is its number, a
    missing value empty."""
    at = lambda a, i: F.get(a, i.cast("int"))
    row = lambda i: F.concat(F.array(F.coalesce(at(names, i), (i + 1).cast("string"))), F.transform(series, lambda v: F.coalesce(at(v, i), F.lit(""))))
    n = F.aggregate(series, F.size(names), lambda a, v: F.greatest(a, F.size(v)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row)).otherwise(F.array().cast("array<array<string>>"))


def chart_table(title: Column, names: Column, labels: Column, columns: Column) -> Column:
    """A chart's cached series as a headed Markdown table."""
    head = F.concat(F.lit("\n\n### Chart"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""), F.lit("\n\n"))
    return F.concat(head, T.markdown_table(F.concat(F.array(F.concat(F.array(F.lit("Category")), names)), chart_rows(labels, columns))), F.lit("\n"))


def first_headings(shapes: DataFrame, by: list[str]) -> DataFrame:
    """Shapes (by, place, kind, is_title, text, rows) with `heading`: the first title of a slide that isn't blank, if no text before
    it has a heading."""
    before = W.partitionBy(*by).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    title = F.coalesce(F.col("is_title"), F.lit(False)) & (T.stripped(F.col("text")) != "") & (F.size("place") == 1)
    marked = F.coalesce(F.col("text").contains("# "), F.lit(False)) | F.exists(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), lambda c: c.contains("# "))
    headed = F.coalesce(title, F.lit(False)) | marked | (F.col("kind") == "chart")
    return shapes.withColumn("heading", F.coalesce(title, F.lit(False)) & ~F.coalesce(F.bool_or(headed).over(before), F.lit(False)))
