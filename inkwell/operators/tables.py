"""Cells of workbooks to Markdown tables: used range, column types, header names, rows, all keyed by sheet.

Input: cells (sheet columns..., r, c, kind, text), kind being s (text), n (number), b (boolean) or t (timestamp).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import ordered

# Cell texts that mean a missing value.
MISSING = ["#N/A", "#N/A N/A", "#NA", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]
NUMBER, FRACTION, WHOLE = r"^-?\d+(\.\d+)?$", r"\.\d*[1-9]", r"^-?\d+$"


def shown(kind: Column, text: Column) -> Column:
    """A cell's text in a table: missing values as NaN, line ends spelled out, leading zeros of whole numbers gone."""
    plain = F.when((kind == "s") & F.trim(text).isin(*MISSING), "NaN").when(kind == "s", T.show_newlines(text)).otherwise(text)
    return T.strip_leading_zeros(plain)


def used_range(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, top, bottom, right): from the first row of any cell to the last row and column of a cell that isn't empty."""
    full = F.col("text") != ""
    ends = cells.groupBy(*by).agg(F.min("r").alias("top"), F.max(F.when(full, F.col("r"))).alias("bottom"), F.max(F.when(full, F.col("c"))).alias("right"))
    return ends.where(F.col("bottom").isNotNull())


def decimal_columns(cells: DataFrame, by: list[str], rows: str) -> DataFrame:
    """(by, decimal) of cells (by, text, rows): a column of numbers only shows decimals if one has a fraction or one of its
    `rows` cells is missing."""
    known = F.col("text") != "NaN"
    numbers = F.bool_and(F.when(known, F.col("text").rlike(NUMBER)))
    missing = F.count(F.when(known, 1)) < F.max(rows)
    return cells.groupBy(*by).agg((F.coalesce(numbers, F.lit(False)) & (F.bool_or(known & F.col("text").rlike(FRACTION)) | missing)).alias("decimal"))


def with_decimals(text: Column, decimal: Column) -> Column:
    return F.when(F.coalesce(decimal, F.lit(False)) & text.rlike(WHOLE), F.concat(text, F.lit(".0"))).otherwise(text)


def sheet_tables(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, markdown) of the cells of sheets; a sheet without texts has no row."""
    ends = used_range(cells, by)
    inside = cells.where(F.col("text") != "").join(ends, by)
    every = ends.select(*by, F.explode(F.sequence(F.lit(0), F.col("right"))).alias("c"))
    head = inside.where("r = top").select(*by, "c", F.regexp_replace("text", "\n", r"\\n").alias("text"))
    head = every.join(head, [*by, "c"], "left").withColumn("text", F.coalesce("text", F.concat(F.lit("Unnamed: "), F.col("c").cast("string"))))
    head = ordered.dedup_names(head, "text", by, ["c"]).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"]).alias("head"))
    body = inside.where("r > top").select(*by, "r", "c", shown(F.col("kind"), F.col("text")).alias("text"), (F.col("bottom") - F.col("top")).alias("n"), "right")
    typed = body.join(decimal_columns(body, [*by, "c"], "n"), [*by, "c"]).select(*by, "r", "c", "right", with_decimals(F.col("text"), F.col("decimal")).alias("text"))
    line = lambda m: F.transform(F.sequence(F.lit(0), F.col("right")), lambda c: F.coalesce(F.try_element_at(m, c), F.lit("NaN")))
    rows = typed.groupBy(*by, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("m"), F.first("right").alias("right"))
    rows = rows.select(*by, "r", line(F.col("m")).alias("line")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("rows"))
    whole = ends.join(head, by).join(rows, by, "left")
    blank = F.array(F.array_repeat(F.lit("NaN"), F.col("right") + 1))
    # rows without cells stand between others, none before the first and behind the last
    before = lambda i: F.coalesce(F.get("rows", i - 1)["r"], F.col("top"))
    body = F.flatten(F.transform("rows", lambda x, i: F.concat(F.flatten(F.array_repeat(blank, x["r"] - before(i) - 1)), F.array(x["line"]))))
    body = F.coalesce(body, F.array().cast("array<array<string>>"))
    escaped = F.transform(F.concat(F.array(F.col("head")), body), lambda r: F.transform(r, lambda c: T.escape_markdown(T.pair_spaces(c))))
    return whole.select(*by, T.markdown_table(escaped).alias("markdown"))
