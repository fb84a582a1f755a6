"""Layout of positioned words: lines, column clusters, table regions, forms and prose, as DataFrame operators.

Input: words (doc_id, page, text, x0, x1, top, page_width). Everything is keyed by (doc_id, page), so that work spreads
over pages; no step gathers more than one page's words in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
FORM_GRID, PROSE_GRID = 5, 3
#: Points: a gap that starts a new column; words this near to a column belong to it; slack before the next column.
COLUMN_GAP, ALIGNED, BEFORE_NEXT = 80.0, 40.0, 20.0


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def line_key(top: Column, grid: int) -> Column:
    return js_round(top / grid) * grid


def clusters(words: DataFrame, by: list[str], order: list[str], gap: float) -> DataFrame:
    """Words with `cluster`, their column in the line from 0: a word more than `gap` behind the one before starts one."""
    flagged = words.withColumn("_starts", F.when(F.col("x0") - F.lag("x1").over(W.partitionBy(*by).orderBy(*order)) > gap, 1).otherwise(0))
    return flagged.withColumn("cluster", F.sum("_starts").over(W.partitionBy(*by).orderBy(*order)).cast("int")).drop("_starts")


def islands(rows: DataFrame, flag: Column, by: list[str], order: str) -> DataFrame:
    """Maximal runs of flagged rows: (by, first, last, n), `order` being consecutive numbers."""
    kept = rows.where(flag).select(*by, order, (F.col(order) - F.row_number().over(W.partitionBy(*by).orderBy(order))).alias("_island"))
    return kept.groupBy(*by, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")


def spaced_letters(cells: Column) -> Column:
    """At least 3 columns, 40 % of which are at most 2 characters long."""
    return (F.size(cells) >= 3) & (F.size(F.filter(cells, lambda c: F.length(F.trim(c)) <= 2)) / F.size(cells) >= 0.4)


def structured(cells: Column) -> Column:
    mean = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.size(cells)
    return (F.size(cells) >= 3) & ~F.exists(cells, lambda c: F.length(c) > 80) & (mean <= 40) & ~spaced_letters(cells)


def prose_row(cells: Column, first: Column, last: Column, width: Column) -> Column:
    """A long text over most of the page, or columns that are all long."""
    text = F.array_join(cells, " ")
    wide = (last - first > width * 0.55) & (F.length(text) > 60)
    return wide | ((F.size(cells) >= 2) & F.forall(cells, lambda c: F.length(c) > 25))


def gap_tolerance(xs: Column) -> Column:
    """The 70th percentile of gaps over 5 between sorted distinct x, between 25 and 50; 35 with fewer than 3 gaps."""
    gaps = F.array_sort(F.filter(F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(1))), xs, lambda b, a: b - a), lambda g: g > 5))
    at = F.get(gaps, F.floor(F.size(gaps) * 0.7).cast("int"))
    return F.when(F.size(gaps) >= 3, F.least(F.lit(50.0), F.greatest(F.lit(25.0), at))).otherwise(35.0)


def kept_columns(xs: Column, tolerance: Column) -> Column:
    """Of sorted x, those more than the tolerance behind the last one kept."""
    empty = F.array().cast("array<double>")
    return F.aggregate(xs, empty, lambda kept, x: F.when((F.size(kept) == 0) | (x > F.element_at(kept, -1) + tolerance), F.concat(kept, F.array(x))).otherwise(kept))


def column_of(x0: Column, columns: Column) -> Column:
    """The column of a word: the first whose successor begins more than BEFORE_NEXT behind the word, else the last."""
    nexts = F.slice(columns, 2, F.greatest(F.size(columns), F.lit(1)))
    at = F.array_position(F.transform(nexts, lambda c: x0 < c - BEFORE_NEXT), F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(columns) - 1).cast("int")


def pages_of(words: DataFrame) -> DataFrame:
    """(doc_id, page, lines, page_width): the lines of each page from top to bottom, each an array of its words in reading
    order with their cluster. Words are dealt by page once; whatever groups pages further needs no other shuffle."""
    keyed = words.where(F.trim("text") != "").repartition(*PAGE).withColumn("y", line_key(F.col("top"), FORM_GRID))
    each = clusters(keyed, [*PAGE, "y"], ["x0", "x1", "text"], COLUMN_GAP)
    word = F.struct("x0", "x1", "text", "cluster", line_key(F.col("top"), PROSE_GRID).alias("y"))
    lines = each.groupBy(*PAGE, "y").agg(F.array_sort(F.collect_list(word)).alias("words"), F.first("page_width").alias("page_width"))
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "words"))).alias("lines"), F.first("page_width").alias("page_width"))


def _said(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def plain_text(lines: Column) -> Column:
    """A page's words as lines of the finer grid, from top to bottom, words from left to right."""
    words = F.array_sort(F.transform(F.flatten(F.transform(lines, lambda l: l["words"])), lambda w: F.struct(w["y"].alias("y"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
    gap = lambda all_, w, i: F.when(i == 0, "").when(F.get(all_, i - 1)["y"] == w["y"], " ").otherwise("\n")
    return _let(words, lambda all_: F.array_join(F.transform(all_, lambda w, i: F.concat(gap(all_, w, i), w["text"])), ""))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _row(line: Column) -> Column:
    """A line with its cells: clusters of words, each with its first x."""
    last = F.element_at(line["words"], -1)
    of = lambda k: F.filter(line["words"], lambda w: w["cluster"] == k)
    cells = F.transform(F.sequence(F.lit(0), last["cluster"]), lambda k: _let(of(k), lambda ws: F.struct(F.get(ws, F.lit(0))["x0"].alias("x"), _said(ws).alias("cell"))))
    return F.struct(line["words"].alias("words"), cells.alias("cs"), F.get(line["words"], F.lit(0))["x0"].alias("first"), last["x1"].alias("last"))


def aligned_columns(words: Column, columns: Column) -> Column:
    """How many columns have a word of the line near them, each word counting for the first one it is near."""
    near = F.transform(words, lambda w: F.array_position(F.transform(columns, lambda g: F.abs(w["x0"] - g) < ALIGNED), F.lit(True)))
    return F.size(F.array_distinct(F.filter(near, lambda p: p > 0)))


def _units(text: Column) -> Column:
    """Length in UTF-16 units, by which columns are made equally wide."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def table_text(rows: Column, columns: Column) -> Column:
    """Lines of a table region as a Markdown table, the first as its header, cells padded to their column's width."""
    every = F.sequence(F.lit(0), F.size(columns) - 1)
    cells = F.transform(rows, lambda r: F.transform(every, lambda i: _said(F.filter(r["words"], lambda w: column_of(w["x0"], columns) == i))))

    def shown(table: Column) -> Column:
        widths = F.transform(every, lambda i: F.aggregate(table, F.lit(3), lambda a, r: F.greatest(a, _units(F.get(r, i)))))
        padded = lambda wide, r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, wide, lambda c, n: F.concat(c, F.repeat(F.lit(" "), n - _units(c)))), " | "), F.lit(" |"))
        rule = lambda wide: F.concat(F.lit("| "), F.array_join(F.transform(wide, lambda n: F.repeat(F.lit("-"), n)), " | "), F.lit(" |"))
        body = F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0)))
        return _let(widths, lambda wide: F.array_join(F.concat(F.array(padded(wide, F.get(table, F.lit(0))), rule(wide)), F.transform(body, lambda r: padded(wide, r))), "\n"))

    return _let(cells, shown)


def laid_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, plain, form): each page's lines, and its layout with tables if its lines form some, else null.

    A page is one row from its lines on, so the tables of a page meet nothing but that page.
    """
    pages = pages_of(words).withColumn("rows", F.transform("lines", _row))
    texts = lambda r: F.transform(r["cs"], lambda c: c["cell"])
    marked = lambda r: F.struct(r["words"].alias("words"), r["cs"].alias("cs"), prose_row(texts(r), r["first"], r["last"], F.col("page_width")).alias("prose"))
    pages = pages.withColumn("rows", F.transform("rows", marked))
    good = F.filter("rows", lambda r: structured(texts(r)) & ~r["prose"])
    pages = pages.withColumn("xs", F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda r: F.transform(r["cs"], lambda c: c["x"]))))))
    pages = pages.withColumn("columns", kept_columns(F.col("xs"), gap_tolerance(F.col("xs"))))
    n, span = F.size("columns"), F.get("columns", F.size("columns") - 1) - F.get("columns", F.lit(0))
    fits = F.when(n > 1, (span / n >= 30) & (n / (span / 72) <= 10) & (n <= F.greatest(F.lit(15), F.floor(20 * F.col("page_width") / 612)))).otherwise(False)
    row = lambda r: ~r["prose"] & ~partial_number(F.get(r["words"], F.lit(0))["text"]) & (aligned_columns(r["words"], F.col("columns")) >= 2)
    pages = pages.withColumn("flags", F.when(fits, F.transform("rows", row)))
    form = F.size(F.filter("flags", lambda t: t)) / F.size("flags") >= 0.2
    # regions: a table row goes with the table row before it, every other line is alone
    starts = F.filter(F.sequence(F.lit(0), F.size("flags") - 1), lambda i: ~(F.get("flags", i) & F.coalesce(F.get("flags", i - 1), F.lit(False))))
    pages = pages.withColumn("starts", F.when(form, starts))
    region = lambda s, k: F.slice("rows", s + 1, F.coalesce(F.get("starts", k + 1), F.size("rows")) - s)
    block = lambda s, k: F.when(F.get("flags", s), table_text(region(s, k), F.col("columns"))).otherwise(F.array_join(texts(F.get("rows", s)), "  "))
    return pages.select(*PAGE, plain_text(F.col("lines")).alias("plain"), F.array_join(F.transform("starts", block), "\n").alias("form"))


def prose_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, text): lines from top to bottom, words from left to right."""
    return laid_pages(words).select(*PAGE, F.col("plain").alias("text"))


def form_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page, is_form, text): pages whose lines form tables are laid out as Markdown tables; text is null if not."""
    return laid_pages(words).select(*PAGE, F.col("form").isNotNull().alias("is_form"), F.col("form").alias("text"))


def low_quality(markdown: Column) -> Column:
    """Whether laid-out tables look like broken text: no lines at all, or cells of 2.5 characters on average, or more than
    35 % of them single characters. Fewer than 2 table lines say nothing against it."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    table = F.filter(lines, lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.filter(F.transform(F.flatten(F.transform(table, lambda x: F.split(x, r"\|"))), lambda c: F.trim(c)), lambda c: c != "")
    mean = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.size(cells)
    single = F.size(F.filter(cells, lambda c: F.length(c) == 1)) / F.size(cells)
    return F.when(F.size(lines) == 0, True).when((F.size(table) < 2) | (F.size(cells) == 0), False).otherwise((mean <= 2.5) | (single > 0.35))


def partial_number(line: Column) -> Column:
    """Whether a line is only a part of a number, `.N`."""
    return F.trim(line).rlike(r"^\.\d+$")


def partial_numbers_joined(lines: DataFrame) -> DataFrame:
    """Of (doc_id, n, line): a line that is only `.N` joins the next line that isn't blank; blanks between them go.

    One window over a document: of partial numbers that follow one another directly every second one joins, so what
    counts is whether a line's place in its run of partial numbers is odd.
    """
    w = W.partitionBy("doc_id").orderBy("n")
    blank = F.trim("line") == ""
    seen = lines.withColumn("_real", F.when(~blank, F.struct("n", F.trim("line").alias("line")))).withColumn("_partial", ~blank & partial_number(F.col("line")))
    seen = seen.withColumn("_run", F.sum(F.when(~blank & ~F.col("_partial"), 1).otherwise(0)).over(w))  # a new run behind each other line
    run = W.partitionBy("doc_id", "_run").orderBy("n")
    nth = F.sum(F.col("_partial").cast("int")).over(run)
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    seen = seen.withColumn("_next", F.first("_real", True).over(after)).withColumn("_odd", F.col("_partial") & (nth % 2 == 1)).withColumn("_joins", F.col("_odd") & F.col("_next").isNotNull())
    last = F.last(F.when(~blank, F.col("_joins")), True).over(before)
    seen = seen.withColumn("_gone", F.coalesce(last, F.lit(False)) & F.when(blank, F.col("_next").isNotNull()).otherwise(True))
    whole = F.when(F.col("_joins"), F.concat(F.trim("line"), F.lit(" "), F.col("_next")["line"])).otherwise(F.col("line"))
    return seen.where(~F.col("_gone")).select("doc_id", "n", whole.alias("line"))
