"""A document's reading flow: sections, numbered equations, references, footnotes, images of tables, text by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T

#: What ends a list of references or a footnote, and what begins a footnote (fixed values).
REFERENCE_HEADS = ("references", "bibliography")
AFTER_REFERENCES = ("attention visualizations", "appendix", "supplementary", "figure")
VENUES = ("Conference", "Proceedings", "NIPS", "NeurIPS")
FOOTNOTE_MARKS = "[†‡*∗]"
EQUATION_NUMBER = r"^[(\[]\d+[a-z]?[)\]]$"


def heading_level(text: Column, font_size: Column) -> Column:
    """One more than the dots of a heading's number; by font size without one."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).when(font_size >= 14, 1).when(font_size >= 12, 2).otherwise(3)


def alignment(x0: Column, width: Column, page_width: float) -> Column:
    """Centre within 50 points of the page's middle, else left of 30 % of it, else right; nothing there is centred."""
    return F.when(x0.isNull() | (F.abs(x0 + width / 2 - page_width / 2) < 50), "center").when(x0 < page_width * 0.3, "left").otherwise("right")


def with_sections(df: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """df (is_heading, text) with `section`: the last heading's text, carried on over pages; null before the first.

    A heading that the document has had is none; its followers stay with the section before it.
    """
    in_order = Window.partitionBy(doc).orderBy(*order)
    same = Window.partitionBy(doc, "_title").orderBy(*order)
    named = df.withColumn("_title", F.when(F.col("is_heading"), F.lower(F.trim("text"))))
    fresh = named.withColumn("_new", F.col("is_heading") & (F.row_number().over(same) == 1))
    return fresh.withColumn("section", F.last(F.when(F.col("_new"), F.trim("text")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("_title", "_new")


def merged_headings(df: DataFrame, page: str, order: list[str]) -> DataFrame:
    """df (is_heading, text, y0) where a bare number and the block after it on its page, under 25 points lower, are one heading."""
    w = Window.partitionBy(page).orderBy(*order)
    bare = F.col("is_heading") & F.trim("text").rlike(r"^\d+(\.\d+)*\.?$") & F.lead("text").over(w).isNotNull() & (F.lead("y0").over(w) - F.col("y0") < 25)
    marked = df.withColumn("_bare", bare).withColumn("_taken", F.coalesce(F.lag("_bare").over(w), F.lit(False)))
    # Of a chain of bare numbers every second one is taken by the one before it.
    run = marked.withColumn("_start", F.sum((~F.col("_taken")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(page, "_start").orderBy(*order))
    placed = run.withColumn("_k", place)
    joined = placed.withColumn("_next", F.lead("text").over(w))
    heads = joined.filter("_k % 2 = 1").withColumn("text", F.when(F.col("_bare"), F.concat_ws(" ", F.trim("text"), F.trim("_next"))).otherwise(F.col("text")))
    return heads.drop("_bare", "_taken", "_start", "_k", "_next")


def equation_numbers(df: DataFrame, page: str, order: list[str]) -> DataFrame:
    """Equations of df (key, is_equation, text, y0) with `number`: (n) or [n] among the next three items of the page, under 60 points off.

    A number is used once, by the first equation that it follows: the flow of a page is folded in order, so a number
    that was taken is no longer counted among the three.
    """
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], "key", "is_equation", "y0", F.trim("text").alias("t"))
    pages = df.groupBy(page).agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = "struct<rest: array<struct<key: bigint, eq: boolean, y0: double, t: string>>, out: array<struct<key: bigint, number: string>>>"
    flow = F.transform("items", lambda x: F.struct(x["key"].cast("bigint").alias("key"), x["is_equation"].alias("eq"), x["y0"].cast("double").alias("y0"), x["t"].alias("t")))

    def step(acc: Column, _: Column) -> Column:
        head, tail = F.get(acc["rest"], F.lit(0)), F.slice(acc["rest"], F.lit(2), F.greatest(F.size(acc["rest"]) - 1, F.lit(0)))
        fits = lambda x: x["t"].rlike(EQUATION_NUMBER) & (F.abs(x["y0"] - head["y0"]) < 60)
        number = F.get(F.filter(F.slice(tail, 1, 3), fits), F.lit(0))
        found = F.when(head["eq"], number)
        return F.struct(
            F.when(found.isNotNull(), F.filter(tail, lambda x: x["key"] != found["key"])).otherwise(tail).alias("rest"),
            F.when(head["eq"], F.array_append(acc["out"], F.struct(head["key"].alias("key"), found["t"].alias("number")))).otherwise(acc["out"]).alias("out"),
        ).cast(kind)

    start = F.struct(flow.alias("rest"), F.array().alias("out")).cast(kind)
    return pages.select(page, F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("e")).select(page, "e.key", "e.number")


def references(df: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """doc, number, text: the entries of lines(doc, text) after a references heading, up to a heading that ends them.

    "[n]" begins an entry, later lines belong to it; blank lines count for nothing.
    """
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t, low = F.trim("text"), F.lower(F.trim("text"))
    stop = F.lit(False)
    for head in AFTER_REFERENCES:
        stop = stop | low.startswith(head)
    lines = df.withColumn("t", t).filter("t <> ''").withColumn("mark", F.when(low.isin(*REFERENCE_HEADS), 1).when(stop, 0))
    inside = lines.withColumn("inside", F.last("mark", ignorenulls=True).over(w)).withColumn("part", F.sum(F.when(F.col("mark").isNotNull(), 1).otherwise(0)).over(w)).filter("inside = 1 AND mark IS NULL")
    number = F.regexp_extract("t", r"^\[(\d+)\]", 1)
    began = inside.withColumn("n", F.when(number != "", number)).withColumn("entry", F.sum(F.when(F.col("n").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(doc, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("n").isNotNull(), F.regexp_replace("t", r"^\[\d+\]\s*", "")).otherwise(F.col("t"))
    rows = began.filter("entry > 0").groupBy(doc, "part", "entry").agg(F.max("n").alias("number"), F.sort_array(F.collect_list(F.struct(*order, own.alias("line")))).alias("p"))
    out = rows.select(doc, F.concat(F.lit("["), "number", F.lit("]")).alias("number"), F.trim(F.array_join(F.transform("p", lambda x: x["line"]), " ")).alias("text"))
    return out.filter("text <> ''")


def footnotes(df: DataFrame, page: str, order: list[str], page_height: float) -> DataFrame:
    """page, marker, text: footnotes among lines(page, text, y1) that reach into a page's last 200 points.

    A mark begins a footnote and later lines belong to it, up to a line that names a venue.
    """
    w = Window.partitionBy(page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lines = df.filter(F.col("y1") >= page_height - 200).withColumn("t", F.trim("text")).filter("t <> ''")
    marker = F.regexp_extract("t", f"^({FOOTNOTE_MARKS})", 1)
    venue = F.lit(False)
    for word in VENUES:
        venue = venue | F.col("t").contains(word)
    begun = lines.withColumn("marker", F.when(marker != "", marker)).withColumn("note", F.sum(F.when(F.col("marker").isNotNull(), 1).otherwise(0)).over(w)).filter("note > 0")
    ended = begun.withColumn("over", F.max((F.col("marker").isNull() & venue).cast("int")).over(Window.partitionBy(page, "note").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter("over = 0")
    rows = ended.groupBy(page, "note").agg(F.max("marker").alias("marker"), F.sort_array(F.collect_list(F.struct(*order, "t"))).alias("p"))
    return rows.select(page, "marker", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def table_images(tables: DataFrame, images: DataFrame) -> DataFrame:
    """page, table, image: each table of tables(page, table, y0), in order, takes the nearest free image of images(page, image, y0).

    Nearest is the least difference of upper edges, above or below; a page's tables are folded in order, so an image is used once.
    """
    free = images.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.col("image").cast("bigint").alias("image"), F.col("y0").cast("double").alias("y0")))).alias("free"))
    own = tables.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.col("table").cast("bigint").alias("table"), F.col("y0").cast("double").alias("y0")))).alias("tables"))
    kind = "struct<free: array<struct<image: bigint, y0: double>>, out: array<struct<table: bigint, image: bigint>>>"

    def take(acc: Column, t: Column) -> Column:
        best = F.array_min(F.transform(acc["free"], lambda i: F.struct(F.abs(i["y0"] - t["y0"]).alias("d"), i["image"].alias("image"))))["image"]
        return F.struct(
            F.filter(acc["free"], lambda i: ~i["image"].eqNullSafe(best)).alias("free"),
            F.when(best.isNotNull(), F.array_append(acc["out"], F.struct(t["table"].alias("table"), best.alias("image")))).otherwise(acc["out"]).alias("out"),
        ).cast(kind)

    both = own.join(free, "page")
    taken = F.aggregate("tables", F.struct(F.col("free").alias("free"), F.array().alias("out")).cast(kind), take, lambda acc: acc["out"])
    return both.select("page", F.explode(taken).alias("x")).select("page", "x.table", "x.image")


def image_kinds(**kinds: DataFrame) -> DataFrame:
    """The rows of several tables of page elements under each other with their `kind`; columns that one lacks are null."""
    out: DataFrame | None = None
    for kind, rows in kinds.items():
        named = rows.withColumn("kind", F.lit(kind))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def element_texts(elements: DataFrame, spans: DataFrame) -> DataFrame:
    """page, element, text: the spans(page, ord, sx, sy, text) whose origin an element(page, element, box) holds, in order."""
    inside = F.col("sx").between(F.col("x0"), F.col("x1")) & F.col("sy").between(F.col("y0"), F.col("y1"))
    rows = elements.join(spans, "page").filter(inside).groupBy("page", "element").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return rows.select("page", "element", T.stripped(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"))


def only_page(pages: DataFrame, number: int) -> DataFrame:
    """The page of that number; reading it fails where there is none."""
    one = pages.sparkSession.range(1).select(F.lit(number).alias("_asked"))
    out = one.join(pages, F.col("_asked") == F.col("page"), "left")
    there = F.when(F.col("page").isNotNull(), F.col("page")).otherwise(F.raise_error(F.lit(f"no page {number}")))
    return out.withColumn("page", there).drop("_asked")


def footnote_text(command: Column) -> Column:
    """What stands between a command's first braces, up to the first closing one; null without."""
    return F.when(command.rlike(r"\\[a-zA-Z@]+\{[^}]*\}"), F.regexp_extract(command, r"\\[a-zA-Z@]+\{([^}]*)\}", 1))


def math_blocks(spans: DataFrame, block: str, share: float = 0.7) -> DataFrame:
    """block, math_share, is_equation: blocks of spans(block, font, text) more than `share` of which are mathematics.

    A span is mathematics by its font, or if it holds Greek letters or signs of relation, sum and root.
    """
    from foliospark.functions import fonts

    signs = F.col("text").rlike(r"[Ͱ-Ͽ∀-⋿=±×÷√∑∏∫]")
    rows = spans.withColumn("_math", (fonts.is_math(F.col("font")) | signs).cast("double"))
    return rows.groupBy(block).agg(F.avg("_math").alias("math_share")).withColumn("is_equation", F.col("math_share") > share)
