"""Page layout: elements, their neighbours and what continues on the next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators.components import components

#: Groups of classes (fixed values).
FORMULAS, FOOTNOTES = ("isolate_formula", "formula_caption"), ("footnote", "table_footnote")
MARGINALIA = ("page_header", "page_footer", "page_number")
CONTINUABLE = ("plain_text", "abstract", "reference", "footnote", "table_footnote", "figure_caption", "table_caption")
#: Words that seldom begin a sentence (fixed values).
CONTINUATION_WORDS = (
    "and", "or", "but", "so", "yet", "nor", "for", "which", "that", "who", "whom", "whose", "where", "when", "however", "therefore", "moreover", "furthermore", "although", "though", "while", "whereas",
    "и", "или", "но", "а", "однако", "также", "поэтому", "который", "которая", "которое", "которые", "что", "чтобы", "если", "хотя", "потому",
)
#: Weight of a cue (fixed values).
CUES = {"no_sentence_end": 0.3, "hyphenation": 0.5, "ends_with_comma": 0.2, "lowercase_start": 0.4, "continuation_word": 0.3, "same_element_type": 0.2, "same_column": 0.1}


def near_bottom(df: DataFrame, page_height: float, share: float = 0.15) -> DataFrame:
    return df.filter((F.col("y1") > page_height * (1 - share)) & ~F.col("class_name").isin(*MARGINALIA))


def near_top(df: DataFrame, page_height: float, share: float = 0.15) -> DataFrame:
    return df.filter((F.col("y0") < page_height * share) & ~F.col("class_name").isin(*MARGINALIA))


def source_cues(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    return F.filter(F.array(F.when(~t.rlike(r"""[.!?]["'»)]*\s*$"""), "no_sentence_end"), F.when(t.endswith("-"), "hyphenation"), F.when(t.rlike("[,;]$"), "ends_with_comma")), lambda x: x.isNotNull())


def target_cues(text: Column, same_class: Column) -> Column:
    first = F.lower(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1))
    return F.filter(F.array(F.when(text.rlike(r"^\p{Ll}"), "lowercase_start"), F.when(first.isin(*CONTINUATION_WORDS), "continuation_word"), F.when(same_class, "same_element_type")), lambda x: x.isNotNull())


def confidence(cues: Column) -> Column:
    """Weights of the cues, added in hundredths, at most 1."""
    value = lambda c: F.try_element_at(F.create_map(*[F.lit(x) for k, v in CUES.items() for x in (k, round(v * 100))]), c)
    return F.least(F.aggregate(cues, F.lit(0), lambda acc, c: acc + F.coalesce(value(c), F.lit(0))), F.lit(100)).cast("double") / 100


def continuations(df: DataFrame, page_width: float, page_height: float, least: float = 0.5) -> DataFrame:
    """Links of elements(page, idx, class_name, box, text) at a page's bottom to the first fitting one at the next page's top.

    An equi-join on the page number; the boundary filters come before it. Element numbers are those of the input.
    """
    usable = F.col("class_name").isin(*CONTINUABLE) & (F.length(F.trim("text")) >= 10)
    bottom = near_bottom(df.filter(usable), page_height).withColumn("cues", source_cues(F.col("text"))).filter(F.size("cues") > 0)
    a = bottom.select(*[F.col(c).alias(f"a_{c}") for c in ("page", "idx", "class_name", "x0", "x1", "text", "cues")])
    b = near_top(df.filter(usable), page_height).select(*[F.col(c).alias(f"b_{c}") for c in ("page", "idx", "class_name", "x0", "x1", "y0", "text")])
    pairs = a.join(b, F.col("a_page") + 1 == F.col("b_page"))
    column = F.abs((F.col("a_x0") + F.col("a_x1")) / 2 - (F.col("b_x0") + F.col("b_x1")) / 2) < page_width * 0.1
    cues = F.concat("a_cues", target_cues(F.col("b_text"), F.col("a_class_name") == F.col("b_class_name")), F.when(column, F.array(F.lit("same_column"))).otherwise(F.array().cast("array<string>")))
    scored = pairs.withColumn("cues", cues).withColumn("confidence", confidence(F.col("cues"))).filter(F.col("confidence") > least)
    first = scored.withColumn("n", F.row_number().over(Window.partitionBy("a_page", "a_idx").orderBy("b_y0", "b_idx"))).filter("n = 1")
    kind = (
        F.when(F.col("a_class_name").isin(*FOOTNOTES), "footnote").when(F.col("a_class_name") == "table", "table").when(F.col("a_class_name") == "reference", "references")
        .when(F.col("a_class_name") == "figure_caption", "caption").when(F.array_contains("cues", "no_sentence_end"), "sentence").otherwise("paragraph")
    )
    return first.select("a_page", "a_idx", "b_page", "b_idx", kind.alias("continuity"), "confidence", "cues", F.right("a_text", F.lit(50)).alias("text_end"), F.substring("b_text", 1, 50).alias("text_start"))


def units(elements: DataFrame, links: DataFrame) -> DataFrame:
    """unit (its first element), elements, full_text: links closed transitively.

    An element's number is its page times 2**20 plus its place on it.
    """
    number = lambda p, i: (F.col(p).cast("long") * (1 << 20) + F.col(i)).cast("long")
    labels = components(links.select(number("a_page", "a_idx").alias("a"), number("b_page", "b_idx").alias("b")), "units").withColumnRenamed("root", "unit")
    texts = elements.withColumn("node", number("page", "idx")).join(labels, "node")
    parts = texts.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("node", "text"))).alias("p"))
    return parts.select("unit", F.size("p").alias("elements"), T.joined_lines(F.transform("p", lambda x: x["text"])).alias("full_text"))


def captions_with_images(captions: DataFrame, images: DataFrame) -> DataFrame:
    """page, caption, image: images between a caption and the one before it on its page, each used once, by the first caption.

    captions(page, ord, y0, y1) and images(page, image, x0, y1): a join on the page with a range condition.
    """
    order = Window.partitionBy("page").orderBy("ord")
    c = captions.withColumn("above", F.coalesce(F.lag("y1").over(order), F.lit(0.0))).select("page", F.col("ord").alias("caption"), "above", F.col("y0").alias("caption_y"))
    between = (F.col("y1") > F.col("above") - 10) & (F.col("y1") < F.col("caption_y") + 10)
    return c.join(images, "page").filter(between).groupBy("page", "image").agg(F.min("caption").alias("caption"))


def nearest_image(captions: DataFrame, images: DataFrame) -> DataFrame:
    """page, caption, image: the image whose foot is nearest to the caption's head, if above it (as-of join)."""
    c = captions.select("page", F.col("ord").alias("caption"), F.col("y0").alias("caption_y"))
    pairs = c.join(images, "page").filter(F.col("y1") < F.col("caption_y") + 20)
    return pairs.groupBy("page", "caption").agg(F.min_by("image", F.struct(F.abs(F.col("caption_y") - F.col("y1")), "image")).alias("image"))


def distinct_images(df: DataFrame, group: str = "page", key: str = "vec_id") -> DataFrame:
    """Greedy by area: an image goes if it overlaps a larger kept one of its page (IoU over 0.4 or either covered over 0.6).

    Whether an image stays depends on those kept before it, so a page is one group of an Arrow function.
    """

    def keep(pdf):
        import numpy as np

        size = (pdf.x1 - pdf.x0) * (pdf.y1 - pdf.y0)
        pdf = pdf.assign(size=size).sort_values(["size", key], ascending=[False, True], kind="stable")
        kept: list[int] = []
        box = pdf[["x0", "y0", "x1", "y1", "size"]].to_numpy()
        for i in range(len(box)):
            k = box[kept] if kept else box[:0]
            w = np.minimum(k[:, 2], box[i, 2]) - np.maximum(k[:, 0], box[i, 0])
            h = np.minimum(k[:, 3], box[i, 3]) - np.maximum(k[:, 1], box[i, 1])
            common = np.where((w > 0) & (h > 0), w * h, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                over = (common / (k[:, 4] + box[i, 4] - common) > 0.4) | (common / box[i, 4] > 0.6) | (common / k[:, 4] > 0.6)
            if not over.any():
                kept.append(i)
        return pdf.iloc[kept].drop(columns="size")

    return df.groupBy(group).applyInPandas(keep, df.schema)


def page_columns(df: DataFrame, page_width: float) -> DataFrame:
    """page, columns, column_width, column_gap: two columns if left edges stand more than 50 points apart; few blocks are one."""
    edges = df.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.floor("x0").cast("long"))).alias("xs"))
    gaps = F.filter(F.zip_with(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), F.slice("xs", F.lit(1), F.greatest(F.size("xs") - 1, F.lit(0))), lambda b, a: b - a), lambda g: g > 50)
    gap = F.when((F.col("n") >= 3) & (F.size(gaps) > 0), F.array_max(gaps))
    return edges.select("page", F.when(gap.isNotNull(), 2).otherwise(1).alias("columns"), F.coalesce((page_width - 144 - gap) / 2, F.lit(0.0)).alias("column_width"), F.coalesce(gap.cast("double"), F.lit(0.0)).alias("column_gap"))


def margins(df: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """page and the distances of its body blocks (page, text, box) from the edges.

    Short or numeric text at a page's head or foot does not count, nor do narrow blocks left of the upper median edge less 50.
    """
    edge = (F.col("y0") < page_height * 0.1) | (F.col("y1") > page_height * 0.9)
    body = df.filter((F.trim("text") != "") & ~(edge & ((F.length("text") < 10) | F.col("text").rlike(r"^\d+$"))))
    wide = F.filter(F.collect_list(F.struct("x0", "x1")), lambda b: b["x1"] - b["x0"] > 50)
    xs = F.sort_array(F.transform(wide, lambda b: b["x0"]))
    medians = body.groupBy("page").agg(F.coalesce(F.try_element_at(xs, F.floor(F.size(xs) / 2).cast("int") + 1) - 50, F.lit(0.0)).alias("outlier"))
    rows = body.join(medians, "page").filter(~((F.col("x0") < F.col("outlier")) & (F.col("x1") - F.col("x0") < 50)))
    zero = F.lit(0.0)
    return rows.groupBy("page").agg(
        F.greatest(F.min("x0"), zero).alias("left"), F.greatest(F.min("y0"), zero).alias("top"),
        F.greatest(page_width - F.max("x1"), zero).alias("right"), F.greatest(page_height - F.max("y1"), zero).alias("bottom"),
    )


def box(prefix: str = "") -> tuple:
    return G.cols(prefix)


def page_geometry(df: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """page with its margins, columns, header and footer heights and whether it is a title page: one row a page, joined on it."""
    edges = df.groupBy("page").agg(
        F.coalesce(F.max(F.when(F.col("class_name") == "page_header", F.col("y1"))), F.lit(0.0)).alias("header_height"),
        F.coalesce(page_height - F.min(F.when(F.col("class_name") == "page_footer", F.col("y0"))), F.lit(0.0)).alias("footer_height"),
        F.bool_or(F.col("class_name").isin("title", "abstract") & (F.col("page") == 0)).alias("title_page"),
    )
    return edges.join(page_columns(df, page_width), "page").join(margins(df, page_width, page_height), "page", "left")


def headers_and_footers(spans: DataFrame, regions: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """page, position, content, alignment, has_page_number of the text in a page's top and bottom regions(page, top, bottom).

    The first page's regions are 120 and 70 points high at least. spans(page, ord, x0, x1, y0, text) count by their upper edge.
    """
    from foliospark.operators.flow import alignment

    first = F.col("page") == 0
    own = spans.join(regions, "page").withColumn("top", F.when(first, F.greatest("top", F.lit(120.0))).otherwise(F.col("top"))).withColumn("bottom", F.when(first, F.greatest("bottom", F.lit(70.0))).otherwise(F.col("bottom")))
    position = F.when(F.col("y0") < F.col("top"), "header").when(F.col("y0") > page_height - F.col("bottom"), "footer")
    rows = own.withColumn("position", position).filter("position IS NOT NULL").groupBy("page", "position").agg(
        F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"), F.min_by(F.struct("x0", "x1"), "ord").alias("b"))
    content = T.stripped(F.array_join(F.transform("p", lambda x: x["text"]), " "))
    numbered = F.contains(F.col("content"), (F.col("page") + 1).cast("string")) | F.contains(F.col("content"), F.col("page").cast("string"))
    out = rows.select("page", "position", content.alias("content"), alignment(F.col("b.x0"), F.col("b.x1") - F.col("b.x0"), page_width).alias("alignment")).filter("content <> ''")
    return out.withColumn("has_page_number", numbered)
