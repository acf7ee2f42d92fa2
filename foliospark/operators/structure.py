"""Document structure: block kinds, captions, spans into lines, environments, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T

#: Block kind of a detected class, and whether a kind is translated; other kinds are not in the rules (fixed values).
CLASS_KINDS = {
    "title": "document_title", "plain_text": "paragraph", "figure_caption": "figure_caption", "table_caption": "table_caption", "table_footnote": "footnote",
    "isolate_formula": "equation", "page_header": "page_header", "page_footer": "page_footer", "page_number": "page_number", "abstract": "abstract_text",
    "reference": "reference_item", "footnote": "footnote",
}
TRANSLATED = ("document_title", "abstract_text", "keywords_text", "section_heading", "paragraph", "list_item", "figure_caption", "table_caption", "footnote", "acknowledgements")
KEPT = ("doi", "journal_info", "dates", "copyright", "license", "correspondence", "reference_item", "equation", "author_list", "affiliation", "page_header", "page_footer", "page_number")
OPTIONAL = ("abstract_label", "keywords_label", "references_heading")


def block_kind(class_name: Column, text: Column, page: Column, footnote_below: int | None = 200) -> Column:
    """The kind of a block by its class, then by what its text says, in order.

    Text that begins with a footnote's mark is a footnote if it is shorter than `footnote_below` characters; None: of any length.
    """
    low, plain = F.lower(T.stripped(text)), class_name == "plain_text"
    short = F.lit(True) if footnote_below is None else F.length(text) < footnote_below
    by_class = T.mapped(class_name, CLASS_KINDS, F.lit("unknown"))
    return (
        F.when((class_name == "title") & (page > 0), "section_heading")
        .when(plain & (page == 0) & T.like_authors(text), "author_list")
        .when(plain & (F.length(text) < 100) & T.like_heading(text), "section_heading")
        .when(plain & text.rlike(r"^[\d•\-*]\s"), "list_item")
        .when((page == 0) & low.isin("abstract", "summary", "аннотация"), "abstract_label")
        .when((page == 0) & (low.startswith("keywords") | low.startswith("key words")), "keywords_label")
        .when(low.isin("references", "bibliography", "литература", "список литературы"), "references_heading")
        .when(low.startswith("acknowledgement") | low.startswith("acknowledgment"), "acknowledgements")
        .when(low.contains("doi") | text.contains("10.1"), "doi")
        .when(class_name.isin("plain_text", "footnote") & text.rlike(r"^[†‡*\d]") & short, "footnote")
        .otherwise(by_class)
    )


def translation_rule(kind: Column) -> Column:
    """yes, no or optional; null for kinds without a rule."""
    return F.when(kind.isin(*TRANSLATED), "yes").when(kind.isin(*KEPT), "no").when(kind.isin(*OPTIONAL), "optional")


def captions(df: DataFrame, figure: bool) -> DataFrame:
    """doc, page, ord, number, text: captions without repeats on a page; the number is the text's or the place in the document before repeats go."""
    squeezed = F.regexp_replace(F.lower(T.squeezed(F.col("text"))), r"^(figure|fig\.?)\s*\d+[:.]?\s*", "") if figure else F.lower(F.trim("text"))
    pattern = r"(?i)^(?:Figure|Fig\.?)\s*(\d+[a-z]?)" if figure else r"(?i)^Table\s*(\d+)"
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))).withColumn("key", squeezed)
    keyed = placed.withColumn("k", F.row_number().over(Window.partitionBy("doc", "page", "key").orderBy("place"))).filter("k = 1")
    return keyed.select("doc", "page", "ord", F.coalesce(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), F.col("place").cast("string")).alias("number"), "text")


def row_of(ys: Column, within: float = 20.0) -> Column:
    """For an array of heights in order of arrival the row each joins: the first row key closer than `within`, else its own."""
    add = lambda acc, y: F.array_append(acc, F.coalesce(F.get(F.filter(F.array_distinct(acc), lambda k: F.abs(k - y) < within), F.lit(0)), y))
    return F.aggregate(ys, F.array().cast("array<double>"), add)


def line_text(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, text: spans(order, x, y, width, size, text, is_math) joined; a gap or a new line is a space, runs of mathematics are one formula."""
    w = Window.partitionBy(key).orderBy(order)
    last = {c: F.lag(c).over(w) for c in ("x", "y", "width", "text", "is_math")}
    gap = F.col("x") - (last["x"] + last["width"])
    same = F.abs(F.col("y") - last["y"]) < 2
    free = ~last["text"].endswith(" ") & ~F.col("text").startswith(" ")
    in_math = F.col("is_math") & last["is_math"]
    spaced = (same & free & F.when(in_math, gap > F.col("size") * 0.3).otherwise((gap > F.col("size") * 0.12) | (gap > 1.0))) | ((F.col("y") > last["y"] + 2) & ~last["text"].endswith(" ") & ~last["text"].endswith("-"))
    cut = last["text"].isNull() | ~in_math | spaced | (F.col("y") > last["y"] + 2)
    rows = df.withColumn("space", F.coalesce(spaced, F.lit(False))).withColumn("cut", F.coalesce(cut, F.lit(True)))
    grouped = rows.withColumn("part", F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("p"), F.min_by("space", order).alias("space"), F.min_by("is_math", order).alias("is_math"))
    glued = F.array_join(F.transform("p", lambda s: s["text"]), "")
    shown = F.concat(F.when(F.col("space"), " ").otherwise(""), F.when(F.col("is_math"), F.concat(F.lit("$ "), glued, F.lit(" $"))).otherwise(glued))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", shown.alias("t")))), lambda x: x["t"]), "").alias("text"))


def uncovered(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, block of blocks(page, block, box) that no element(page, box) and no block taken before covers by a fifth either way.

    Whether a block is new depends on those before it, so a page's boxes are one group of an Arrow function.
    """
    both = df.select("page", F.lit(None).cast("long").alias("block"), "x0", "y0", "x1", "y1").unionByName(blocks.select("page", F.col("block").cast("long"), "x0", "y0", "x1", "y1"))

    def take(pdf):
        import numpy as np
        import pandas as pd

        there = pdf[pdf.block.isna()][["x0", "y0", "x1", "y1"]].to_numpy()
        new = []
        for row in pdf[pdf.block.notna()].sort_values("block").itertuples():
            box = np.array([row.x0, row.y0, row.x1, row.y1])
            own = (box[2] - box[0]) * (box[3] - box[1])
            if own == 0:
                continue
            w, h = np.minimum(there[:, 2], box[2]) - np.maximum(there[:, 0], box[0]), np.minimum(there[:, 3], box[3]) - np.maximum(there[:, 1], box[1])
            size = (there[:, 2] - there[:, 0]) * (there[:, 3] - there[:, 1])
            common = np.where((w > 0) & (h > 0) & (size > 0), w * h, 0.0)
            if not ((common / own > 0.2) | (common > 0.2 * size)).any():
                new.append((int(row.page), int(row.block)))
                there = np.vstack([there, box])
        return pd.DataFrame(new, columns=["page", "block"])

    return both.groupBy("page").applyInPandas(take, "page long, block long")


def _paired(text: str, names: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
    for name in names:
        open_at: list[int] = []
        for m in re.finditer(rf"\\(begin|end)\{{{re.escape(name)}\}}", text):
            if m[1] == "begin":
                open_at.append(m.start())
            elif open_at:
                a = open_at.pop()
                yield a, m.end(), text[a : m.end()]


def _commands(text: str, name: str) -> Iterator[tuple[int, int, str]]:
    rx, at = re.compile(rf"\\{name}\s*(?=\{{)"), 0
    while m := rx.search(text, at):
        depth, at = 0, m.start() + 1
        for b in re.compile("[{}]").finditer(text, m.end()):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                yield m.start(), b.end(), text[m.start() : b.end()]
                at = b.end()
                break


def blocks(df: DataFrame, key: str, tex: str, environments: tuple[str, ...] = (), commands: tuple[str, ...] = ()) -> DataFrame:
    """key, name, first, last, text: every balanced environment and command with its braces, by place. Nesting needs a stack: an Arrow function."""
    rows = df.select(F.col(key), F.col(tex).alias("tex")).filter("tex IS NOT NULL")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf["tex"]):
                for name in environments:
                    out += [(k, name, *x) for x in _paired(text, (name,))]
                for name in commands:
                    out += [(k, name, *x) for x in _commands(text, name)]
            yield pd.DataFrame(out, columns=[key, "name", "first", "last", "text"])

    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, name string, first int, last int, text string")


#: Environments by element kind (fixed values).
MATH_ENVIRONMENTS = ("equation", "align", "gather", "multline", "eqnarray", "equation*", "align*", "gather*", "multline*", "eqnarray*")
SPECIAL_ENVIRONMENTS = ("tikzpicture", "pgfpicture", "circuitikz", "forest", "tikzcd", "pspicture")
TABLE_ENVIRONMENTS, IMAGE_ENVIRONMENTS = ("table", "tabular", "tabularx", "longtable"), ("figure", "wrapfigure", "subfigure")


def elements(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, ord, kind, environment, content, start_line, end_line: environments, comments and text lines with commands or mathematics in order.

    An environment runs to its own end with nesting; one that is never closed takes the rest, and is said to.
    """
    rows = df.select(F.col(key), F.col(body).alias("body")).filter("body IS NOT NULL")

    def scan(text: str) -> Iterator[tuple[str, str | None, str, int, int]]:
        lines = text.split("\n")
        i = 0
        while i < len(lines):
            line = lines[i]
            begin = re.search(r"\\begin\{([^}]+)\}", line)
            if not line.strip():
                i += 1
                continue
            if line.lstrip().startswith("%"):
                yield "comment", None, line, i + 1, i + 1
            elif begin:
                name, start, depth = begin[1], i, 0
                while i < len(lines):
                    depth += lines[i].count(f"\\begin{{{name}}}") - lines[i].count(f"\\end{{{name}}}")
                    if depth <= 0:
                        break
                    i += 1
                kind = "specialized" if name in SPECIAL_ENVIRONMENTS else "math" if name in MATH_ENVIRONMENTS else "table" if name in TABLE_ENVIRONMENTS else "image" if name in IMAGE_ENVIRONMENTS else "environment"
                yield kind if depth <= 0 else "unclosed", name, "\n".join(lines[start : i + 1]), start + 1, min(i, len(lines) - 1) + 1
            else:
                kind = "math" if re.search(r"(?<!\\)\$|\\\[|\\\(", line) else "command" if re.match(r"\s*\\[A-Za-z]+", line) else "text"
                yield kind, None, line, i + 1, i + 1
            i += 1

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(k, n, *e) for k, text in zip(pdf[key], pdf["body"]) for n, e in enumerate(scan(text))]
            yield pd.DataFrame(out, columns=[key, "ord", "kind", "environment", "content", "start_line", "end_line"])

    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, ord int, kind string, environment string, content string, start_line int, end_line int")


def wrapped_columns(df: DataFrame, key: str, spec: str, body: str) -> DataFrame:
    """key, spec: column specs of tables whose text columns are long, with these as Y; null where nothing is to be wrapped.

    A column is wrapped if its longest cell has 20 characters and no fewer cells hold letters than numbers.
    """
    cells = df.select(key, F.col(spec).alias("spec"), F.posexplode(X.table_rows(F.col(body))).alias("r", "row")).select(key, "spec", F.posexplode("row").alias("c", "cell")).withColumn("t", X.cell_prose(F.col("cell"))).filter("t <> ''")
    stats = cells.groupBy(key, "spec", "c").agg(F.max(F.length("t")).alias("longest"), F.count_if(T.looks_numeric(F.col("t"))).alias("numbers"), F.count_if(F.col("t").rlike(r"\p{L}")).alias("texts"))
    wrap = stats.withColumn("wrap", (F.col("longest") >= 20) & (F.col("texts") >= F.col("numbers"))).groupBy(key, "spec").agg(F.map_from_entries(F.collect_list(F.struct("c", "wrap"))).alias("w"))
    marks = F.filter(F.split("spec", r"(?=[lcr|@ ])|(?<=[lcr| }])", -1), lambda m: m != "")
    kind = "struct<out: string, n: int>"
    fold = F.aggregate(marks, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")).cast(kind), lambda acc, m: F.struct(
        F.concat(acc["out"], F.when(m.rlike("^[lcr]$") & F.coalesce(F.try_element_at("w", acc["n"]), F.lit(False)), "Y").otherwise(m)).alias("out"), (acc["n"] + F.when(m.rlike("^[lcr]$"), 1).otherwise(0)).alias("n")).cast(kind), lambda acc: acc["out"])
    known = ~F.regexp_replace("spec", r"@\{[^}]*\}", "").rlike(r"[^\s|lcr]")
    return wrap.select(key, F.when(known & F.exists(F.map_values("w"), lambda x: x), fold).alias("spec"))


def run_outcome(code: Column, log: Column, has_pdf: Column) -> Column:
    """What an engine run came to: success also with a PDF and no fatal marker, or after a timeout with a PDF."""
    from foliospark.operators.diagnose import FATAL, any_of

    return F.when(code == 0, "success").when(has_pdf & (code == 124), "success_after_timeout").when(has_pdf & ~any_of(log, FATAL), "success_with_errors").otherwise("failure")


def thanks_lines(tex: Column) -> Column:
    """Lines of room for thanks on the title page, by the length of their arguments (three levels of braces)."""
    arguments = F.regexp_extract_all(tex, F.lit(r"\\thanks\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"), F.lit(1))
    total = F.aggregate(arguments, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(total >= 1200, 16).when(total >= 700, 14).when(total >= 350, 12).otherwise(0)


def distinct_spans(df: DataFrame, group: str = "page", order: str = "ord") -> DataFrame:
    """Greedy in order: a span goes if a kept one of its page is within 2 points, or on its line with a text that holds the other.

    Marginal notes of journals go first. What stays depends on what was kept before: a page is one group of an Arrow function.
    """
    margin = (F.col("x") < 20) | (F.col("y") < 15) | (F.col("y") > 785)
    note = F.lower("text").rlike("preprint|journal|accepted") | (F.col("x") < 8) | (F.col("y") < 8)
    marked = F.col("is_title") | F.lower("text").contains("arxiv")
    rows = df.filter((F.trim("text") != "") & ~(margin & ~marked & (F.length("text") > 5) & note))

    def keep(pdf):
        kept: list = []
        stay = []
        for row in pdf.sort_values(order).itertuples():
            t = row.text.strip()
            same = any(((row.x - x) ** 2 + (row.y - y) ** 2) ** 0.5 < 2 or (abs(row.y - y) < 3 and (t in u or u in t)) for x, y, u in kept)
            if not same:
                kept.append((row.x, row.y, t))
                stay.append(row.Index)
        return pdf.loc[stay]

    return rows.groupBy(group).applyInPandas(keep, df.schema)
