"""The registry of queries and the inputs that they derive from the tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) and the same query as SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a LaTeX body made of their lines: every fifth line is a section heading, the others paragraphs."""
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda line, i: F.when(i % 5 == 0, F.concat(F.lit("\\section{"), line, F.lit("}"))).otherwise(line)), "\n\n")
    head, tail = F.lit("\\documentclass{article}\n\\begin{document}\n"), F.lit("\n\\end{document}\n")
    return table(spark, sf_dir, "documents").withColumn("latex", F.concat(head, body, tail))


TEX_SQL = r"""l AS (
  SELECT doc_id, lang, source, text, concat('\documentclass{article}', chr(10), '\begin{document}', chr(10),
    array_to_string(list_transform(string_split(text, chr(10)),
      lambda l, i: CASE WHEN (i - 1) % 5 = 0 THEN concat('\section{', l, '}') ELSE l END), chr(10) || chr(10)),
    chr(10), '\end{document}', chr(10)) AS latex FROM documents)"""

#: Layout classes by detector id (fixed values).
LAYOUT_CLASSES = (
    "title", "plain_text", "abandon", "figure", "figure_caption", "table", "table_caption", "table_footnote",
    "isolate_formula", "formula_caption", "page_header", "page_footer", "page_number", "abstract", "reference", "footnote",
)
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected elements laid out from the vectors' ids: page, idx, class_name, bounding box."""
    v = F.col("vec_id")
    x0, y0 = v * 37 % 500, v * 53 % 700
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(v / 25).alias("page"), (v % 25).alias("idx"), F.element_at(F.array(*map(F.lit, LAYOUT_CLASSES)), (v * 7 % 16 + 1).cast("int")).alias("class_name"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 20 + v * 11 % 180).cast("double").alias("x1"), (y0 + 5 + v * 13 % 140).cast("double").alias("y1"),
    )


BOXES_SQL = (
    "b AS (SELECT vec_id, vec_id // 25 AS page, vec_id % 25 AS idx, ["
    + ", ".join(f"'{c}'" for c in LAYOUT_CLASSES)
    + """][vec_id * 7 % 16 + 1] AS class_name,
  (vec_id * 37 % 500)::DOUBLE AS x0, (vec_id * 53 % 700)::DOUBLE AS y0,
  (vec_id * 37 % 500 + 20 + vec_id * 11 % 180)::DOUBLE AS x1, (vec_id * 53 % 700 + 5 + vec_id * 13 % 140)::DOUBLE AS y1 FROM embeddings)"""
)


def box_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes with the document of the same number as their text; of three, one breaks off and one goes on from another."""
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat("text", F.lit(" and"))).when(k == 1, F.concat(F.lit("however "), "text")).otherwise(F.col("text"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), text.alias("text"))
    return boxes(spark, sf_dir).join(texts, "vec_id")


BOX_TEXTS_SQL = BOXES_SQL + ", e AS (SELECT b.*, CASE d.doc_id % 3 WHEN 0 THEN concat(d.text, ' and') WHEN 1 THEN concat('however ', d.text) ELSE d.text END AS text FROM b JOIN documents d ON d.doc_id = b.vec_id)"


_PARTS = re.compile("([¤№])")


def _column(form: str) -> Column:
    cols = {"¤": F.col("text"), "№": F.col("doc_id").cast("string")}
    return F.concat(*[cols[p] if p in cols else F.lit(p) for p in _PARTS.split(form) if p] or [F.lit("")])


def _sql(form: str) -> str:
    cols = {"¤": "text", "№": "doc_id::VARCHAR"}
    return "concat(" + ", ".join(cols[p] if p in cols else "'" + p.replace("'", "''") + "'" for p in _PARTS.split(form) if p or form == "") + ")"


def varied(forms: list[str]) -> Column:
    """The form number doc_id % len(forms)."""
    out = _column(forms[-1])
    for k, form in enumerate(forms[:-1]):
        out = F.when(F.col("doc_id") % len(forms) == k, _column(form)).otherwise(out)
    return out


def varied_sql(forms: list[str]) -> str:
    arms = "".join(f" WHEN {k} THEN {_sql(form)}" for k, form in enumerate(forms))
    return f"CASE doc_id % {len(forms)}{arms} END"
