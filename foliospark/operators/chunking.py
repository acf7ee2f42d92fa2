"""Documents into ordered chunks: preamble, intro, sections, paragraphs, bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

BEGIN = "\\begin{document}"
BIBLIOGRAPHY = "\\begin{thebibliography}"
BIBLIOGRAPHY_END = r"\\end\s*\{\s*thebibliography\s*\}"
SECTION_START = r"(?=\\(?:section|chapter|part)\*?\{)"


def packed(parts: Column, most: int, joint: str = "\n\n") -> Column:
    """Parts greedily packed in order into pieces of at most `most` estimated tokens; a larger part stays whole.

    array<struct<text, tokens>>; each part is followed by `joint`, tokens are the parts' own estimates summed.
    """
    kind = "struct<done: array<struct<text: string, tokens: bigint>>, text: string, tokens: bigint>"
    start = F.struct(F.array().alias("done"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("tokens")).cast(kind)

    def add(acc: Column, part: Column) -> Column:
        n = T.token_estimate(part)
        full = (acc["tokens"] + n > most) & (acc["text"] != "")
        here = F.struct(acc["text"].alias("text"), acc["tokens"].alias("tokens"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(here))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.concat(part, F.lit(joint))).otherwise(F.concat(acc["text"], part, F.lit(joint))).alias("text"),
            F.when(full, n).otherwise(acc["tokens"] + n).alias("tokens"),
        ).cast(kind)

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["text"].alias("text"), acc["tokens"].alias("tokens"))
        return F.when(acc["text"] != "", F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(parts, start, add, finish)


def divided(tex: Column) -> Column:
    """struct<preamble, body, bibliography, rest>; without a begin command all is body, without an end the bibliography runs on."""
    begin = F.instr(tex, BEGIN)
    all_body = F.when(begin > 0, F.substring(tex, begin, F.length(tex))).otherwise(tex)
    bib = F.instr(all_body, BIBLIOGRAPHY)
    from_bib = F.substring(all_body, bib, F.length(all_body))
    found = F.regexp_extract(from_bib, rf"(?s)^(.*?{BIBLIOGRAPHY_END})", 1)
    bibliography = F.when(bib == 0, "").when(found != "", found).otherwise(from_bib)
    return F.struct(
        F.when(begin > 0, F.substring(tex, F.lit(1), begin - 1)).alias("preamble"),
        F.when(bib > 0, F.substring(all_body, F.lit(1), bib - 1)).otherwise(all_body).alias("body"),
        bibliography.alias("bibliography"),
        F.when(bib > 0, F.substring(from_bib, F.length(bibliography) + 1, F.length(from_bib))).otherwise("").alias("rest"),
    )


def _pieces(kind: Column, text: Column, title: Column) -> Column:
    return F.array(F.struct(kind.alias("kind"), text.alias("text"), T.token_estimate(text).alias("tokens"), title.alias("title")))


def _large(text: Column, kind: str, title: Column, most: int) -> Column:
    paragraphs = F.split(text, r"(?U)\n\s*\n", -1)
    return F.transform(packed(paragraphs, most), lambda p: F.struct(F.lit(kind).alias("kind"), p["text"].alias("text"), p["tokens"].alias("tokens"), title.alias("title")))


def sections(body: Column, most: int) -> Column:
    """array<struct<kind, text, tokens, title>> of a body: what comes before the first heading is intro, large sections are packed."""
    parts = F.filter(F.split(body, SECTION_START, -1), lambda p: p != "")
    starts = lambda p: p.rlike(r"(?s)^\\(?:section|chapter|part)\*?\{")
    title = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"\{([^}]+)\}", 1), F.lit("")), F.lit("Section"))
    none = F.lit(None).cast("string")

    def part(p: Column) -> Column:
        own = F.when(T.token_estimate(p) > most, _large(p, "section", title(p), most)).otherwise(_pieces(F.lit("section"), p, title(p)))
        return F.when(starts(p), own).when(T.stripped(p) == "", F.slice(_pieces(F.lit("intro"), p, none), 1, 0)).otherwise(_large(p, "intro", none, most))

    return F.when(F.exists(parts, starts), F.flatten(F.transform(parts, part))).otherwise(_large(body, "paragraph", none, most))


def bibliography_foot(bib: Column) -> Column:
    return F.regexp_extract(bib, rf"(?s)({BIBLIOGRAPHY_END}.*)$", 1)


def bibliography_items(bib: Column, foot: Column, most: int) -> Column:
    """A large bibliography without its foot, packed by items; the header stays with the first one."""
    head = F.substring(bib, F.lit(1), F.length(bib) - F.length(foot))
    parts = F.split(head, r"(?=\\bibitem\{[^}]+\})", -1)
    first = F.concat(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return packed(F.concat(F.array(first), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))), most, "")


def chunks(df: DataFrame, key: str, tex: str, most: int = 1500) -> DataFrame:
    """key, ord, chunk_id, kind, text, tokens, title: the ordered chunks of each document; nothing of the text is lost but the joints."""
    # Stage by stage: what several later expressions read is a column of its own, computed once.
    staged = df.select(key, divided(F.col(tex)).alias("d"))
    none = F.lit(None).cast("string")
    empty = F.slice(_pieces(F.lit("x"), F.lit(""), none), 1, 0)
    bib, large = F.col("d.bibliography"), T.token_estimate(F.col("d.bibliography")) > most
    staged = staged.withColumn("foot", bibliography_foot(bib)).withColumn("items", F.when(large, bibliography_items(bib, F.col("foot"), most)))
    last = F.element_at("items", -1)["text"]
    texts = F.concat(F.transform(F.slice("items", F.lit(1), F.size("items") - 1), lambda p: p["text"]), F.array(F.concat(last, F.col("foot"))))
    titled = F.transform(texts, lambda t: F.struct(F.lit("bib").alias("kind"), t.alias("text"), T.token_estimate(t).alias("tokens"), F.lit("Bibliography").alias("title")))
    some = lambda part: F.when(T.stripped(part) != "", sections(part, most)).otherwise(empty)
    own = F.when(bib == "", empty).when(large, titled).otherwise(_pieces(F.lit("bib"), bib, F.lit("Bibliography")))
    preamble = F.when(F.col("d.preamble").isNotNull(), _pieces(F.lit("preamble"), F.col("d.preamble"), F.lit("Document Preamble"))).otherwise(empty)
    rows = staged.select(key, F.posexplode(F.concat(preamble, some(F.col("d.body")), own, some(F.col("d.rest")))).alias("ord", "c")).select(key, "ord", "c.*")
    return rows.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("ord").cast("string"), F.lit("_"), F.col("kind")))


def assembled(df: DataFrame, key: str, order: str = "ord", text: str = "text") -> DataFrame:
    """key, full_text: chunks in order, joined by blank lines."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts"))
    return rows.select(key, F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("full_text"))
