"""Readers: whole files, JSON records, logs, archives. Everything is a DataFrame with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import report

PAPERS = "paper_id string, title string, authors array<string>, abstract string, published timestamp, updated timestamp, categories array<string>, primary_category string, version string, pdf_url string"
CHECKPOINT = "paper_id string, lang string, masked_sha256 string, total_chunks int, total_cost double, translated_by_index map<string, struct<order: int, text: string, type: string>>"
CACHED = "translated_content string, input_tokens bigint, output_tokens bigint, cost_usd double, model string, metadata map<string, string>, request struct<model: string, temperature: double, max_tokens: int>, messages struct<system: string, user: string>, saved_at string"
CORPUS = "version int, items array<struct<arxiv_id: string, label: string, tier: string, notes: string>>"
#: Well-known names of a paper's main file, best first (fixed values).
MAIN_NAMES = ("main.tex", "ms.tex", "paper.tex", "article.tex", "manuscript.tex")


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and text of each file; malformed UTF-8 becomes replacement characters."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), utf8(F.col("content")).alias("text"), "content")


def utf8(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def utf8_or_latin1(content: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(content.cast("string")), latin1(content))


def papers(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Paper metadata from JSON; the version is what ends the identifier's address."""
    rows = spark.read.schema(PAPERS).json(path)
    return rows.filter(F.col("paper_id").isin(ids)) if ids else rows


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, text of the regular files in tar archives; members that point outside are left out.

    A PDF in place of an archive becomes a wrapper document that includes it.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        wrapper = "\\documentclass{article}\n\\usepackage{pdfpages}\n\\begin{document}\n\\includepdf[pages=-]{original.pdf}\n\\end{document}\n"
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                if bytes(content[:5]) == b"%PDF-":
                    out.append((name, "main.tex", wrapper))
                    continue
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        parts = member.name.split("/")
                        if member.isfile() and not member.name.startswith("/") and ".." not in parts:
                            out.append((name, member.name, tar.extractfile(member).read().decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["archive", "member", "text"])

    return rows.mapInPandas(run, "archive string, member string, text string")


def main_files(files: DataFrame, key: str = "archive") -> DataFrame:
    """key, member: the elected main file of files(key, member, text).

    A well-known name in the root, else the sole file with a class, a root file with one, any with one, the sole file,
    a root file, any; outputs of earlier runs take part in the first rule only; ties go by path.
    """
    tex = files.filter(F.lower("member").endswith(".tex"))
    known = F.create_map(*[F.lit(x) for i, n in enumerate(MAIN_NAMES) for x in (n, i)])
    place = F.try_element_at(known, F.col("member"))
    base = F.element_at(F.split("member", "/"), -1)
    old = base.startswith("translated") | base.contains("_fixed_")
    root, has = ~F.col("member").contains("/"), F.col("text").contains("\\documentclass")
    rank = F.when(place.isNotNull(), place).when(old, F.lit(None)).when(has & root, 101).when(has, 102).when(root, 104).otherwise(105)
    w = Window.partitionBy(key).orderBy("rank", "member")
    return tex.withColumn("rank", rank).filter("rank IS NOT NULL").withColumn("n", F.row_number().over(w)).filter("n = 1").select(key, "member")


def flattened(files: DataFrame, mains: DataFrame, key: str = "archive", depth: int = 10) -> DataFrame:
    """key, text: main files with \\input and \\include replaced by the files' text, from the root folder, `depth` deep.

    A paper is one group; its files are few and small.
    """
    rows = files.join(mains.withColumnRenamed("member", "main"), key)

    def run(pdf):
        import re

        import pandas as pd

        text = dict(zip(pdf["member"], pdf["text"]))
        command = re.compile(r"\\(?:input|include)\{([^}]+)\}")

        def expand(content: str, level: int) -> str:
            def one(m):
                name = m[1].strip()
                found = text.get(name, text.get(name + ".tex"))
                return m[0] if found is None else expand(found, level + 1)

            return content if level > depth else command.sub(one, content)

        return pd.DataFrame([(pdf[key].iloc[0], expand(text[pdf["main"].iloc[0]], 0))], columns=[key, "text"])

    return rows.groupBy(key).applyInPandas(run, f"{key} string, text string")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, lang, translation of a JSON object of strings or of objects by language; other values are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    each = raw.select(F.explode("m").alias("term", "value"))
    by_lang = F.from_json("value", "map<string,string>")
    plain = each.filter(by_lang.isNull() & ~F.col("value").rlike(r"^\s*[\[\d{]|^(true|false|null)$")).select(F.lower("term").alias("term"), F.lit(None).cast("string").alias("lang"), F.col("value").alias("translation"))
    nested = each.select(F.lower("term").alias("term"), F.explode(by_lang).alias("lang", "translation")).withColumn("lang", F.lower(F.trim("lang")))
    return plain.unionByName(nested)


def checkpoint(spark: SparkSession, path: str, paper: str, lang: str, sha256: str) -> DataFrame:
    """order, text, kind of the finished chunks of a checkpoint; none if paper, language or masked text differ."""
    rows = spark.read.schema(CHECKPOINT).option("multiLine", True).json(path)
    own = rows.filter((F.col("paper_id") == paper) & (F.lower("lang") == lang.lower()) & (F.col("masked_sha256") == sha256))
    each = own.select(F.explode("translated_by_index").alias("i", "c")).filter(F.expr("try_cast(i AS int)").isNotNull())
    return each.select(F.expr("try_cast(i AS int)").alias("idx"), "c.order", "c.text", F.col("c.type").alias("kind")).filter("order IS NOT NULL AND text IS NOT NULL AND kind IS NOT NULL")


def cached_results(spark: SparkSession, path: str) -> DataFrame:
    """key and fields of a folder of cached replies, a JSON file for each key; corrupt files are left out."""
    rows = spark.read.schema(CACHED + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return rows.withColumn("key", key).filter("_corrupt_record IS NULL AND translated_content IS NOT NULL").drop("_corrupt_record")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).select(F.inline("items"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """passed and failed of report files, 0 where they are absent."""
    rows = spark.read.schema("passed bigint, failed bigint, results array<struct<arxiv_id: string, reasons: array<string>>>").option("multiLine", True).json(path)
    return rows.select(F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("failed", F.lit(0)).alias("failed"), "results")


def timed_out(found: DataFrame) -> DataFrame:
    """Cases of reports whose reasons speak of a timeout."""
    each = found.select(F.inline("results"))
    return each.filter(F.exists("reasons", lambda r: r.startswith("cli_failed_rc=124") | r.contains("cli_timeout_sec="))).select("arxiv_id").distinct()


def run_costs(spark: SparkSession, path: str, header: str, model: str = "gpt-5.1") -> DataFrame:
    """input_tokens, output_tokens, cost of an application log since its last run header."""
    # One log file is one partition and its lines keep their order.
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
    own = report.since_last(rows, "line_no", F.col("line").contains(header))
    tokens = own.select(*[F.regexp_extract("line", r"Translation complete: (\d+) input tokens, (\d+) output tokens", i).alias(n) for i, n in ((1, "a"), (2, "b"))]).filter("a <> ''")
    total = tokens.agg(F.coalesce(F.sum(F.col("a").cast("bigint")), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.col("b").cast("bigint")), F.lit(0)).alias("output_tokens"))
    return total.withColumn("cost", report.cost(F.col("input_tokens"), F.col("output_tokens"), model))


def fallback_bibliography(files: DataFrame, target: str) -> DataFrame:
    """The largest .bbl file with an item, other than the target's own."""
    other = files.filter(F.col("path").endswith(".bbl") & ~F.col("path").endswith(f"/{target}.bbl") & F.col("text").contains("\\bibitem"))
    return other.orderBy(F.desc("size"), "path").limit(1)


def bibliography_exists(aux: DataFrame, files: DataFrame) -> DataFrame:
    """doc, found: whether any database that an aux file (doc, text) names is among files(name)."""
    named = aux.select("doc", F.explode(F.split(F.regexp_extract("text", r"\\bibdata\{([^}]*)\}", 1), ",")).alias("n")).withColumn("name", F.concat(F.trim("n"), F.lit(".bib")))
    return named.join(files.select("name").distinct().withColumn("there", F.lit(True)), "name", "left").groupBy("doc").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("found"))


def patched_styles(files: DataFrame) -> DataFrame:
    """Style files whose default fonts are commented out, where they set any."""
    text = F.regexp_replace("text", r"(?m)^(\s*)(\\renewcommand\{\\(?:rm|sf)default\}\{[^}]*\})", "$1% $2")
    return files.filter(F.col("path").endswith(".sty")).select("path", text.alias("text"), (text != F.col("text")).alias("changed"))


def documentclass(tex: Column, lines: int = 250) -> Column:
    """The class in the first lines that are no comments; options after a comma do not count."""
    head = F.array_join(F.filter(F.slice(F.split(tex, "\n"), 1, lines), lambda x: ~F.ltrim(x).startswith("%")), "\n")
    return F.trim(F.split(F.regexp_extract(head, r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}", 1), ",")[0])


def with_originals(papers: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """papers with the path of their original where there is one (several: the first by path); none is an error."""
    own = originals.groupBy(key).agg(F.min("path").alias("original_path"))
    return papers.join(own, key, "left")


def articles(metadata: DataFrame, mains: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """What is known of each paper that has metadata and an elected main file, with its original if there is one."""
    return with_originals(metadata.join(mains, key), originals, key)


def with_defaults(rows: DataFrame, **defaults: str) -> DataFrame:
    """rows with a default in the named columns where they are null, as metadata that could not be read."""
    return rows.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})
