"""Decoding, reading back, classes, commands and regions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T
from foliospark.operators import chunking, diagnose, exchange, flow, layout, masking, rewrite, structure
from foliospark.plans.analytics import LOG_SQL, _logs
from foliospark.plans.cases import rule_query
from foliospark.plans.catalog import BOX_TEXTS_SQL, PAGE_HEIGHT, PAGE_WIDTH, box_texts, boxes, query, table, varied, varied_sql
from foliospark.sources import files, sinks
from foliospark.sources.shared import new_path

BEGIN = "\\begin{document}"
for _name, _rule, _cases in [
    ("r01_w14_single_packages", rewrite.single_packages, [
        (f"\\usepackage{{a}}\n \\usepackage{{ a }} % again\n\\usepackage[x]{{a}}\n{BEGIN}\n\\usepackage{{a}}¤", f"\\usepackage{{a}}\n\\usepackage[x]{{a}}\n{BEGIN}\n\\usepackage{{a}}¤"), (f"\\usepackage{{a}}\n{BEGIN}¤", f"\\usepackage{{a}}\n{BEGIN}¤")]),
    ("r37_w13_last_end", rewrite.last_end, [("¤\n\\end{document}\n\n\\end{document}\n№\\end{document}", "¤\n№\\end{document}"), ("¤\\end{document}", "¤\\end{document}"), ("¤", "¤")]),
    ("p07_without_command", lambda t: X.without_command(t, "sidenote"), [("a\\sidenotemark{x {y {z} \\} w}}b ¤", "ab ¤"), ("\\sidenote ¤", "\\sidenote ¤"), ("\\side{x}№¤", "\\side{x}№¤")]),
]:
    rule_query(_name, _rule, _cases)


@query("s08_patched_styles", r"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN concat('  % \renewcommand{\rmdefault}{x}', chr(10), text) ELSE text END) AS text_sha, doc_id % 2 = 0 AS changed FROM documents WHERE doc_id % 3 > 0")
def patched_styles(spark, d):
    k = F.col("doc_id")
    text = F.when(k % 2 == 0, F.concat(F.lit("  \\renewcommand{\\rmdefault}{x}\n"), "text")).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select(F.concat(F.lit("/a/"), k.cast("string"), F.when(k % 3 == 0, ".tex").otherwise(".sty")).alias("path"), text.alias("text"))
    out = files.patched_styles(rows)
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("text_sha"), "changed")


@query("s06_s16_s17_decoded", r"""SELECT doc_id, sha256(concat(text, chr(65533), '.')) AS lossy_sha, sha256(text) AS either_sha, sha256(concat(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), 'é')) AS fallback_sha FROM documents""")
def decoded(spark, d):
    """Whole texts with a byte that is no UTF-8, as UTF-8, and in Latin-1."""
    bad = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("."), "UTF-8"))
    old = F.concat(F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", ""), "UTF-8"), F.unhex(F.lit("E9")))
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(files.utf8(bad), 256).alias("lossy_sha"), F.sha2(files.utf8_or_latin1(F.encode("text", "UTF-8")), 256).alias("either_sha"), F.sha2(files.utf8_or_latin1(old), 256).alias("fallback_sha")
    )


@query("s18_log_tails", f"WITH {LOG_SQL}, n AS (SELECT user_id, string_split(log, chr(10)) AS ls FROM g) SELECT user_id, sha256(array_to_string(ls[greatest(len(ls) - 59, 1):], chr(10))) AS tail_sha FROM n")
def log_tails(spark, d):
    return _logs(spark, d).select("user_id", F.sha2(T.cut_log_tail(F.col("log")), 256).alias("tail_sha"))


@query("s20_bibliography_exists", "SELECT o_custkey AS doc, bool_or((o_orderkey % 4) IN (0, 2) AND o_orderkey % 10 < 5) AS found FROM orders GROUP BY 1")
def bibliography_exists(spark, d):
    """Each customer's orders name two databases; of all names some are there."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("n"), (k % 4).cast("string"), F.lit("_"), (k % 10).cast("string"))
    orders = table(spark, d, "orders")
    aux = orders.groupBy("o_custkey").agg(F.array_join(F.array_distinct(F.collect_list(name)), ", ").alias("names")).select(F.col("o_custkey").alias("doc"), F.concat(F.lit("\\bibdata{"), "names", F.lit("}")).alias("text"))
    there = orders.filter("o_orderkey % 4 IN (0, 2) AND o_orderkey % 10 < 5").select(F.concat(name, F.lit(".bib")).alias("name"))
    return files.bibliography_exists(aux, there)


@query("s30_p26_p47_p49_classes", r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'acl' ELSE '' END AS class, doc_id % 4 = 1 AS wraps, doc_id % 5 IN (0, 1) AS translatable, doc_id % 6 IN (0, 1, 2) AS special FROM documents""")
def classes(spark, d):
    k = F.col("doc_id")
    tex = F.when(k % 3 == 0, F.concat(F.lit("% \\documentclass{no}\n\\documentclass[a]{own}\n"), "text")).when(k % 3 == 1, F.concat(F.lit("\\documentclass{acl, x}\n"), "text")).otherwise(F.col("text"))
    pdf = F.concat("text", F.when(k % 4 == 1, "\\usepackage{pdfpages}\\includepdf{x}").when(k % 4 == 2, "pdfpages").otherwise(""))
    kind = F.when(k % 5 == 0, "intro").when(k % 5 == 1, "paragraph").when(k % 5 == 2, "bib").otherwise("preamble")
    name = F.when(k % 6 == 0, "draw").when(k % 6 == 1, "tikzset").when(k % 6 == 2, "mytikzcmd").otherwise("textbf")
    special = X.special_command(name, F.array(F.lit("draw")), F.array(F.lit("tikz")))
    return table(spark, d, "documents").select("doc_id", files.documentclass(tex).alias("class"), X.wraps_pdf(pdf).alias("wraps"), X.translatable(kind).alias("translatable"), special.alias("special"))


@query("p25_table_errors", "SELECT user_id, user_id % 3 = 0 AS broken FROM (SELECT DISTINCT user_id FROM events)")
def table_errors(spark, d):
    k = F.col("user_id") % 3
    found = F.when(k == 0, F.array(F.lit("! Misplaced \\noalign."), F.lit("l.3 \\begin{tabular}"))).when(k == 1, F.array(F.lit("\\begin{tabular}"))).otherwise(F.array(F.lit("! Extra alignment tab")))
    return table(spark, d, "events").select("user_id").distinct().select("user_id", diagnose.table_errors(found).alias("broken"))


PRESERVED_SQL = r"\[[\d,\s\-–]+\]|\(Eq\.?\s*\d+\)|\(Figure\s*\d+[a-z]?\)|\(Fig\.?\s*\d+[a-z]?\)|\(Table\s*\d+\)|\$[^$]+\$|https?://[^\s]+|\b[A-Z]{2,}\b"


@query("m18_m19_m20_preserved", rf"""WITH t AS (SELECT doc_id, concat('DNA (Fig. 3a) ', replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '.', ' [1, 2-3].'), ' $x$ https://a.b/c (Eq. 7)') AS s FROM documents)
SELECT doc_id, sha256(regexp_replace(s, '{PRESERVED_SQL}', '__P__', 'g')) AS masked_sha, len(regexp_extract_all(s, '{PRESERVED_SQL}')) AS kept, sha256(s) AS back_sha, sha256(regexp_replace(s, '\$[^$]+\$', '<<M>>', 'g')) AS math_sha FROM t""")
def preserved(spark, d):
    s = F.concat(F.lit("DNA (Fig. 3a) "), F.replace(F.regexp_replace("text", r"[^\x00-\x7F]", ""), F.lit("."), F.lit(" [1, 2-3].")), F.lit(" $x$ https://a.b/c (Eq. 7)"))
    rows = table(spark, d, "documents").select("doc_id", masking.numbered_mask(s, masking.PRESERVED, "__PRESERVE_%__").alias("m"), masking.numbered_mask(s, r"\$[^$]+\$", "<<MATH_%>>").alias("f"))
    plain = lambda c, rx, by: F.sha2(F.regexp_replace(c, rx, by), 256)
    return rows.select(
        "doc_id", plain("m.masked", r"__PRESERVE_\d+__", "__P__").alias("masked_sha"), F.size("m.kept").alias("kept"), F.sha2(masking.numbered_unmask(F.col("m.masked"), F.col("m.kept"), "__PRESERVE_%__"), 256).alias("back_sha"),
        plain("f.masked", r"<<MATH_\d+>>", "<<M>>").alias("math_sha"),
    )


@query("x55_headers_and_footers", f"WITH {BOX_TEXTS_SQL}" + r""", g AS (SELECT page, (page % 3 * 60)::DOUBLE AS top, (page % 2 * 90)::DOUBLE AS bottom FROM (SELECT DISTINCT page FROM b)),
r AS (SELECT e.*, CASE WHEN e.page = 0 THEN greatest(top, 120) ELSE top END AS t, CASE WHEN e.page = 0 THEN greatest(bottom, 70) ELSE bottom END AS o FROM e JOIN g USING (page)),
p AS (SELECT *, CASE WHEN y0 < t THEN 'header' WHEN y0 > 792 - o THEN 'footer' END AS position FROM r),
a AS (SELECT page, position, regexp_replace(string_agg(text, ' ' ORDER BY idx), '^\s+|\s+$', '', 'g') AS content, arg_min(x0, idx) AS x0, arg_min(x1, idx) AS x1 FROM p WHERE position IS NOT NULL GROUP BY page, position)
SELECT page, position, sha256(content) AS content_sha, CASE WHEN abs((x0 + x1) / 2 - 306) < 50 THEN 'center' WHEN x0 < 612 * 0.3 THEN 'left' ELSE 'right' END AS alignment, contains(content, (page + 1)::VARCHAR) OR contains(content, page::VARCHAR) AS has_page_number FROM a WHERE content <> ''""")
def headers_and_footers(spark, d):
    rows = box_texts(spark, d).withColumn("ord", F.col("idx"))
    regions = boxes(spark, d).select("page").distinct().select("page", (F.col("page") % 3 * 60).cast("double").alias("top"), (F.col("page") % 2 * 90).cast("double").alias("bottom"))
    out = layout.headers_and_footers(rows, regions, PAGE_WIDTH, PAGE_HEIGHT)
    return out.select("page", "position", F.sha2("content", 256).alias("content_sha"), "alignment", "has_page_number")


@query("l12_l13_l14_nodes", f"WITH {BOX_TEXTS_SQL} SELECT vec_id, sha256(CASE WHEN vec_id % 4 IN (0, 1) THEN concat('U:', text) ELSE text END) AS text_sha FROM e")
def nodes(spark, d):
    """Sections, paragraphs, equations and page numbers as nodes of a tree: what has a rule for it is translated, all others stay."""
    m = F.col("vec_id") % 4
    kind = F.when(m == 0, "section_heading").when(m == 1, "paragraph").when(m == 2, "equation").otherwise("page_number")
    rows = box_texts(spark, d).select("vec_id", "text", kind.alias("kind"))
    out = exchange.asked(rows, "text", "said", lambda t: f"U:{t}", structure.translation_rule(F.col("kind")) == "yes")
    return out.select("vec_id", F.sha2(F.coalesce("said", "text"), 256).alias("text_sha"))


@query("k03_k04_k06_written", "SELECT doc_id, sha256(text) AS text_sha, n_chars AS seconds, doc_id % 2 = 0 AS valid FROM (SELECT doc_id, n_chars, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents)")
def written(spark, d):
    """Reports as JSON and documents as text files in folders by lang, read again."""
    path, texts = new_path(spark, "reports"), new_path(spark, "texts")
    line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    docs = table(spark, d, "documents")
    sinks.report_json(docs.select("doc_id", F.col("n_chars").alias("seconds"), (F.col("doc_id") % 2 == 0).alias("valid")), path)
    sinks.documents(docs.select("lang", F.concat(F.col("doc_id").cast("string"), F.lit("|"), line).alias("line")), texts, "lang", "line")
    read = spark.read.text(texts, wholetext=False).select(F.regexp_extract("value", r"^(\d+)\|", 1).cast("bigint").alias("doc_id"), F.sha2(F.regexp_replace("value", r"^\d+\|", ""), 256).alias("text_sha"))
    return spark.read.schema("doc_id bigint, seconds bigint, valid boolean").json(path).join(read, "doc_id").select("doc_id", "text_sha", "seconds", "valid")


@query("k11_s35_latest_pages", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS page, coalesce(arg_max({'s': CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END}, o_orderkey).s, 'unknown') AS status FROM (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders) GROUP BY o_custkey")
def latest_pages(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"))
    return files.with_defaults(sinks.latest(rows, "o_custkey", "page"), status="unknown").select("o_custkey", "page", "status")


DIVIDED_FORMS = ["P\\begin{document}¤\\begin{thebibliography}{9}№\\end {thebibliography}rest", "¤", "\\begin{document}¤"]


@query("d05_divided", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'P' WHEN 1 THEN NULL ELSE '' END AS preamble, sha256({varied_sql(["\\begin{document}¤", "¤", "\\begin{document}¤"])}) AS body_sha, CASE doc_id % 3 WHEN 0 THEN concat('\\begin{{thebibliography}}{{9}}', doc_id::VARCHAR, '\\end {{thebibliography}}') ELSE '' END AS bibliography, CASE doc_id % 3 WHEN 0 THEN 'rest' ELSE '' END AS rest FROM documents""")
def divided(spark, d):
    rows = table(spark, d, "documents").select("doc_id", chunking.divided(varied(DIVIDED_FORMS)).alias("d"))
    return rows.select("doc_id", "d.preamble", F.sha2("d.body", 256).alias("body_sha"), "d.bibliography", "d.rest")


@query("d08_full_commands", r"SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN concat('\cmd*[o]{', s, '}{b{c}}') WHEN 1 THEN '\x' ELSE '' END) AS command_sha FROM (SELECT doc_id, translate(text, '{}\', '') AS s FROM documents)")
def full_commands(spark, d):
    s = F.translate("text", "{}\\", "")
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a \\cmd*[o]{"), s, F.lit("}{b{c}} tail"))).when(F.col("doc_id") % 3 == 1, F.concat(s, F.lit("\\x tail"))).otherwise(s)
    return table(spark, d, "documents").select("doc_id", F.sha2(X.full_command(line), 256).alias("command_sha"))


@query("s01_metadata", "SELECT c_custkey::VARCHAR AS paper_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'v' || (c_custkey % 9)::VARCHAR END AS version FROM customer WHERE c_custkey IN (1, 7, 42)")
def metadata(spark, d):
    """Records written as JSON, some without a version, and those of three papers read."""
    path = new_path(spark, "papers")
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.cast("string").alias("paper_id"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 9).cast("string"))).alias("version"))
    rows.write.json(path)
    return files.papers(spark, path, ["1", "7", "42"]).select("paper_id", "title", "version")


@query("s13_j27_z05_retried", "SELECT o_orderkey::VARCHAR AS arxiv_id, o_orderstatus AS label, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS pass FROM orders")
def retried(spark, d):
    """A corpus written as one JSON record and read; those that reports call timed out run again."""
    path = new_path(spark, "corpus")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("arxiv_id"), F.col("o_orderstatus").alias("label"), F.lit("smoke").alias("tier"), F.lit("").alias("notes"))
    rows.withColumn("batch", F.crc32("arxiv_id") % 16).groupBy("batch").agg(F.collect_list(F.struct("arxiv_id", "label", "tier", "notes")).alias("items")).select(F.lit(1).alias("version"), "items").write.json(path)
    items = spark.read.schema(files.CORPUS).json(path).select(F.inline("items"))
    late = F.when(F.col("arxiv_id").cast("bigint") % 6 == 0, F.array(F.lit("cli_timeout_sec=9"))).otherwise(F.array(F.lit("log_category: x")))
    reports = items.select(F.array(F.struct("arxiv_id", late.alias("reasons"))).alias("results"))
    again = items.join(files.timed_out(reports), "arxiv_id", "left_semi").select("arxiv_id", F.lit(1).alias("pass"))
    return items.join(again, "arxiv_id", "left").select("arxiv_id", "label", F.coalesce("pass", F.lit(0)).alias("pass"))


@query("x59_math_blocks", r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
s AS (SELECT doc_id, CASE WHEN (i + doc_id) % 4 = 0 THEN 'ABC+CMSY10' ELSE 'Times' END AS font, CASE WHEN doc_id % 3 = 0 THEN concat(t, '=') ELSE t END AS t FROM w),
m AS (SELECT doc_id, avg((font = 'ABC+CMSY10' OR regexp_matches(t, '[\x{0370}-\x{03ff}\x{2200}-\x{22ff}=±×÷√∑∏∫]'))::INT) AS math_share FROM s GROUP BY doc_id) SELECT doc_id, math_share, math_share > 0.7 AS is_equation FROM m""")
def math_blocks(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("i", "t"))
    spans = words.select("doc_id", F.when((F.col("i") + 1 + F.col("doc_id")) % 4 == 0, "ABC+CMSY10").otherwise("Times").alias("font"), F.when(F.col("doc_id") % 3 == 0, F.concat("t", F.lit("="))).otherwise(F.col("t")).alias("text"))
    return flow.math_blocks(spans, "doc_id")
