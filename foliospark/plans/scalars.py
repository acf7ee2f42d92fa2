"""Scalar operators as queries: text, TeX and geometry functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import tex as X
from foliospark.functions import text as T
from foliospark.operators import report as R
from foliospark.plans.catalog import BOXES_SQL, PAGE_HEIGHT, PAGE_WIDTH, TEX_SQL, boxes, query, table, tex_documents

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.ENGLISH_STOP_WORDS) + "]"


@query("x01_x02_paper_id", r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://arxiv.org/abs/', lpad((page_id % 10000)::VARCHAR, 4, '1'), '.', lpad((page_id * 37 % 100000)::VARCHAR, 5, '0'), 'v2')
   WHEN 1 THEN concat(' ', lpad((page_id % 10000)::VARCHAR, 4, '1'), '.', lpad((page_id * 37 % 10000)::VARCHAR, 4, '0'), ' ')
   WHEN 2 THEN concat('https://arxiv.org/pdf/hep-th/', lpad(page_id::VARCHAR, 7, '9'), '.pdf') ELSE url END AS address FROM pages),
r AS (SELECT *, coalesce(nullif(regexp_extract(address, 'arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?|\w+-\w+/\d{7}(?:v\d+)?)', 1), ''),
   nullif(regexp_extract(trim(address), '^(\d{4}\.\d{4,5}(?:v\d+)?|\w+-\w+/\d{7}(?:v\d+)?)$', 1), '')) AS paper_id FROM u)
SELECT page_id, paper_id, paper_id IS NOT NULL AS valid FROM r""")
def x01(spark, d):
    p = F.col("page_id")
    left = F.lpad((p % 10000).cast("string"), 4, "1")
    address = (
        F.when(p % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), left, F.lit("."), F.lpad((p * 37 % 100000).cast("string"), 5, "0"), F.lit("v2")))
        .when(p % 4 == 1, F.concat(F.lit(" "), left, F.lit("."), F.lpad((p * 37 % 10000).cast("string"), 4, "0"), F.lit(" ")))
        .when(p % 4 == 2, F.concat(F.lit("https://arxiv.org/pdf/hep-th/"), F.lpad(p.cast("string"), 7, "9"), F.lit(".pdf")))
        .otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", T.paper_id(address).alias("paper_id")).withColumn("valid", F.col("paper_id").isNotNull())


@query("x03_x04_x05_names", r"""
WITH t AS (SELECT doc_id, concat(' .', replace(text, 'a', ':'), '?. ') AS s FROM documents),
n AS (SELECT doc_id, s, trim(translate(s, '<>:"/\|?*', '_________'), ' .') AS file_name, left(trim(regexp_replace(s, '[^\p{L}\p{N} _-]', '', 'g')), 50) AS short_name,
  trim(regexp_replace(trim(s), '[^\p{L}\p{N}\-_.]', '_', 'g'), '._-') AS safe FROM t)
SELECT doc_id, sha256(file_name) AS file_sha, short_name, sha256(CASE WHEN safe = '' THEN 'paper' ELSE safe END) AS safe_sha FROM n""")
def names(spark, d):
    s = F.concat(F.lit(" ."), F.replace("text", F.lit("a"), F.lit(":")), F.lit("?. "))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.file_name(s), 256).alias("file_sha"), T.short_name(s).alias("short_name"), F.sha2(T.safe_id(s), 256).alias("safe_sha"))


@query("x06_size_label", r"""
WITH t AS (SELECT doc_id, n_chars * (1 + doc_id % 7 * 997 * (doc_id % 5) * 1000) AS size FROM documents)
SELECT doc_id, size, CASE WHEN size < 1024 THEN format('{:.1f} B', size::DOUBLE) WHEN size / 1024.0::DOUBLE < 1024 THEN format('{:.1f} KB', size / 1024.0::DOUBLE)
  WHEN size / 1048576.0::DOUBLE < 1024 THEN format('{:.1f} MB', size / 1048576.0::DOUBLE) WHEN size / 1073741824.0::DOUBLE < 1024 THEN format('{:.1f} GB', size / 1073741824.0::DOUBLE)
  ELSE format('{:.1f} TB', size / 1099511627776.0::DOUBLE) END AS label FROM t""")
def size_label(spark, d):
    size = F.col("n_chars") * (1 + F.col("doc_id") % 7 * 997 * (F.col("doc_id") % 5) * 1000)
    return table(spark, d, "documents").select("doc_id", size.alias("size"), T.size_label(size).alias("label"))


@query("x07_x08_lines_and_cuts", r"""
WITH t AS (SELECT doc_id, text, replace(text, chr(10), concat(chr(10), '  ', chr(10), chr(10))) AS s FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(string_split(s, chr(10)), lambda x: x = '' OR regexp_matches(x, '\S')), chr(10))) AS without_blank_sha,
  CASE WHEN length(text) <= 100 THEN text ELSE concat(left(text, 97), '...') END AS truncated FROM t""")
def lines_and_cuts(spark, d):
    s = F.replace("text", F.lit("\n"), F.lit("\n  \n\n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.without_blank_lines(s), 256).alias("without_blank_sha"), T.truncated(F.col("text"), 100).alias("truncated"))


@query("x10_x11_x12_languages", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN 'ZH-CN' WHEN 2 THEN ' jp ' WHEN 3 THEN 'korean' WHEN 4 THEN '' ELSE 'xx' END AS lang FROM documents),
c AS (SELECT *, CASE WHEN trim(lang) = '' THEN 'ru' ELSE lower(trim(lang)) END AS given FROM t)
SELECT doc_id, CASE given WHEN 'zh-cn' THEN 'zh' WHEN 'jp' THEN 'ja' WHEN 'korean' THEN 'ko' ELSE given END AS code,
  CASE WHEN trim(lang) = '' THEN 'Russian' WHEN given = 'en' THEN 'English' WHEN given = 'fr' THEN 'French' WHEN given = 'de' THEN 'German' WHEN given = 'es' THEN 'Spanish' WHEN given = 'jp' THEN 'Japanese' ELSE lang END AS name FROM c""")
def languages(spark, d):
    m = F.col("doc_id") % 6
    lang = F.when(m == 0, F.col("lang")).when(m == 1, "ZH-CN").when(m == 2, " jp ").when(m == 3, "korean").when(m == 4, "").otherwise("xx")
    return table(spark, d, "documents").select("doc_id", T.language_code(lang).alias("code"), T.language_name(lang).alias("name"))


@query("x13_x14_x15_x16_digests", r"""
SELECT doc_id, sha256(text) AS text_sha256, left(sha1(text), 10) AS folder, left(md5(text), 8) AS image_tag, length(text) // 4 AS tokens,
  sha256(concat('{"max_tokens": 16000, "model": "m", "system": "s", "temperature": 0.3, "user": "', replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), '"}')) AS cache_key FROM documents""")
def digests(spark, d):
    from foliospark.operators.cache import cache_key

    key = cache_key(F.lit("s"), F.col("text"), "m", 0.3, 16000)
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.substring(F.sha1("text"), 1, 10).alias("folder"), F.substring(F.md5("text"), 1, 8).alias("image_tag"), T.token_estimate(F.col("text")).alias("tokens"), key.alias("cache_key"))


@query("x18_hyphen_join", r"""
WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN turn % 3 = 0 THEN concat(text, '-') ELSE text END AS s FROM conversations),
r AS (SELECT conv_id, i, s AS acc FROM p WHERE i = 1 UNION ALL
  SELECT p.conv_id, p.i, CASE WHEN right(acc, 1) = '-' THEN concat(left(acc, length(acc) - 1), s) ELSE concat(acc, ' ', s) END FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1)
SELECT conv_id, sha256(arg_max(acc, i)) AS joined_sha FROM r GROUP BY conv_id""")
def hyphen_join(spark, d):
    part = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("s")))).alias("p"))
    return rows.select("conv_id", F.sha2(T.joined_lines(F.transform("p", lambda x: x["s"])), 256).alias("joined_sha"))


@query("x19_without_fence", r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('```latex', chr(10), text, chr(10), '```', chr(10)) ELSE concat(' ', text) END AS s FROM documents)
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS reply_sha FROM documents""")
def without_fence(spark, d):
    s = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```latex\n"), "text", F.lit("\n```\n"))).otherwise(F.concat(F.lit(" "), "text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.without_fence(s), 256).alias("reply_sha"))


@query("x20_x27_titles_and_inserts", f"WITH {TEX_SQL}" + r"""
SELECT doc_id, sha256(array_to_string(regexp_extract_all(latex, '\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^}]*)\}', 1), chr(10))) AS titles_sha,
  sha256(replace(latex, '\begin{document}', concat('\usepackage{x}', chr(10), '\begin{document}'))) AS inserted_sha FROM l""")
def titles(spark, d):
    tex = F.col("latex")
    return tex_documents(spark, d).select("doc_id", F.sha2(X.heading_titles(tex), 256).alias("titles_sha"), F.sha2(X.insert_before_document(tex, F.lit("\\usepackage{x}\n")), 256).alias("inserted_sha"))


@query("x26_escaped", r"""
SELECT doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', chr(1)), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'),
 '{', '\{'), '}', '\}'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}')) AS escaped_sha FROM documents""")
def escaped(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.escaped(F.col("text")), 256).alias("escaped_sha"))


@query("x31_x40_stamp", r"""
SELECT o_orderkey, concat_ws(' ', concat('arXiv:', lpad((o_orderkey % 10000)::VARCHAR, 4, '0'), '.', lpad((o_orderkey % 99999)::VARCHAR, 5, '0'), 'v', (o_orderkey % 3 + 1)::VARCHAR),
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '[cs.CL]' END, concat(day(o_orderdate)::VARCHAR, ' ', strftime(o_orderdate, '%b %Y'))) AS stamp FROM orders""")
def stamp(spark, d):
    k = F.col("o_orderkey")
    ident = F.concat(F.lit("arXiv:"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k % 99999).cast("string"), 5, "0"), F.lit("v"), (k % 3 + 1).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", ident, F.when(k % 5 != 0, F.lit("[cs.CL]")), F.date_format("o_orderdate", "d MMM yyyy")).alias("stamp"))


@query("x41_a04_request_cost", r"""
SELECT l_orderkey, sum(l_partkey)::BIGINT AS input_tokens, sum(l_suppkey)::BIGINT AS output_tokens,
  (sum((l_partkey * 15 + l_suppkey * 60))::DOUBLE / 100000000)::DECIMAL(18, 8) AS cost FROM lineitem GROUP BY l_orderkey""")
def request_cost(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_partkey").cast("long").alias("input_tokens"), F.sum("l_suppkey").cast("long").alias("output_tokens"))
    return rows.withColumn("cost", R.cost(F.col("input_tokens"), F.col("output_tokens")).cast("decimal(18,8)"))


@query("x42_x43_backoff", r"""SELECT o_orderkey, o_orderkey % 9 AS attempt, least(pow(2.0, o_orderkey % 9), 60.0)::DOUBLE AS request_wait, least(pow(2.0, o_orderkey % 9), 8.0)::DOUBLE AS chunk_wait FROM orders""")
def waits(spark, d):
    k = F.col("o_orderkey") % 9
    return table(spark, d, "orders").select("o_orderkey", k.alias("attempt"), R.backoff(k).alias("request_wait"), R.backoff(k, most=8.0).alias("chunk_wait"))


@query("x44_x45_x47_boxes", f"WITH {BOXES_SQL}" + r"""
SELECT vec_id, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y, (x1 - x0) * (y1 - y0) AS area,
 CASE WHEN y1 > y0 THEN (x1 - x0) / (y1 - y0) ELSE 0 END AS aspect, 612.0::DOUBLE - x0 - x1 AS content_width FROM b""")
def box_figures(spark, d):
    b = G.cols()
    cx, cy = G.center(b)
    return boxes(spark, d).select("vec_id", G.width(b).alias("width"), G.height(b).alias("height"), cx.alias("center_x"), cy.alias("center_y"), G.area(b).alias("area"), G.aspect(b).alias("aspect"), (F.lit(PAGE_WIDTH) - b[0] - b[2]).alias("content_width"))


@query("x46_p53_overlap_pairs", f"WITH {BOXES_SQL}, p AS (SELECT a.page, a.vec_id AS a, c.vec_id AS c, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, c.x0, c.y0, c.x1, c.y1 FROM b a JOIN b c ON a.page = c.page AND a.vec_id < c.vec_id AND a.x1 >= c.x0 AND a.x0 <= c.x1 AND a.y1 >= c.y0 AND a.y0 <= c.y1)," + r"""
q AS (SELECT *, greatest(least(ax1, x1) - greatest(ax0, x0), 0) * greatest(least(ay1, y1) - greatest(ay0, y0), 0) AS common FROM p)
SELECT page, a, c, ax0 <= x0 AND ay0 <= y0 AND ax1 >= x1 AND ay1 >= y1 AS inside, common / ((ax1 - ax0) * (ay1 - ay0) + (x1 - x0) * (y1 - y0) - common) AS iou,
 common / ((ax1 - ax0) * (ay1 - ay0)) AS covered FROM q""")
def overlap_pairs(spark, d):
    df = boxes(spark, d).select("page", "vec_id", "x0", "y0", "x1", "y1")
    a = df.select("page", F.col("vec_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = a.join(df.withColumnRenamed("vec_id", "c"), "page").filter((F.col("a") < F.col("c")) & G.overlaps(G.cols("a"), G.cols()))
    return pairs.select("page", "a", "c", G.contains(G.cols("a"), G.cols()).alias("inside"), G.iou(G.cols("a"), G.cols()).alias("iou"), G.coverage(G.cols("a"), G.cols()).alias("covered"))


@query("x48_x49_x50_paper_format", r"""
WITH t AS (SELECT p_partkey, 590.0::DOUBLE + p_size AS w, CASE WHEN p_partkey % 2 = 0 THEN 842.0 ELSE 792.0 END::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN abs(w - 595) < 5 AND abs(h - 842) < 5 THEN 'a4' WHEN abs(w - 612) < 5 AND abs(h - 792) < 5 THEN 'letter' ELSE 'custom' END AS strict,
 CASE WHEN abs(w - 595) < 10 AND abs(h - 842) < 10 THEN 'a4' WHEN abs(w - 612) < 10 AND abs(h - 792) < 10 THEN 'letter' ELSE 'custom' END AS lenient, w * 72 / 144 AS points FROM t""")
def paper_format(spark, d):
    w, h = F.col("p_size") + F.lit(590.0), F.when(F.col("p_partkey") % 2 == 0, 842.0).otherwise(792.0)
    return table(spark, d, "part").select("p_partkey", G.paper_format(w, h).alias("strict"), G.paper_format(w, h, 10).alias("lenient"), (w * 72 / 144).alias("points"))


@query("x51_a13_length_ratio", f"WITH {TEX_SQL}" + r"""
SELECT a.doc_id, CASE WHEN length(a.latex) > 0 THEN length(c.latex)::DOUBLE / length(a.latex) ELSE 0 END AS ratio,
 len(regexp_extract_all(a.latex, '\\section\{')) AS sections, len(regexp_extract_all(a.latex, '\$\$')) + len(regexp_extract_all(a.latex, '\\\[')) AS displays
FROM l a JOIN l c ON c.doc_id = a.doc_id + 1""")
def length_ratio(spark, d):
    from foliospark.operators import validation as V

    df = tex_documents(spark, d)
    other = df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("latex").alias("other"))
    return df.join(other, "doc_id").select("doc_id", V.length_ratio(F.col("latex"), F.col("other")).alias("ratio"), V.section_count(F.col("latex")).alias("sections"), V.display_count(F.col("latex")).alias("displays"))


@query("x52_x53_x54_j09_roles", f"WITH {BOXES_SQL}" + r""",
f AS (SELECT DISTINCT i.vec_id FROM b i JOIN b g ON i.page = g.page AND g.class_name = 'figure' AND i.x1 >= g.x0 AND i.x0 <= g.x1 AND i.y1 >= g.y0 AND i.y0 <= g.y1)
SELECT b.vec_id, CASE WHEN y1 - y0 < 30 THEN CASE WHEN y0 / 792 < 0.15 THEN 'header_line' WHEN y0 / 792 > 0.9 THEN 'footer_line' WHEN y0 / 792 < 0.25 THEN 'title_underline' ELSE 'section_separator' END ELSE 'decorative' END AS line_role,
 CASE WHEN y0 / 792 < 0.4 AND (y1 - y0) / 792 > 0.1 THEN 'abstract_box' WHEN x1 - x0 < 100 AND (y1 - y0) / 792 > 0.3 THEN 'sidebar' ELSE 'decorative' END AS box_role,
 CASE WHEN f.vec_id IS NOT NULL THEN 'figure' WHEN page = 0 AND ((y0 / 792 < 0.15 AND (x1 - x0) / 612 < 0.3 AND (y1 - y0) / 792 < 0.1) OR ((x0 / 612 < 0.1 OR x0 / 612 > 0.8) AND (x1 - x0) / 612 < 0.2)) THEN 'logo'
  WHEN (x1 - x0) / 612 < 0.05 AND (y1 - y0) / 792 < 0.05 THEN 'icon' ELSE 'figure' END AS image_role,
 printf('#%02x%02x%02x', b.vec_id * 3 % 256, b.vec_id * 5 % 256, b.vec_id * 7 % 256) AS color FROM b LEFT JOIN f USING (vec_id)""")
def roles(spark, d):
    df = boxes(spark, d)
    figures = df.filter("class_name = 'figure'").select("page", *[F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")])
    met = df.join(figures, "page").filter(G.overlaps(G.cols(), G.cols("f"))).select("vec_id").distinct().withColumn("met", F.lit(True))
    b, v = G.cols(), F.col("vec_id")
    return df.join(met, "vec_id", "left").select(
        "vec_id", G.line_role(b[1], PAGE_HEIGHT, F.when(G.height(b) < 30, "horizontal").otherwise("vertical")).alias("line_role"), G.box_role(b, PAGE_HEIGHT).alias("box_role"),
        G.image_role(b, F.col("page"), PAGE_WIDTH, PAGE_HEIGHT, F.coalesce("met", F.lit(False))).alias("image_role"), G.hex_color(v * 3 % 256, v * 5 % 256, v * 7 % 256).alias("color"),
    )


@query("p01_prose_for_validation", f"WITH {TEX_SQL}" + r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(latex, '%[^\n]*', ' ', 'g'), '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$]*\$', ' ', 'g'),
 '\\[a-zA-Z]+\*?', ' ', 'g'), '[{}\[\]]', ' ', 'g'), '\s+', ' ', 'g'))) AS prose_sha FROM l""")
def prose(spark, d):
    return tex_documents(spark, d).select("doc_id", F.sha2(X.prose_for_validation(F.col("latex")), 256).alias("prose_sha"))


@query("p03_p04_prose", f"WITH {TEX_SQL}" + r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(latex, '<<[A-Z_]+_\d+>>', '', 'g'), '\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})*', '', 'g'), '[{}\\$%&]', '', 'g'), '^\s+|\s+$', '', 'g')) AS chunk_sha,
 sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(latex, '\$[^$]*\$', '', 'g'), '\\[a-zA-Z*]+(?:\[[^\]]*\])?(?:\{[^{}]*\})?', '', 'g'), '[{}]', ' ', 'g'), '\s+', ' ', 'g'))) AS cell_sha FROM l""")
def prose_cells(spark, d):
    return tex_documents(spark, d).select("doc_id", F.sha2(X.prose_for_chunks(F.col("latex")), 256).alias("chunk_sha"), F.sha2(X.cell_prose(F.col("latex")), 256).alias("cell_sha"))


@query("p06_m01_a01_comments_by_language", f"WITH {TEX_SQL}" + r""",
c AS (SELECT lang, len(regexp_extract_all(latex, '(?m)(?:^|[^\\])(%.*)$')) AS n FROM l)
SELECT lang, count(*) AS documents, sum(n)::BIGINT AS comments, count(*) FILTER (n > 0) AS commented FROM c GROUP BY lang""")
def comments(spark, d):
    rows = tex_documents(spark, d).select("lang", X.comment_count(F.col("latex")).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("comments"), F.count_if(F.col("n") > 0).alias("commented"))


@query("p15_p16_a21_english_heavy", r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, t, len(list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND list_contains(""" + STOP_SQL + r""", x))) AS hits,
  len(regexp_extract_all(t, '[A-Za-z]'))::DOUBLE / greatest(len(regexp_extract_all(t, '\S')), 1) AS share FROM s)
SELECT doc_id, hits, length(t) >= 140 AND share >= 0.25 AND hits >= 6 AS for_repair, length(t) >= 80 AND share >= 0.25 AND hits >= 4 AS for_chunks FROM w""")
def english_heavy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.squeezed(F.col("text")).alias("t"))
    counted = rows.select("doc_id", F.length("t").alias("n"), T.english_words(F.col("t")).alias("hits"), T.ascii_share(F.col("t")).alias("share"))
    heavy = lambda least, hits: (F.col("n") >= least) & (F.col("share") >= 0.25) & (F.col("hits") >= hits)
    return counted.select("doc_id", "hits", heavy(140, 6).alias("for_repair"), heavy(80, 4).alias("for_chunks"))


@query("p18_p19_p20_x22_scripts", r"""
SELECT doc_id, regexp_matches(text, '[а-яА-ЯёЁ]') AS cyrillic, regexp_matches(text, '[^\x00-\x7F\P{L}]') AS foreign_letters, regexp_matches(text, '[\x{3040}-\x{30FF}]') AS kana,
 regexp_matches(text, '[\x{4E00}-\x{9FFF}]') AS han FROM documents""")
def scripts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.has_cyrillic(t).alias("cyrillic"), T.has_foreign_letters(t).alias("foreign_letters"), T.has_script(t, "kana").alias("kana"), T.has_script(t, "han").alias("han"))


@query("p21_p22_braces", r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(replace(replace(text, ',', '{'), '.', '}'), '[^{}%\n\\]', '', 'g') AS m, replace(replace(text, ',', '{'), '.', '}') AS s FROM documents),
c AS (SELECT doc_id, unnest(string_split(regexp_replace(s, '[^{}]', '', 'g'), '')) AS ch, generate_subscripts(string_split(regexp_replace(s, '[^{}]', '', 'g'), ''), 1) AS i FROM t),
r AS (SELECT doc_id, i, sum(CASE WHEN ch = '{' THEN 1 WHEN ch = '}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c),
a AS (SELECT doc_id, min(depth) AS least, arg_max(depth, i) AS final FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(least, 0) >= 0 AND coalesce(final, 0) = 0 AS balanced,
 (len(regexp_extract_all(split_part(regexp_replace(s, '\n(.|\n)*', ''), '%', 1), '\{')) - len(regexp_extract_all(split_part(regexp_replace(s, '\n(.|\n)*', ''), '%', 1), '\}')))::BIGINT AS first_line_delta FROM t LEFT JOIN a USING (doc_id)""")
def braces(spark, d):
    s = F.replace(F.replace("text", F.lit(","), F.lit("{")), F.lit("."), F.lit("}"))
    first = F.split(s, "\n")[0]
    return table(spark, d, "documents").select("doc_id", X.braces_balanced(s).alias("balanced"), X.brace_delta(first).cast("long").alias("first_line_delta"))


@query("p23_p24_headings_authors", r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 + doc_id AS k FROM documents),
t AS (SELECT doc_id, CASE k % 6 WHEN 0 THEN concat('3.', (doc_id % 9)::VARCHAR, ' ', line) WHEN 1 THEN upper(line) WHEN 2 THEN 'Related Work' WHEN 3 THEN concat(line, '@mail.com') WHEN 4 THEN concat('2', chr(10), line) ELSE line END AS s FROM w),
u AS (SELECT doc_id, s, regexp_replace(s, '^\s+|\s+$', '', 'g') AS x FROM t),
y AS (SELECT doc_id, (regexp_matches(x, '^\d+(\.\d+)*\.?$') AND length(x) < 10) OR regexp_matches(x, '^\d+(\.\d+)*\.?\s+[\p{L}\p{N}_]')
  OR (len(string_split(x, chr(10))) = 2 AND regexp_matches(trim(string_split(x, chr(10))[1]), '^\d+(\.\d+)*$') AND length(trim(string_split(x, chr(10))[2])) < 50)
  OR (regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}') AND len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) <= 5) OR lower(x) = 'related work' AS heading,
 length(x) <= 150 AND ((contains(s, '@') AND contains(lower(s), '.com')) OR contains(lower(s), '.edu') OR contains(lower(s), '.org')
  OR (len(string_split(x, chr(10))) BETWEEN 2 AND 4 AND len(list_filter(string_split(x, chr(10)), lambda y: length(y) >= 50)) = 0 AND contains(x, '@'))) AS authors FROM u)
SELECT doc_id, count(*) AS lines, count(*) FILTER (heading) AS headings, count(*) FILTER (authors) AS authors FROM y GROUP BY doc_id""")
def headings(spark, d):
    """Every line of every document, made a heading or an author line in five ways of six."""
    m, t = (F.col("i") + F.col("doc_id")) % 6, F.col("line")
    s = (
        F.when(m == 0, F.concat(F.lit("3."), (F.col("doc_id") % 9).cast("string"), F.lit(" "), t)).when(m == 1, F.upper(t)).when(m == 2, "Related Work")
        .when(m == 3, F.concat(t, F.lit("@mail.com"))).when(m == 4, F.concat(F.lit("2\n"), t)).otherwise(t)
    )
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", T.like_heading(s).alias("heading"), T.like_authors(s).alias("authors"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("heading").alias("headings"), F.count_if("authors").alias("authors"))


@query("p17_untranslated_heading", r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 + doc_id AS k FROM documents),
t AS (SELECT doc_id, CASE k % 4 WHEN 0 THEN '2. Related  Work' WHEN 1 THEN concat(line, ' Итоги') ELSE line END AS s FROM w),
u AS (SELECT doc_id, trim(regexp_replace(lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), '^[^\p{L}]+', '')) AS x FROM t)
SELECT doc_id, count(*) FILTER (x <> '' AND (x = 'related work' OR (len(regexp_extract_all(x, '[A-Za-z]')) >= 4 AND NOT regexp_matches(x, '[а-яА-ЯёЁ]')))) AS untranslated FROM u GROUP BY doc_id""")
def untranslated(spark, d):
    m = (F.col("i") + F.col("doc_id")) % 4
    s = F.when(m == 0, "2. Related  Work").when(m == 1, F.concat("line", F.lit(" Итоги"))).otherwise(F.col("line"))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.groupBy("doc_id").agg(F.count_if(X.untranslated_heading(s)).alias("untranslated"))


@query("p27_p28_p29_x74_tables", r"""
WITH t AS (SELECT doc_id, concat('a & b % note', chr(10), '\\ \hline ', replace(replace(text, '%', ''), chr(10), ' & '), ' \\ 12.5 & 7\%') AS body, repeat('l|', 1 + doc_id % 9) AS spec FROM documents),
r AS (SELECT doc_id, spec, list_filter(list_transform(string_split(regexp_replace(body, '% note', ''), '\\'), lambda x: regexp_replace(replace(x, '\hline', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS rows FROM t)
SELECT doc_id, len(rows) AS n_rows, list_sum(list_transform(rows, lambda x: len(string_split(x, '&'))))::BIGINT AS n_cells, length(regexp_replace(spec, '[^lcr]', '', 'g')) >= 6 AS wide,
 regexp_matches(trim(string_split(rows[len(rows)], '&')[1]), '^[\d\s.,+\-()%/]+$') AS numeric_cell, regexp_matches(rows[2], '\p{L}') AS letters FROM r""")
def tables(spark, d):
    body = F.concat(F.lit("a & b % note\n\\\\ \\hline "), F.replace(F.replace("text", F.lit("%"), F.lit("")), F.lit("\n"), F.lit(" & ")), F.lit(" \\\\ 12.5 & 7\\%"))
    spec = F.repeat(F.lit("l|"), (F.col("doc_id") % 9 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", X.table_rows(body).alias("rows"), spec.alias("spec"))
    last = F.element_at("rows", -1)
    return rows.select(
        "doc_id", F.size("rows").alias("n_rows"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + F.size(r)).alias("n_cells"), X.wide_table(F.col("spec")).alias("wide"),
        T.looks_numeric(F.element_at(last, 1)).alias("numeric_cell"), F.array_join(F.element_at("rows", 2), "&").rlike(r"\p{L}").alias("letters"),
    )


@query("x76_x77_packages", r"""
WITH t AS (SELECT p_partkey, concat('\usepackage[x]{tikz, amsmath}', chr(10), '\usepackage{', split_part(p_name, ' ', 1), '}') AS tex FROM part)
SELECT p_partkey, array_to_string(list_transform(flatten(list_transform(regexp_extract_all(tex, '\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}', 1), lambda x: string_split(x, ','))), lambda x: trim(x)), '|') AS packages, 'tikz' AS special FROM t""")
def packages(spark, d):
    tex = F.concat(F.lit("\\usepackage[x]{tikz, amsmath}\n\\usepackage{"), F.split("p_name", " ")[0], F.lit("}"))
    found = X.packages(tex)
    special = F.array_intersect(found, F.array(*map(F.lit, ("tikz", "pgfplots", "forest"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("packages"), F.array_join(special, "|").alias("special"))


@query("t09_p05_cut_at_sentence", r"""
WITH t AS (SELECT doc_id, text, left(text, 500) AS h FROM documents),
p AS (SELECT *, greatest(CASE WHEN instr(reverse(h), '.') > 0 THEN length(h) - instr(reverse(h), '.') + 1 ELSE 0 END, CASE WHEN instr(reverse(h), '!') > 0 THEN length(h) - instr(reverse(h), '!') + 1 ELSE 0 END,
  CASE WHEN instr(reverse(h), '?') > 0 THEN length(h) - instr(reverse(h), '?') + 1 ELSE 0 END) AS last FROM t)
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN last > 350 THEN left(h, last) ELSE concat(h, '...') END AS abstract FROM p""")
def cut_at_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cut_at_sentence(F.col("text")).alias("abstract"))


@query("u04_u05_w10_anchor_jaccard", r"""
WITH t AS (SELECT doc_id, concat('\ref{a} ', text, ' 12.5 7') AS a, concat('\ref{a} ', (doc_id % 20)::VARCHAR, ' 7 ', replace(text, '5', '6')) AS b FROM documents),
s AS (SELECT doc_id, list_distinct(list_concat(list_concat(regexp_extract_all(a, '\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?'), regexp_extract_all(a, '\$[^$]*\$')), regexp_extract_all(a, '\b\d+(?:\.\d+)?\b'))) AS x,
  list_distinct(list_concat(list_concat(regexp_extract_all(b, '\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?'), regexp_extract_all(b, '\$[^$]*\$')), regexp_extract_all(b, '\b\d+(?:\.\d+)?\b'))) AS y FROM t)
SELECT doc_id, len(x) AS n_anchors, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS likeness FROM s""")
def anchor_jaccard(spark, d):
    a = F.concat(F.lit("\\ref{a} "), "text", F.lit(" 12.5 7"))
    b = F.concat(F.lit("\\ref{a} "), (F.col("doc_id") % 20).cast("string"), F.lit(" 7 "), F.replace("text", F.lit("5"), F.lit("6")))
    return table(spark, d, "documents").select("doc_id", F.size(X.anchors(a)).alias("n_anchors"), X.jaccard(X.anchors(a), X.anchors(b)).alias("likeness"))
