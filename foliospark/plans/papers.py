"""Exchanges with a model, reading flow, repairs, compile decisions, sinks and schedules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import tex as X
from foliospark.operators import compile as compiling
from foliospark.operators import exchange, flow, repair, rewrite, schedule, structure
from foliospark.plans.cases import rule_query
from foliospark.plans.catalog import BOXES_SQL, PAGE_HEIGHT, PAGE_WIDTH, boxes, query, table, varied, varied_sql
from foliospark.plans.scalars import STOP_SQL
from foliospark.sources import files, sinks

LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).withColumn("i", (F.col("i") + 1).cast("long"))


def _numbered(reply):
    """A model that answers block n of a prompt by reply(n, text); None leaves the block out."""
    import re

    def model(prompt):
        out = []
        for n, text in re.findall(r"(?s)@@@(\d+)@@@\n(.*?)\n@@@END\1@@@", prompt):
            said = reply(int(n), text)
            if said is not None:
                out.append(f"@@@{n}@@@{said}@@@END{n}@@@")
        return "\n".join(out)

    return model


@query("j21_l05_numbered_blocks", f"""WITH {LINES_SQL}, a AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 OR trim(line, ' ' || chr(9) || chr(13)) = '' THEN line ELSE concat('<', line, '>') END AS answer FROM l)
SELECT doc_id, count(*) AS lines, sha256(string_agg(answer, chr(10) ORDER BY i)) AS text_sha FROM a GROUP BY doc_id""")
def numbered_blocks(spark, d):
    """Each document's lines as one prompt; every third is not answered, blank ones are answered blankly."""
    model = _numbered(lambda n, text: None if n % 3 == 0 else f"<{text}>" if text.strip() else " ")
    out = exchange.translated_blocks(_lines(spark, d), "doc_id", model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sort_array(F.collect_list(F.struct("i", "answer"))).alias("p"))
    return out.select("doc_id", "lines", F.sha2(F.array_join(F.transform("p", lambda x: x["answer"]), "\n"), 256).alias("text_sha"))


@query("j22_j23_l06_l07_positions", f"""WITH {LINES_SQL}, a AS (SELECT doc_id, i, CASE WHEN doc_id % 2 = 0 AND count(*) OVER (PARTITION BY doc_id) = count(*) FILTER (regexp_matches(line, '\\S')) OVER (PARTITION BY doc_id) THEN concat('x', i::VARCHAR) WHEN doc_id % 2 = 1 AND i = 1 THEN 'second' ELSE line END AS answer FROM l)
SELECT doc_id, sha256(string_agg(answer, chr(10) ORDER BY i)) AS text_sha FROM a GROUP BY doc_id""")
def positions(spark, d):
    """Replies without marks answer by position if they have as many lines as were asked; of two answers to one number the last wins."""
    items = _lines(spark, d)
    plain = F.array_join(F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S")), lambda x, i: F.concat(F.lit("x"), (i + 1).cast("string"))), "\n")
    reply = F.when(F.col("doc_id") % 2 == 0, plain).otherwise(F.lit("@@@0001@@@ first\n  @@@0001@@@ second\nnoise"))
    replies = table(spark, d, "documents").select("doc_id", reply.alias("reply"))
    out = exchange.answers(items, replies, "doc_id", exchange.LINE_NUMBERED, positional=True).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "answer"))).alias("p"))
    return out.select("doc_id", F.sha2(F.array_join(F.transform("p", lambda x: x["answer"]), "\n"), 256).alias("text_sha"))


@query("l03_retries", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 3 ELSE (doc_id % 4 + 1)::INT END AS attempts, sha256(CASE WHEN doc_id % 4 = 3 THEN 'again' ELSE concat((doc_id % 4)::VARCHAR, ':', text) END) AS answer_sha FROM documents")
def retries(spark, d):
    """The gate refuses "again"; the model gives in after doc_id % 4 refusals, and for 3 not within the two that there are."""
    rows = table(spark, d, "documents").select("doc_id", F.concat((F.col("doc_id") % 4).cast("string"), F.lit(":"), "text").alias("text"))
    out = exchange.with_retries(rows, "text", lambda q, attempt: q if attempt >= int(q[0]) else "again", lambda t, a: a == "again")
    return out.select("doc_id", "attempts", F.sha2("answer", 256).alias("answer_sha"))


@query("l04_p55_repaired", f"WITH {LINES_SQL}" + r""",
s AS (SELECT doc_id, i, line, len(list_filter(string_split_regex(lower(line), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND list_contains(""" + STOP_SQL + r""", x))) AS score FROM l),
k AS (SELECT *, score >= 6 AND row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 6 AS asked FROM s)
SELECT doc_id, sha256(string_agg(CASE WHEN asked AND i % 2 = 0 THEN concat('{', replace(replace(line, '{', ''), '}', ''), '}') ELSE line END, chr(10) ORDER BY i)) AS text_sha FROM k GROUP BY doc_id""")
def repaired_lines(spark, d):
    """Answers to even lines are balanced and taken, those to odd ones are not."""
    model = _numbered(lambda n, text: "{" + text.replace("{", "").replace("}", "") + ("}" if n % 2 == 0 else ""))
    return exchange.repaired(table(spark, d, "documents"), "doc_id", "text", model).select("doc_id", F.sha2("text", 256).alias("text_sha"))


@query("p55_english_spans", r"""WITH m AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(concat('\x{', text, '}'), '[A-Za-z][^\\{}$\n]{60,}'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))))) AS s FROM documents),
n AS (SELECT doc_id, s, len(list_filter(string_split_regex(lower(s), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND list_contains(""" + STOP_SQL + r""", x))) AS hits FROM m)
SELECT d.doc_id, count(s) FILTER (hits >= 16) AS spans, count(s) FILTER (hits >= 10) AS spans_cjk, coalesce(sum(length(s)) FILTER (hits >= 16), 0)::BIGINT AS chars FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def english_spans(spark, d):
    block = F.concat(F.lit("\\x{"), "text", F.lit("}"))
    rows = table(spark, d, "documents").select("doc_id", exchange.english_spans(block).alias("s"), exchange.english_spans(block, cjk=True).alias("c"))
    return rows.select("doc_id", F.size("s").cast("long").alias("spans"), F.size("c").cast("long").alias("spans_cjk"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


TABLE_FORMS = [("\\begin{table}b0\\end{table} ¤ \\begin{table*}b1\\end{table*}", "\\begin{table}A№\\end{table} ¤ \\begin{table*}b1\\end{table*}"), ("¤", "¤"), ("x\\begin{table}¤\\end{table}", "x\\begin{table}A№\\end{table}")]


@query("j24_c10_tables_put_back", f"SELECT doc_id, sha256({varied_sql([b for _, b in TABLE_FORMS])}) AS tex_sha FROM documents")
def tables_put_back(spark, d):
    original = F.concat(F.lit("\\begin{table}A"), F.col("doc_id").cast("string"), F.lit("\\end{table}"))
    return table(spark, d, "documents").select("doc_id", F.sha2(exchange.environments_put_back(varied([a for a, _ in TABLE_FORMS]), original), 256).alias("tex_sha"))


@query("l08_l10_l11_v01_summaries", """SELECT doc_id, sha256(CASE WHEN length(text) < 50 THEN text WHEN doc_id % 3 = 0 THEN left(text, 400) ELSE concat('S', length(text)::VARCHAR) END) AS summary_sha, sha256(CASE WHEN doc_id % 5 IN (0, 1) THEN concat('U:', text) ELSE text END) AS block_sha FROM documents""")
def summaries(spark, d):
    """A model that fails on a third of the abstracts; of the blocks only titles and paragraphs are translated."""
    docs = table(spark, d, "documents").withColumn("q", F.concat((F.col("doc_id") % 3).cast("string"), "text"))
    said = exchange.asked(docs, "q", "reply", lambda q: None if q[0] == "0" else f"S{len(q) - 1}")
    m = F.col("doc_id") % 5
    kind = F.when(m == 0, "document_title").when(m == 1, "paragraph").when(m == 2, "equation").when(m == 3, "table").otherwise("page_number")
    blocks = exchange.asked(said.withColumn("kind", kind), "text", "up", lambda t: f"U:{t}", structure.translation_rule(F.col("kind")) == "yes")
    return blocks.select("doc_id", F.sha2(exchange.summary(F.col("text"), F.col("reply")), 256).alias("summary_sha"), F.sha2(F.coalesce("up", "text"), 256).alias("block_sha"))


@query("x23_x33_x34_x35_headings", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN n_chars % 20 >= 14 THEN 1 WHEN n_chars % 20 >= 12 THEN 2 ELSE 3 END ELSE 2 END AS level,
 CASE WHEN doc_id % 7 = 0 THEN 'center' WHEN abs(n_chars % 600 + 20 - 306) < 50 THEN 'center' WHEN n_chars % 600 < 612 * 0.3 THEN 'left' ELSE 'right' END AS aligned,
 printf('#%02x%02x%02x', n_chars % 256, doc_id % 256, (n_chars // 256) % 256) AS color FROM documents""")
def headings(spark, d):
    m, n = F.col("doc_id") % 4, F.col("n_chars")
    text = F.when(m == 0, F.concat(F.lit("1 "), "text")).when(m == 1, F.concat(F.lit("2.3.4 "), "text")).when(m == 2, F.concat(F.lit("A "), "text")).otherwise(F.concat(F.lit("5.1. "), "text"))
    x0 = F.when(F.col("doc_id") % 7 != 0, (n % 600).cast("double"))
    return table(spark, d, "documents").select(
        "doc_id", flow.heading_level(text, n % 20).alias("level"), flow.alignment(x0, F.lit(40.0), PAGE_WIDTH).alias("aligned"), G.hex_color(n % 256, F.col("doc_id") % 256, F.floor(n / 256) % 256).alias("color")
    )


@query("w08_w09_sections_over_pages", f"WITH {BOXES_SQL}" + r""", t AS (SELECT page // 5 AS doc, page, y0, vec_id, class_name IN ('title', 'abstract') AS h, concat('T', (vec_id % 9)::VARCHAR) AS text FROM b),
n AS (SELECT *, h AND row_number() OVER (PARTITION BY doc, CASE WHEN h THEN text END ORDER BY page, y0, vec_id) = 1 AS new FROM t)
SELECT vec_id, last_value(CASE WHEN new THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, y0, vec_id ROWS UNBOUNDED PRECEDING) AS section FROM n""")
def sections_over_pages(spark, d):
    rows = boxes(spark, d).select(F.floor(F.col("page") / 5).alias("doc"), "page", "y0", "vec_id", F.col("class_name").isin("title", "abstract").alias("is_heading"), F.concat(F.lit("T"), (F.col("vec_id") % 9).cast("string")).alias("text"))
    return flow.with_sections(rows, "doc", ["page", "y0", "vec_id"]).select("vec_id", "section")


@query("w08_merged_headings", f"WITH {BOXES_SQL}" + r""", t AS (SELECT page, y0, vec_id, class_name IN ('title', 'abstract', 'figure') AS h, CASE WHEN vec_id % 2 = 0 THEN '2.1' ELSE 'Words' END AS text FROM b),
n AS (SELECT *, h AND text = '2.1' AND lead(text) OVER w IS NOT NULL AND lead(y0) OVER w - y0 < 25 AS bare, lead(text) OVER w AS next FROM t WINDOW w AS (PARTITION BY page ORDER BY y0, vec_id)),
m AS (SELECT *, coalesce(lag(bare) OVER (PARTITION BY page ORDER BY y0, vec_id), false) AS after_bare FROM n),
r AS (SELECT *, sum((NOT after_bare)::INT) OVER (PARTITION BY page ORDER BY y0, vec_id) AS run FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY page, run ORDER BY y0, vec_id) AS k FROM r)
SELECT page, vec_id, CASE WHEN bare THEN concat_ws(' ', text, next) ELSE text END AS text FROM k WHERE k % 2 = 1""")
def merged_headings(spark, d):
    rows = boxes(spark, d).select("page", "y0", "vec_id", F.col("class_name").isin("title", "abstract", "figure").alias("is_heading"), F.when(F.col("vec_id") % 2 == 0, "2.1").otherwise("Words").alias("text"))
    return flow.merged_headings(rows, "page", ["y0", "vec_id"]).select("page", "vec_id", "text")


@query("j28_numbered_equations", f"WITH RECURSIVE {BOXES_SQL}" + r""", t AS (SELECT page, vec_id AS key, y0, class_name IN ('isolate_formula', 'figure', 'table') AS eq, CASE vec_id % 3 WHEN 0 THEN '(' || (vec_id % 9)::VARCHAR || 'a)' WHEN 1 THEN ' [7] ' ELSE '(x)' END AS text FROM b),
i AS (SELECT page, list({'key': key, 'eq': eq, 'y0': y0, 't': trim(text)} ORDER BY y0, key) AS rest FROM t GROUP BY page),
r AS (SELECT page, rest, []::STRUCT(key BIGINT, number VARCHAR)[] AS out FROM i UNION ALL
  SELECT page, CASE WHEN f IS NOT NULL THEN list_filter(rest[2:], lambda x: x.key <> f.key) ELSE rest[2:] END, CASE WHEN rest[1].eq THEN list_append(out, {'key': rest[1].key, 'number': f.t}) ELSE out END
  FROM (SELECT *, CASE WHEN rest[1].eq THEN list_filter(rest[2:4], lambda x: regexp_matches(x.t, '^[(\[]\d+[a-z]?[)\]]$') AND abs(x.y0 - rest[1].y0) < 60)[1] END AS f FROM r WHERE len(rest) > 0)),
o AS (SELECT page, unnest(out) AS e FROM r WHERE len(rest) = 0) SELECT page, e.key AS key, e.number AS number FROM o""")
def numbered_equations(spark, d):
    k = F.col("vec_id") % 3
    text = F.when(k == 0, F.concat(F.lit("("), (F.col("vec_id") % 9).cast("string"), F.lit("a)"))).when(k == 1, " [7] ").otherwise("(x)")
    rows = boxes(spark, d).select("page", F.col("vec_id").alias("key"), "y0", F.col("class_name").isin("isolate_formula", "figure", "table").alias("is_equation"), text.alias("text"))
    return flow.equation_numbers(rows, "page", ["y0"])


MARKED_SQL = "m AS (SELECT doc_id, i, CASE WHEN i = 2 THEN ' References ' WHEN i > 2 AND i % 4 = 3 THEN concat('[', i::VARCHAR, '] ', line) WHEN i % 17 = 0 THEN 'Appendix A' WHEN i % 23 = 0 THEN 'BIBLIOGRAPHY' ELSE line END AS line FROM l)"


def _marked(spark, d):
    i = F.col("i")
    line = F.when(i == 2, " References ").when((i > 2) & (i % 4 == 3), F.concat(F.lit("["), i.cast("string"), F.lit("] "), "text")).when(i % 17 == 0, "Appendix A").when(i % 23 == 0, "BIBLIOGRAPHY").otherwise(F.col("text"))
    return _lines(spark, d).withColumn("text", line)


@query("w15_w17_references", f"WITH {LINES_SQL}, {MARKED_SQL}" + r""",
t AS (SELECT doc_id, i, trim(line) AS t, lower(trim(line)) AS low FROM m WHERE trim(line) <> ''),
k AS (SELECT *, CASE WHEN low IN ('references', 'bibliography') THEN 1 WHEN regexp_matches(low, '^(attention visualizations|appendix|supplementary|figure)') THEN 0 END AS mark FROM t),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS inside, count(mark) OVER w AS part FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, nullif(regexp_extract(t, '^\[(\d+)\]', 1), '') AS n FROM s WHERE inside = 1 AND mark IS NULL),
g AS (SELECT *, count(n) OVER (PARTITION BY doc_id, part ORDER BY i ROWS UNBOUNDED PRECEDING) AS entry FROM e)
SELECT doc_id, concat('[', max(n), ']') AS number, sha256(trim(string_agg(CASE WHEN n IS NULL THEN t ELSE regexp_replace(t, '^\[\d+\]\s*', '') END, ' ' ORDER BY i))) AS text_sha FROM g WHERE entry > 0 GROUP BY doc_id, part, entry
HAVING trim(string_agg(CASE WHEN n IS NULL THEN t ELSE regexp_replace(t, '^\[\d+\]\s*', '') END, ' ' ORDER BY i)) <> ''""")
def references(spark, d):
    return flow.references(_marked(spark, d), "doc_id", ["i"]).select("doc_id", "number", F.sha2("text", 256).alias("text_sha"))


@query("w16_footnotes", f"WITH {LINES_SQL}" + r""",
t AS (SELECT doc_id, i, trim(CASE i % 5 WHEN 1 THEN concat('† ', line) WHEN 4 THEN CASE WHEN i % 2 = 0 THEN concat(line, ' Proceedings') ELSE line END ELSE line END) AS t FROM l WHERE (i * 37) % 792 >= 592),
k AS (SELECT *, nullif(regexp_extract(t, '^([†‡*∗])', 1), '') AS marker FROM t WHERE t <> ''),
s AS (SELECT *, count(marker) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS note FROM k),
o AS (SELECT *, bool_or(marker IS NULL AND regexp_matches(t, 'Conference|Proceedings|NIPS|NeurIPS')) OVER (PARTITION BY doc_id, note ORDER BY i ROWS UNBOUNDED PRECEDING) AS ended FROM s WHERE note > 0)
SELECT doc_id, max(marker) AS marker, sha256(string_agg(t, ' ' ORDER BY i)) AS text_sha FROM o WHERE NOT ended GROUP BY doc_id, note""")
def footnotes(spark, d):
    i = F.col("i")
    text = F.when(i % 5 == 1, F.concat(F.lit("† "), "text")).when((i % 5 == 4) & (i % 2 == 0), F.concat("text", F.lit(" Proceedings"))).otherwise(F.col("text"))
    rows = _lines(spark, d).withColumn("text", text).withColumn("y1", (i * 37 % 792).cast("double"))
    return flow.footnotes(rows, "doc_id", ["i"], PAGE_HEIGHT).select("doc_id", "marker", F.sha2("text", 256).alias("text_sha"))


@query("j15_d14_table_images", f"WITH RECURSIVE {BOXES_SQL}" + r""", f AS (SELECT page, list({'image': vec_id, 'y0': y0} ORDER BY vec_id) AS free FROM b WHERE class_name IN ('figure', 'abandon') GROUP BY page),
t AS (SELECT page, list({'t': vec_id, 'y0': y0} ORDER BY vec_id) AS todo FROM b WHERE class_name IN ('table', 'title', 'plain_text') GROUP BY page),
r AS (SELECT page, todo, free, []::STRUCT(t BIGINT, image BIGINT)[] AS out FROM t JOIN f USING (page) UNION ALL
  SELECT page, todo[2:], list_filter(free, lambda x: best IS NULL OR x.image <> best), CASE WHEN best IS NULL THEN out ELSE list_append(out, {'t': todo[1].t, 'image': best}) END
  FROM (SELECT *, list_min(list_transform(free, lambda x: {'d': abs(x.y0 - todo[1].y0), 'image': x.image})).image AS best FROM r WHERE len(todo) > 0)),
o AS (SELECT page, unnest(out) AS e FROM r WHERE len(todo) = 0) SELECT page, e.t AS "table", e.image AS image FROM o""")
def table_images(spark, d):
    rows = boxes(spark, d)
    tables = rows.filter("class_name IN ('table', 'title', 'plain_text')").select("page", F.col("vec_id").alias("table"), "y0")
    return flow.table_images(tables, rows.filter("class_name IN ('figure', 'abandon')").select("page", F.col("vec_id").alias("image"), "y0"))


@query("u02_j19_image_kinds", f"WITH {BOXES_SQL} SELECT vec_id, 'embedded' AS kind, x1 - x0 AS width, NULL::VARCHAR AS role FROM b WHERE class_name = 'figure' UNION ALL SELECT vec_id, 'rendered', NULL, NULL FROM b WHERE class_name IN ('table', 'isolate_formula') UNION ALL SELECT vec_id, 'line', NULL, 'separator' FROM b WHERE class_name = 'abandon' UNION ALL SELECT vec_id, 'page', NULL, NULL FROM b WHERE page = 3")
def image_kinds(spark, d):
    rows = boxes(spark, d)
    return flow.image_kinds(
        embedded=rows.filter("class_name = 'figure'").select("vec_id", (F.col("x1") - F.col("x0")).alias("width")), rendered=rows.filter("class_name IN ('table', 'isolate_formula')").select("vec_id"),
        line=rows.filter("class_name = 'abandon'").select("vec_id", F.lit("separator").alias("role")), page=flow.only_page(rows, 3).select("vec_id"),
    ).select("vec_id", "kind", "width", "role")


@query("d12_element_texts", f"WITH {BOXES_SQL}, s AS (SELECT b.page, b.vec_id AS ord, x0 + 1 AS sx, y0 + 1 AS sy, d.text FROM b JOIN documents d ON d.doc_id = b.vec_id)" + r"""
SELECT b.page, b.vec_id AS element, sha256(regexp_replace(string_agg(s.text, ' ' ORDER BY s.ord), '^\s+|\s+$', '', 'g')) AS text_sha FROM b JOIN s ON s.page = b.page AND s.sx BETWEEN b.x0 AND b.x1 AND s.sy BETWEEN b.y0 AND b.y1 GROUP BY b.page, b.vec_id""")
def element_texts(spark, d):
    rows = boxes(spark, d)
    spans = rows.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("page", F.col("vec_id").alias("ord"), (F.col("x0") + 1).alias("sx"), (F.col("y0") + 1).alias("sy"), "text")
    return flow.element_texts(rows.withColumnRenamed("vec_id", "element"), spans).select("page", "element", F.sha2("text", 256).alias("text_sha"))


@query("d09_footnote_texts", r"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(regexp_extract(text, '^([^}]*)', 1)) WHEN 1 THEN sha256('a{b') END AS note_sha FROM documents")
def footnote_texts(spark, d):
    command = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\\footnote{"), "text", F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\\thanks{a{b}"), F.lit("}"))).otherwise(F.translate("text", "\\{}", ""))
    return table(spark, d, "documents").select("doc_id", F.sha2(flow.footnote_text(command), 256).alias("note_sha"))


CLASS = "\\documentclass{article}\n"
BEGIN = "\\begin{document}"
for _name, _rule, _cases in [
    ("r34_latin_in_title", rewrite.latin_in_title, [
        (f"\\title{{שלום Word $x$ \\textbf{{two}}}}\\author{{A.B \\texttt{{a@b}} \\url{{u}}}}Text{BEGIN}¤", f"\\title{{שלום \\LR{{Word}} $x$ \\textbf{{\\LR{{two}}}}}}\\author{{\\LR{{A.B}} \\texttt{{a@b}} \\url{{u}}}}Text{BEGIN}¤"),
        (f"\\title{{Word}}{BEGIN}¤", f"\\title{{Word}}{BEGIN}¤"), ("\\title{שלום Word} ¤", "\\title{שלום Word} ¤")]),
    ("r24_joined_dollars", rewrite.joined_dollars, [("a $ $ № ¤", "a $$ № ¤"), ("$a$ $b$", "$a$$b$")]),
    ("r39_tabularx_support", rewrite.tabularx_support, [(f"№{BEGIN}¤", f"№\\usepackage{{tabularx}}\n\\newcolumntype{{Y}}{{>{{\\raggedright\\arraybackslash}}X}}\n{BEGIN}¤"), ("¤", "¤")]),
    ("r40_adjustbox_support", rewrite.adjustbox_support, [(f"№{BEGIN}¤", f"№\\usepackage{{adjustbox}}\n{BEGIN}¤"), (f"\\usepackage{{adjustbox}}{BEGIN}¤", f"\\usepackage{{adjustbox}}{BEGIN}¤")]),
    ("r08_thanks_layout", rewrite.thanks_layout, [
        (f"{BEGIN}\\maketitle\n¤", f"{BEGIN}\n\\makeatletter\n\\let\\folio@thanks\\@thanks\n\\def\\@thanks{{\\par\\begingroup\\scriptsize\\folio@thanks\\par\\endgroup}}\n\\makeatother\n\\maketitle\n\\enlargethispage*{{10\\baselineskip}}\n¤"),
        ("\\maketitle\n\\enlargethispage{2pt}¤", "\\maketitle\n\\enlargethispage{2pt}¤"), (f"{BEGIN}¤", f"{BEGIN}¤"),
        ("\\thanks{" + "a" * 720 + "}\\maketitle¤", "\\thanks{" + "a" * 720 + "}\\maketitle\n\\enlargethispage*{14\\baselineskip}¤")]),
    ("c03_unicode_preamble", compiling.unicode_preamble, [
        (f"{CLASS}\\usepackage[utf8]{{inputenc}}\né ¤", f"{CLASS}\\usepackage{{fontspec}}\n\\defaultfontfeatures{{Ligatures=TeX}}\n{compiling._first_font(compiling.LATIN_FONTS, chr(92) + 'setmainfont')}\n\\emergencystretch=2em\n\\sloppy\n% \\usepackage[utf8]{{inputenc}}\né ¤"),
        ("\\usepackage{fontspec}é ¤", "\\usepackage{fontspec}é ¤"), ("é ¤", "é ¤"),
        (f"{CLASS}かな ¤", f"{CLASS}\\usepackage{{fontspec}}\n\\defaultfontfeatures{{Ligatures=TeX}}\n{compiling._first_font(compiling.LATIN_FONTS, chr(92) + 'setmainfont')}\n\\usepackage{{xeCJK}}\n\\AtBeginDocument{{\\XeTeXlinebreaklocale \"ja\"\\XeTeXlinebreakskip=0pt plus 1pt}}\n{compiling._first_font(compiling.CJK_FONTS['ja'], chr(92) + 'setCJKmainfont')}\n\\emergencystretch=2em\n\\sloppy\nかな ¤")]),
]:
    rule_query(_name, _rule, _cases)


#: Errors, a text that has what they speak of, and the text after the rules that they call for.
REPAIR_FORMS = [
    ("! LaTeX Error: Command \\Prob already defined.", "\\newcommand{\\Prob}[1]{P}\n\\newcommand{\\Q}{q}\n¤", "\\renewcommand{\\Prob}[1]{P}\n\\newcommand{\\Q}{q}\n¤", "1"),
    ("! Package inputenc Error: Keyboard character used is undefined", "\\usepackage[latin1]{inputenc}\n¤", "\\usepackage[utf8]{inputenc}\n¤", "3"),
    ("! LaTeX Error: Command \\DH unavailable in encoding T1.", f"№{BEGIN}¤", f"№{repair.EMPTY_ETH}{BEGIN}¤", "4,5"),
    ("! Package tikz Error: A node must have a (possibly empty) label text.", "\\node (a) \\1;\n% \\1;\n¤", "\\node (a) {};\n% \\1;\n¤", "9"),
    ("! Undefined control sequence.", f"\\1\n\\includegraphics{{f}}\n{BEGIN}¤", f"\\relax\n\\includegraphics{{f}}\n\\usepackage{{graphicx}}\n{BEGIN}¤", "10,19"),
    ("! Extra }, or forgotten $.", "$_{train}}$ ¤", "$_{train}$ ¤", "11"),
    ("Runaway argument?", "\\section{A {b}\n¤", "\\section{A {b}}\n¤", "12,37"),
    ("! LaTeX Error: Environment equation* undefined.", f"{BEGIN}¤", f"\\usepackage{{amsmath}}\n{BEGIN}¤", "18"),
    ("! LaTeX Error: Unicode character Д (U+0414)", f"{CLASS}№ ¤", f"\\PassOptionsToPackage{{russian}}{{babel}}\n{CLASS}\\usepackage[utf8]{{inputenc}}\n\\usepackage[russian]{{babel}}\n№ ¤", "21"),
    ("! LaTeX Error: File `c.cls' not found.", f"the \\documentclass command\n{CLASS}¤", f"% the \\documentclass command\n{CLASS}¤", "22,30"),
    ("! LaTeX Error: \\usepackage before \\documentclass.", f"\\usepackage{{a}}\n% note\n\\RequirePackage{{b}}\n{CLASS}¤", f"% note\n{CLASS}\\usepackage{{a}}\n\\RequirePackage{{b}}\n¤", "23"),
    ("! Package hyperxmp Error: hyperref must be loaded before hyperxmp.", "\\usepackage{hyperxmp}\n¤", "% \\usepackage{hyperxmp}\n¤", "24"),
    ("! LaTeX Error: Command \\dh unavailable in encoding OT1.", f"{CLASS}№ ¤", f"{CLASS}{repair.PLAIN_ETH}№ ¤", "25"),
    ("! Package graphics Error: Division by 0.", "№ ¤", "№ ¤", "43,45,51"),
    ("all is well", "№ ¤", "№ ¤", ""),
]


@query("c08_v06_repaired", f"SELECT doc_id, {varied_sql([n for *_, n in REPAIR_FORMS])} AS rules, sha256({varied_sql([t for _, _, t, _ in REPAIR_FORMS])}) AS tex_sha, sha256({varied_sql([t for _, _, t, _ in REPAIR_FORMS])}) AS again_sha FROM documents")
def repaired(spark, d):
    rows = table(spark, d, "documents").withColumn("errors", F.array(varied([e for e, *_ in REPAIR_FORMS]))).withColumn("tex", varied([t for _, t, _, _ in REPAIR_FORMS]))
    once = repair.repaired(rows, "tex", "errors")
    again = repair.repaired(once.withColumnsRenamed({"rules": "first_rules"}).withColumn("again", F.col("tex")), "again", "errors")
    return again.select("doc_id", F.array_join("first_rules", ",").alias("rules"), F.sha2("tex", 256).alias("tex_sha"), F.sha2("again", 256).alias("again_sha"))


@query("c04_c05_c06_c09_p30_p31_p34_engines", r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN contains(text, '\setmainfont') ELSE true END AS xetex, CASE doc_id % 4 WHEN 0 THEN 'lualatex' ELSE 'pdflatex' END AS engine,
 CASE doc_id % 4 WHEN 0 THEN NULL ELSE 'xelatex' END AS next_engine, CASE doc_id % 5 WHEN 0 THEN 'biber' WHEN 1 THEN 'biber' WHEN 2 THEN 'bibtex' WHEN 3 THEN 'bibtex' END AS tool, doc_id % 2 = 0 AS temporary FROM documents""")
def engines(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, "a_Unicode.tex").otherwise("a.tex")
    tex = F.when(k % 3 == 2, F.concat("text", F.lit("\\usepackage{xeCJK}"))).otherwise(F.col("text"))
    forced = F.when(k % 4 == 0, " LuaLaTeX ").when(k % 4 == 1, "")
    aux = F.when((k % 5).isin(2, 3), F.when(k % 5 == 2, "\\bibdata{x}").otherwise("\\bibstyle{y}")).otherwise("")
    log = F.when(k % 5 == 1, "Package biblatex Warning: Please (re)run Biber").when(k % 5 == 2, "biber").otherwise("")
    chosen = compiling.engine(forced)
    file = F.when(k % 2 == 0, F.concat(F.lit("translated_fixed_"), k.cast("string"), F.lit(".synctex.gz"))).otherwise("translated_fixed_1.png")
    return table(spark, d, "documents").select(
        "doc_id", compiling.requires_xetex(name, tex).alias("xetex"), chosen.alias("engine"), compiling.next_engine(chosen).alias("next_engine"), compiling.bibliography_tool(aux, k % 5 == 0, log).alias("tool"),
        compiling.left_behind(file, "translated").alias("temporary"),
    )


@query("k13_k14_k15_k17_k19_k20_k22_k23_k24_sinks", """SELECT doc_id, CASE WHEN n_chars * 4000 <= 8388608 THEN 'send' ELSE 'list' END AS chat, CASE WHEN n_chars * 4000 <= 5242880 THEN 'send' ELSE 'list' END AS direct,
 CASE doc_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'permanent' WHEN 2 THEN 'external' ELSE 'note' END AS way, CASE doc_id % 4 WHEN 3 THEN concat('PDF: f', doc_id::VARCHAR) ELSE concat('u', doc_id::VARCHAR) END AS value,
 left(text, 2000) AS error, concat('https://h/', doc_id::VARCHAR, '/translated_a.pdf') AS url, sha256(concat('[{"kind":"caption","text":"', left(s, 100), '"},{"kind":"body","text":"', left(s, 500), '"}]')) AS debug_sha,
 concat('2024-05-06 07:08:09 | INFO | app | ', doc_id::VARCHAR) AS line FROM (SELECT *, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS s FROM documents)""")
def sink_rows(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars") * 4000
    u = F.concat(F.lit("u"), k.cast("string"))
    ladder = sinks.block_ladder(F.when(k % 4 == 0, u), F.when(k % 4 == 1, u), F.when(k % 4 == 2, u), F.concat(F.lit("f"), k.cast("string")))
    plain = F.regexp_replace("text", "[^A-Za-z ]", "")
    debug = sinks.debug_record(F.array(F.struct(F.lit("caption").alias("kind"), plain.alias("text")), F.struct(F.lit("body").alias("kind"), plain.alias("text"))))
    return table(spark, d, "documents").select(
        "doc_id", sinks.size_gate(n).alias("chat"), sinks.size_gate(n, sinks.DIRECT_LIMIT).alias("direct"), ladder["way"].alias("way"), ladder["value"].alias("value"), sinks.page_status(F.lit("Error"), F.col("text"))["error"].alias("error"),
        sinks.permanent_place("/p/", k.cast("string"), F.lit("translated"), F.lit("a.pdf"), "https://h/")["url"].alias("url"), F.sha2(debug, 256).alias("debug_sha"),
        sinks.log_line(F.to_timestamp(F.lit("2024-05-06 07:08:09")), F.lit("INFO"), F.lit("app"), k.cast("string")).alias("line"),
    )


@query("j32_k14_attachments", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0 OR o_orderstatus <> 'F') GROUP BY ALL")
def attachments(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    fresh = sinks.missing_attachments(rows, rows.filter("o_custkey % 3 = 0 AND o_orderstatus = 'F'"), "o_custkey", "o_orderstatus")
    return fresh.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("k26_s19_installed_bbl", r"SELECT o_custkey, 'translated.bbl' AS target, arg_max(concat('\bibitem{', repeat('x', o_orderkey % 40 + 1), '}', o_orderkey::VARCHAR), [length(concat('\bibitem{', repeat('x', o_orderkey % 40 + 1), '}', o_orderkey::VARCHAR)), o_orderkey]) AS content FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey")
def installed_bbl(spark, d):
    k = F.col("o_orderkey")
    content = F.concat(F.when(k % 2 == 0, "\\bibitem{").otherwise("{"), F.repeat(F.lit("x"), (k % 40 + 1).cast("int")), F.lit("}"), k.cast("string"))
    return sinks.installed_bbl(table(spark, d, "orders").select("o_custkey", k.alias("path"), content.alias("content")), "o_custkey", "translated")


@query("x73_k09_merged_report", """WITH b AS (SELECT o_custkey % 50 AS run, o_orderkey AS batch_index, o_orderkey % 7 AS start, 3 AS count, o_orderkey % 5 AS passed, o_orderkey % 3 AS failed FROM orders)
SELECT run, concat('{"batches":[', string_agg(concat('{"batch_index":', batch_index, ',"start":', start, ',"count":', count, ',"passed":', passed, ',"failed":', failed, '}'), ',' ORDER BY batch_index), '],"total_passed":', sum(passed)::BIGINT, ',"total_failed":', sum(failed)::BIGINT, '}') AS payload FROM b GROUP BY run""")
def merged_report(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("run"), k.alias("batch_index"), (k % 7).alias("start"), F.lit(3).alias("count"), (k % 5).alias("passed"), (k % 3).alias("failed"))
    return sinks.merged_report(rows, "run")


@query("s04_s05_articles", "SELECT c_custkey, c_name, o.main, p.original_path FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS main FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, concat('/p/', min(o_orderkey)::VARCHAR) AS original_path FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p ON k = c_custkey")
def articles(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    mains = orders.groupBy("c_custkey").agg(F.min("o_orderkey").alias("main"))
    first = orders.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.min("o_orderkey").alias("k"))
    originals = first.select("c_custkey", F.concat(F.lit("/p/"), F.col("k").cast("string")).alias("path"))
    return files.articles(table(spark, d, "customer").select("c_custkey", "c_name"), mains, originals, "c_custkey").select("c_custkey", "c_name", "main", "original_path")


@query("z02_z03_consumed", """WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, (event_id % 10)::DOUBLE AS s FROM events),
k AS (SELECT *, coalesce(bool_or(failed) OVER w, false) AS over, coalesce(sum(s) OVER w, 0) AS spent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, count(*) FILTER (NOT over) AS consumed, count(*) FILTER (spent < 50) AS passes FROM k GROUP BY user_id""")
def consumed(spark, d):
    rows = table(spark, d, "events")
    order = ["ts", "event_id"]
    done = schedule.until_first_failure(rows, "user_id", order, F.col("event_type") == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("consumed"))
    passes = schedule.within_budget(rows, "user_id", order, (F.col("event_id") % 10).cast("double"), 50.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("passes"))
    return done.join(passes, "user_id")


@query("z04_z05_timeouts", "SELECT event_id, CASE WHEN event_id % 100 > 30 THEN 124 ELSE 0 END AS code, CASE WHEN event_id % 100 > 30 THEN right(props::VARCHAR, 10) END AS tail, CASE WHEN event_id % 100 <= 20 THEN 0 WHEN event_id % 100 <= 40 THEN 1 WHEN event_id % 100 <= 80 THEN 2 END AS pass FROM events")
def timeouts(spark, d):
    s = (F.col("event_id") % 100).cast("double")
    ended = schedule.timed(s, 30.0, F.lit(0), F.col("props"), 10)
    return table(spark, d, "events").select("event_id", ended["code"].alias("code"), ended["tail"].alias("tail"), schedule.retry_pass(s, 20.0).alias("pass"))


PROSE_FORMS = [("a <<CMD_1>> \\title{kept} % gone\n\\cite[p]{x}{y} $m$ b ¤", "a"), ("\\author{A} & ¤ \\begin{equation} x \\end{equation}", "b")]


@query("p02_prose_for_repair", r"""SELECT doc_id, sha256(trim(regexp_replace(CASE doc_id % 2 WHEN 0 THEN concat('a  title kept  b ', s) ELSE concat(' author A ', s, '  x  ') END, '\s+', ' ', 'g'))) AS prose_sha FROM (SELECT doc_id, translate(text, '%$\{}&<', '') AS s FROM documents)""")
def prose_for_repair(spark, d):
    """Titles and authors stay without their braces; the equation's own environment goes with the commands that name it."""
    docs = table(spark, d, "documents").withColumn("text", F.translate("text", "%$\\{}&<", ""))
    return docs.select("doc_id", F.sha2(X.prose_for_repair(varied([a for a, _ in PROSE_FORMS])), 256).alias("prose_sha"))

