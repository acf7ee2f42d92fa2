"""Chunking, masking, glossary, validation and rewriting over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import cache, chunking, containment, glossary, masking, rewrite, validation
from foliospark.plans.catalog import TEX_SQL, query, table, tex_documents, varied, varied_sql

#: A small glossary over the words of the tables: term, language (null: Russian), translation.
GLOSSARY = [
    ("the", None, "артикль"), ("that", None, "что"), ("and", "ru", "и"), ("with", "ru", "с"), ("queue", "ru", "очередь"), ("pour", "ru", "для"),
    ("le", "de", "der"), ("und", "zh", "和"), ("der", "ru", "этот"), ("que", None, "который"), ("of the", None, "из"), ("to the", "ru", "к"),
]
GLOSSARY_SQL = "g(term, lang, translation) AS (VALUES " + ", ".join("('{}', {}, '{}')".format(t, f"'{x}'" if x else "NULL", y) for t, x, y in GLOSSARY) + ")"
CHOSEN_SQL = "c AS (SELECT term, translation FROM g WHERE lang IS NULL OR lang = 'ru')"
FOUND_SQL = r"f AS (SELECT doc_id, term FROM documents, g WHERE regexp_matches(lower(text), concat('(^|[^\p{L}\p{N}_])', replace(term, ' ', '\s'), '($|[^\p{L}\p{N}_])')) AND (NOT contains(term, ' ') OR regexp_matches(lower(text), concat('(^|[^\p{L}\p{N}_])', term, '($|[^\p{L}\p{N}_])'))))"


def _glossary(spark):
    return spark.createDataFrame(GLOSSARY, "term string, lang string, translation string")


@query("w02_d02_packed_paragraphs", r"""
WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, i, 0 AS chunk, length(para) // 4 AS tokens FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN r.tokens + length(para) // 4 > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN r.tokens + length(para) // 4 > 200 THEN length(para) // 4 ELSE r.tokens + length(para) // 4 END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT r.doc_id, chunk, max(tokens)::BIGINT AS tokens, sha256(string_agg(concat(para, chr(10), chr(10)), '' ORDER BY r.i)) AS text_sha FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY r.doc_id, chunk""")
def packed_paragraphs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.packed(F.split("text", "\n", -1), 200)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", "c.tokens", F.sha2("c.text", 256).alias("text_sha"))


@query("d01_w01_section_chunks", f"WITH {TEX_SQL}" + r""",
s AS (SELECT doc_id, latex[length('\documentclass{article}') + 2:] AS body FROM l),
p AS (SELECT doc_id, list_filter(string_split_regex(replace(body, '\section{', concat(chr(1), '\section{')), chr(1)), lambda x: x <> '') AS parts FROM s),
e AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM p),
k AS (SELECT doc_id, i, CASE WHEN starts_with(t, '\section{') THEN 'section' ELSE 'intro' END AS kind, t FROM e WHERE trim(t, chr(10) || ' ') <> '')
SELECT doc_id, kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM k GROUP BY doc_id, kind
UNION ALL SELECT doc_id, 'preamble', 1, length('\documentclass{article}') + 1 FROM l""")
def section_chunks(spark, d):
    rows = chunking.chunks(tex_documents(spark, d), "doc_id", "latex", most=1 << 30)
    size = F.length("text") - F.when(F.col("kind") == "intro", 2).otherwise(0)
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("chars"))


@query("w03_d03_w18_bibliography_chunks", r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, concat(CASE WHEN i = 1 THEN concat('\begin{thebibliography}{9}', chr(10)) ELSE '' END, '\bibitem{b', (i - 1)::VARCHAR, '} ', line, chr(10)) AS part FROM l),
w AS (SELECT doc_id, (sum(length(part)) + length('\end{thebibliography}')) // 4 > 300 AS large, max(i) AS last FROM p GROUP BY doc_id),
r AS (SELECT p.doc_id, i, 0 AS chunk, length(part) // 4 AS tokens FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN large AND r.tokens + length(part) // 4 > 300 THEN chunk + 1 ELSE chunk END, CASE WHEN large AND r.tokens + length(part) // 4 > 300 THEN length(part) // 4 ELSE r.tokens + length(part) // 4 END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1 JOIN w ON w.doc_id = p.doc_id),
t AS (SELECT r.doc_id, chunk, concat(string_agg(part, '' ORDER BY r.i), CASE WHEN max(r.i) = any_value(last) THEN '\end{thebibliography}' ELSE '' END) AS text FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i JOIN w ON w.doc_id = r.doc_id GROUP BY r.doc_id, chunk),
b AS (SELECT doc_id, concat('chunk_', (chunk + 2)::VARCHAR, '_bib') AS chunk_id, text FROM t),
a AS (SELECT doc_id, concat('chunk_', (max(chunk) + 3)::VARCHAR, '_paragraph') AS chunk_id, concat(chr(10), '\appendix', chr(10), 'rest', chr(10), '\end{document}', chr(10), chr(10)) AS text FROM t GROUP BY doc_id),
h AS (SELECT doc_id, 'chunk_0_preamble' AS chunk_id, '' AS text FROM documents UNION ALL SELECT doc_id, 'chunk_1_paragraph', concat('\begin{document}', chr(10), chr(10), chr(10)) FROM documents)
SELECT doc_id, chunk_id, sha256(text) AS text_sha FROM b UNION ALL SELECT doc_id, chunk_id, sha256(text) FROM a UNION ALL SELECT doc_id, chunk_id, sha256(text) FROM h""")
def bibliography_chunks(spark, d):
    items = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("\\bibitem{b"), i.cast("string"), F.lit("} "), x, F.lit("\n"))), "")
    tex = F.concat(F.lit("\\begin{document}\n\\begin{thebibliography}{9}\n"), items, F.lit("\\end{thebibliography}\n\\appendix\nrest\n\\end{document}"))
    return chunking.chunks(table(spark, d, "documents").select("doc_id", tex.alias("tex")), "doc_id", "tex", 300).select("doc_id", "chunk_id", F.sha2("text", 256).alias("text_sha"))


@query("a14_t03_assembled", r"SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS full_sha, count(*) AS parts FROM conversations GROUP BY conv_id")
def assembled(spark, d):
    rows = table(spark, d, "conversations")
    out = chunking.assembled(rows, "conv_id", "turn").select("conv_id", F.sha2("full_text", 256).alias("full_sha"))
    return out.join(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")), "conv_id")


MARKED_TEX = (
    "\\documentclass{article}\n\\begin{document}\n% a note\nSee \\cite[p. 2]{a{b}c} and \\verb|x$y| at 5\\% off.\n\\begin{equation}\nE=mc^2 % inside\n\\end{equation}\n\\includegraphics[width=1cm]{f.png} "
    "$a_№$ ¤\n\\begin{tikzpicture}\\begin{scope} a \\end{scope}\\end{tikzpicture} \\(z\\) $$q$$ \\[ w \\] $k$\n\\end{document}\n"
)


def _tex_with_marks(spark, d):
    """Documents with formulas, a figure, code, citations and comments around their text."""
    return table(spark, d, "documents").select("doc_id", varied([MARKED_TEX]).alias("tex"))


@query("m00_masked", f"""WITH t AS (SELECT doc_id, text, {varied_sql([MARKED_TEX])} AS tex FROM (SELECT doc_id, translate(text, '%$', '') AS text FROM documents))
SELECT doc_id, 12 AS n_tokens, sha256(concat('\\documentclass{{article}}', chr(10), '\\begin{{document}}', chr(10), '<<COMMENT_0>>', chr(10), 'See <<CMD_11>> and <<CODE_2>> at 5\\% off.', chr(10), '<<MATH_DISP_5>>', chr(10), '<<IMG_4>> <<MATH_INLINE_9>> ', text, chr(10),
 '<<TIKZ_3>> <<MATH_INLINE_8>> <<MATH_DISP_7>> <<MATH_DISP_6>> <<MATH_INLINE_10>>', chr(10), '\\end{{document}}', chr(10))) AS masked_sha FROM t""")
def masked(spark, d):
    plain = table(spark, d, "documents").withColumn("text", F.translate("text", "%$", ""))  # marks are those of the form only
    rows = masking.masked(plain.select("doc_id", varied([MARKED_TEX]).alias("tex")), "doc_id", "tex")
    return rows.select("doc_id", F.sha2("masked", 256).alias("masked_sha"), F.size("tokens").alias("n_tokens"))


@query("j01_j02_m16_round_trip", f"SELECT doc_id, sha256({varied_sql([MARKED_TEX])}) AS tex_sha, 0 AS leftovers, true AS single_pass_differs FROM documents")
def round_trip(spark, d):
    docs = _tex_with_marks(spark, d)
    rows = masking.masked(docs, "doc_id", "tex").join(docs, "doc_id")
    back = masking.restored(F.col("masked"), F.col("tokens"))
    once = masking.unmasked(F.col("masked"), F.col("tokens"))
    return rows.select("doc_id", F.sha2(back, 256).alias("tex_sha"), F.size(masking.leftovers(back)).alias("leftovers"), (once != F.col("tex")).alias("single_pass_differs"))


@query("m08_m09_m17_flat_tokens", r"""
WITH t AS (SELECT doc_id, concat(text, ' $$a', chr(10), 'b$$ <<MATH_', doc_id::VARCHAR, '>>', chr(10), chr(10), chr(10), '<<x y>>', chr(10), 'end') AS s FROM documents)
SELECT doc_id, len(regexp_extract_all(s, '(?s)\$\$.*?\$\$')) AS displays, len(regexp_extract_all(s, '<<[A-Z_]+_\d+>>')) AS tokens,
 sha256(regexp_replace(regexp_replace(s, '<<[^>]+>>', '', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')) AS clean_sha FROM t""")
def flat_tokens(spark, d):
    s = F.concat("text", F.lit(" $$a\nb$$ <<MATH_"), F.col("doc_id").cast("string"), F.lit(">>\n\n\n<<x y>>\nend"))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(s, F.lit(r"(?s)\$\$.*?\$\$")).alias("displays"), F.size(masking.leftovers(s)).alias("tokens"), F.sha2(masking.without_leftovers(s), 256).alias("clean_sha"))


@query("a01_mask_counts", r"""SELECT lang, count(*) AS documents, sum(2 + len(regexp_extract_all(text, '%[^\n]*')))::BIGINT AS comments, count(*)::BIGINT AS images, count(*)::BIGINT AS specialized FROM documents GROUP BY lang""")
def mask_counts(spark, d):
    rows = masking.masked(_tex_with_marks(spark, d), "doc_id", "tex").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("stats")["comments"]).cast("long").alias("comments"), F.sum(F.col("stats")["images"]).cast("long").alias("images"), F.sum(F.col("stats")["specialized"]).cast("long").alias("specialized"))


@query("j06_relevant_terms", f"WITH {GLOSSARY_SQL}, {FOUND_SQL} SELECT * FROM f")
def relevant_terms(spark, d):
    return glossary.relevant_terms(table(spark, d, "documents"), _glossary(spark), "doc_id", "text")


@query("j07_s09_chosen_terms", f"WITH {GLOSSARY_SQL}, {CHOSEN_SQL} SELECT * FROM c")
def chosen_terms(spark, d):
    return glossary.chosen(_glossary(spark), "ru")


@query("a15_x17_x70_x72_usage", f"WITH {GLOSSARY_SQL}, {CHOSEN_SQL}, {FOUND_SQL}" + r""",
full_ AS (SELECT greatest(length(concat('{', string_agg(concat('"', term, '":"', translation, '"'), ',' ORDER BY term), '}')) // 4, 1) AS n FROM c),
own AS (SELECT doc_id, count(*) AS k, string_agg(concat('"', c.term, '":"', translation, '"'), ',' ORDER BY c.term) FILTER (translation IS NOT NULL) AS j FROM f LEFT JOIN c USING (term) GROUP BY doc_id)
SELECT d.doc_id, 12 AS total_terms, coalesce(k, 0) AS relevant_terms, round(coalesce(k, 0) * 100.0 / 12, 1)::DOUBLE AS usage_percentage, full_.n AS full_tokens,
 CASE WHEN j IS NULL THEN 0 ELSE greatest(length(concat('{', j, '}')) // 4, 1) END AS relevant_tokens, full_.n - CASE WHEN j IS NULL THEN 0 ELSE greatest(length(concat('{', j, '}')) // 4, 1) END AS tokens_saved
FROM documents d LEFT JOIN own USING (doc_id), full_""")
def usage(spark, d):
    return glossary.usage(table(spark, d, "documents"), _glossary(spark), "doc_id", "text").withColumn("usage_percentage", F.col("usage_percentage").cast("double"))


@query("t11_x71_glossary_formats", f"WITH {GLOSSARY_SQL}, {CHOSEN_SQL}" + r""" SELECT concat('{', string_agg(concat('"', term, '":"', translation, '"'), ',' ORDER BY term), '}') AS compact,
 string_agg(concat('  • ', term, ' → ', translation), chr(10) ORDER BY term) AS listed FROM c""")
def glossary_formats(spark, d):
    m = F.map_from_entries(F.collect_list(F.struct("term", "translation")))
    return glossary.chosen(_glossary(spark), "ru").agg(m.alias("m")).select(glossary.compact(F.col("m")).alias("compact"), glossary.listed(F.col("m")).alias("listed"))


@query("a20_j25_validation", f"WITH {TEX_SQL}" + r""",
p AS (SELECT a.doc_id, a.latex AS o, c.latex AS t FROM l a JOIN l c ON c.doc_id = a.doc_id + 1),
m AS (SELECT doc_id, length(t)::DOUBLE / length(o) AS ratio, len(regexp_extract_all(o, '\\section\{')) AS so, len(regexp_extract_all(t, '\\section\{')) AS st,
  len(regexp_extract_all(o, '\$\$')) + len(regexp_extract_all(o, '\\\[')) AS mo, len(regexp_extract_all(t, '\$\$')) + len(regexp_extract_all(t, '\\\[')) AS mt FROM p)
SELECT doc_id, (ratio < 0.5 OR ratio > 2)::INT + (so <> st)::INT + (abs(mo - mt) > 2)::INT AS n_issues,
 (100 - CASE WHEN ratio < 0.5 OR ratio > 2 THEN 5 ELSE 0 END - CASE WHEN so <> st THEN 30 ELSE 0 END - CASE WHEN abs(mo - mt) > 2 THEN 30 ELSE 0 END)::DOUBLE / 100 AS score,
 (100 - CASE WHEN ratio < 0.5 OR ratio > 2 THEN 5 ELSE 0 END - CASE WHEN so <> st THEN 30 ELSE 0 END - CASE WHEN abs(mo - mt) > 2 THEN 30 ELSE 0 END) >= 80 AS valid FROM m""")
def validated(spark, d):
    df = tex_documents(spark, d)
    pairs = df.join(df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("latex").alias("other")), "doc_id")
    issues = pairs.select("doc_id", validation.structure_issues(F.col("latex"), F.col("other")).alias("issues"))
    score = validation.score(F.col("issues"))
    return issues.select("doc_id", F.size("issues").alias("n_issues"), score.alias("score"), (score >= 0.8).alias("valid"))


@query("j25_style_and_terms", r"""WITH t AS (SELECT doc_id, concat(text, ' ну !! я ') AS s FROM documents),
p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '%[^\n]*', ' ', 'g'), '(?s)\$\$.*?\$\$', ' ', 'g'), '\$[^$]*\$', ' ', 'g'), '\\[a-zA-Z]+\*?', ' ', 'g'), '[{}\[\]]', ' ', 'g'), '\s+', ' ', 'g')) AS prose FROM t),
q AS (SELECT *, lower(prose) AS low, len(regexp_extract_all(prose, '!')) AS marks FROM p),
i AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(low, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') THEN 'Glossary term left untranslated: ''the''' END, CASE WHEN NOT contains(low, 'что') THEN 'Glossary translation missing for ''the'' -> ''что''' END,
 CASE WHEN regexp_matches(low, '(^|[^\p{L}\p{N}_])queue($|[^\p{L}\p{N}_])') THEN 'Glossary term left untranslated: ''queue''' END, CASE WHEN NOT contains(low, 'le') THEN 'Glossary translation missing for ''queue'' -> ''le''' END,
 CASE WHEN contains(low, 'ну ') THEN 'Colloquial register detected: ну ' END, CASE WHEN marks >= 2 THEN concat('Excessive exclamation marks: ', marks::VARCHAR) END,
 CASE WHEN contains(prose, '!!') OR contains(prose, '???') THEN 'Informal punctuation detected' END, CASE WHEN regexp_matches(low, '(^|\s)я(\s|$)') THEN 'First-person singular detected (''я'')' END], lambda x: x IS NOT NULL) AS issues FROM q)
SELECT doc_id, array_to_string(issues, '|') AS issues, greatest(100 - list_sum(list_transform(issues, lambda x: CASE WHEN contains(x, 'left untranslated') THEN 20 WHEN contains(x, 'translation missing') THEN 15 WHEN contains(x, 'Colloquial') OR contains(x, 'Excessive') OR contains(x, 'Informal') THEN 10 ELSE 5 END)), 0)::DOUBLE / 100 AS score FROM i""")
def style_and_terms(spark, d):
    expected = F.array(F.struct(F.lit("the").alias("term"), F.lit("что").alias("translation")), F.struct(F.lit("queue").alias("term"), F.lit("le").alias("translation")))
    rows = table(spark, d, "documents").withColumn("t", F.concat("text", F.lit(" ну !! я ")))
    return rows.select("doc_id", F.concat(validation.term_issues(expected, F.col("t")), validation.style_issues(F.col("t"))).alias("issues")).withColumn("score", validation.score(F.col("issues"))).withColumn("issues", F.array_join("issues", "|"))


@query("l03_english_gate", r"""
WITH b AS (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(text, '\n\s*\n')), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, length(t) >= 120 AND len(regexp_extract_all(t, '[A-Za-z]'))::DOUBLE / greatest(len(regexp_extract_all(t, '\S')), 1) >= 0.25
 AND len(list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND list_contains([""" + ", ".join(f"'{w}'" for w in T.ENGLISH_STOP_WORDS) + r"""], x))) >= 6 AS heavy FROM b)
SELECT doc_id, bool_or(heavy) AS english_left FROM w GROUP BY doc_id""")
def english_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", validation.english_gate(F.col("text")).alias("english_left"))


RULE_TEX = r"\documentclass[a]{article}\n\usepackage{subfiles>\n\usepackage{ x }\n\usepackage{x} % again\n\begin{document}\n\nobibliography*\n\begin{figure*>\end{figure*>\n\begin{table}\ cite{a} e.g. x\n"
RULE_SQL = r"concat('\documentclass[a]{article}', chr(10), '\usepackage{subfiles>', chr(10), '\begin{document}', chr(10), '\nobibliography* ', chr(10), '\begin{thebibliography}{9} e.g. x ', '\ cite{a} ', text, chr(769), chr(10), '\end{document}', chr(10), '\end{document}')"


def _rule_tex():
    head = F.lit("\\documentclass[a]{article}\n\\usepackage{subfiles>\n\\begin{document}\n\\nobibliography* \n\\begin{thebibliography}{9} e.g. x \\ cite{a} ")
    return F.concat(head, F.col("text"), F.lit("\u0301\n\\end{document}\n\\end{document}"))


@query("r01_r23_r26_r30_r31_r32_r37_rules", f"WITH t AS (SELECT doc_id, {RULE_SQL} AS s FROM documents)" + r"""
SELECT doc_id, sha256(regexp_replace(s, '\\usepackage\{([^}]+)>', '\\usepackage{\1}', 'g')) AS closing_signs, sha256(replace(s, '\ cite', '\cite')) AS broken_commands,
 sha256(regexp_replace(s, '(e\.g\.|i\.e\.) ', '\1\\ ', 'g')) AS typos, sha256(replace(s, '\begin{thebibliography}', concat('\raggedbottom', chr(10), '\begin{thebibliography}'))) AS ragged,
 sha256(regexp_replace(s, '\\nobibliography\*\s*\n?', '', 'g')) AS no_bibliography, sha256(regexp_replace(s, '\p{Mn}', '', 'g')) AS marks,
 sha256(replace(s, concat('\end{document}', chr(10), '\end{document}'), '\end{document}')) AS last_end FROM t""")
def rules(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _rule_tex().alias("s"))
    s = F.col("s")
    named = {"closing_signs": rewrite.closing_signs, "broken_commands": rewrite.broken_commands, "typos": rewrite.typos, "ragged": rewrite.ragged_bibliography, "no_bibliography": rewrite.no_bibliography, "marks": rewrite.combining_marks, "last_end": rewrite.last_end}
    return rows.select("doc_id", *[F.sha2(rule(s), 256).alias(name) for name, rule in named.items()])


R00_FORMS = [
    (
        "\\documentclass[a]{article}\n\\usepackage{subfiles>\n\\begin{document}\n\\nobibliography* \n\\begin{thebibliography}{9} e.g. x \\ cite{a} ¤\u0301\n\\end{document}\n\\end{document}",
        "\\documentclass[a]{article}\n\\usepackage{subfiles}\n\\begin{document}\n\\raggedbottom\n\\begin{thebibliography}{9} e.g.\\ x \\cite{a} ¤\n\\end{document}",
    ),
    (
        "\\documentclass{article}\n\\usepackage{a}\n\\usepackage{ a } % again\n\\usepackage[T1]{fontenc}\n\\begin{document}\nтекст <<CMD_3>>\n\\begin{figure*}¤\\end{figure*}\n\\end{document}",
        "\\PassOptionsToPackage{russian}{babel}\n\\documentclass{article}\n\\usepackage{a}\n\\usepackage[T2A]{fontenc}\n\\begin{document}\nтекст \n\\begin{figure}[ht]¤\\end{figure}\n\\end{document}",
    ),
    ("№ ¤", "№ ¤"),
]


@query("r00_rewritten", f"SELECT doc_id, length(t) AS size, sha256(t) AS text_sha FROM (SELECT doc_id, {varied_sql([b for _, b in R00_FORMS])} AS t FROM documents)")
def rewritten(spark, d):
    rows = table(spark, d, "documents").select("doc_id", varied([a for a, _ in R00_FORMS]).alias("s"))
    return rewrite.rewritten(rows, "s").select("doc_id", F.length("s").alias("size"), F.sha2("s", 256).alias("text_sha"))


@query("j03_j04_j05_u07_resume", r"""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN 'bib' ELSE 'section' END AS kind FROM conversations), k AS (SELECT conv_id, turn, upper(text) AS text FROM conversations WHERE (conv_id + turn) % 3 <> 0)
SELECT c.conv_id, count(*) AS chunks, count(k.text) AS resumed, count(*) FILTER (k.text IS NULL AND kind <> 'bib') AS pending, count(*) FILTER (k.text IS NULL) AS missing,
 min(c.turn) FILTER (k.text IS NULL) AS first_missing FROM c LEFT JOIN k USING (conv_id, turn) GROUP BY c.conv_id""")
def resume(spark, d):
    t = table(spark, d, "conversations")
    chunks = t.select("conv_id", "turn", "text", F.when(F.col("turn") % 5 == 4, "bib").otherwise("section").alias("kind"))
    done = t.filter((F.col("conv_id") + F.col("turn")) % 3 != 0).select("conv_id", "turn", F.upper("text").alias("text"))
    out = cache.resumed(chunks, done, "conv_id", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("done_text").alias("resumed"))
    left = cache.pending(chunks, done.select("conv_id", "turn"), "conv_id", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pending"))
    gone = cache.incomplete(chunks, done.select("conv_id", "turn"), "conv_id", "turn").select("conv_id", F.col("n_missing").alias("missing"), F.get("missing", F.lit(0)).alias("first_missing"))
    return out.join(left, "conv_id", "left").join(gone, "conv_id", "left").fillna(0, ["pending", "missing"])


@query("j08_l01_cache_probe", "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN concat('[', text, ']') ELSE concat('<', text, '>') END) AS reply_sha FROM documents")
def cache_probe(spark, d):
    short = table(spark, d, "documents").select("doc_id", "text", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"), 256).alias("key"))
    kept = short.filter("doc_id % 2 = 0").select("key", F.concat(F.lit("["), "text", F.lit("]")).alias("reply"))
    return cache.translated(short, kept, lambda t: f"<{t}>").select("doc_id", F.sha2("reply", 256).alias("reply_sha"))


@query("j30_j31_contained_benchmark", r"""
WITH i AS (SELECT item_id, text AS probe FROM benchmark UNION ALL SELECT item_id + 1000000, regexp_extract(text, '(\S+)', 1) FROM benchmark)
SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM i JOIN documents d ON contains(d.text, probe) WHERE probe <> '' GROUP BY item_id""")
def contained_benchmark(spark, d):
    """Documents that hold a whole item, and those that hold its first word as text."""
    items = table(spark, d, "benchmark")
    first = items.select((F.col("item_id") + 1000000).alias("item_id"), F.regexp_extract("text", r"(\S+)", 1).alias("probe"))
    probes = items.select("item_id", F.col("text").alias("probe")).unionByName(first)
    hits = containment.contained(table(spark, d, "documents"), "doc_id", "text", probes, "item_id", "probe")
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@query("t05_l04_suspicious_blocks", r"""
WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, len(list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND list_contains([""" + ", ".join(f"'{w}'" for w in T.ENGLISH_STOP_WORDS) + r"""], x))) + CASE WHEN contains(t, '@') THEN 1000 ELSE 0 END AS score FROM b)
SELECT doc_id, i, score FROM w WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 6""")
def suspicious_blocks(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    scored = rows.withColumn("score", T.english_words(F.col("t")) + F.when(F.col("t").contains("@"), 1000).otherwise(0)).filter("score > 0")
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "i"))).filter("n <= 6").select("doc_id", "i", "score")


@query("a25_x32_token_breakdown", r"""SELECT doc_id, (length(s) / 4.0 - 2)::DOUBLE::DECIMAL(18, 2)::DOUBLE AS x, greatest(floor(length(s) / 4.0 - 2)::BIGINT, 0) AS system_tokens, 2 AS glossary_tokens, length(text) // 4 AS document_tokens FROM (SELECT *, CASE WHEN regexp_matches(text, '\S') THEN concat('s', chr(10), text) ELSE 's' END AS s FROM documents)""")
def token_breakdown(spark, d):
    from foliospark.operators import report

    system = report.prompt(F.lit("s"), F.lit(" "), F.col("text"))
    parts = report.token_breakdown(system, F.col("text"), F.lit('{"a":"b"}'[:8]))
    rows = table(spark, d, "documents").select("doc_id", system.alias("s"), parts.alias("p"))
    return rows.select("doc_id", (F.length("s") / 4 - 2).alias("x"), F.col("p.system").alias("system_tokens"), F.col("p.glossary").alias("glossary_tokens"), F.col("p.document").alias("document_tokens"))


@query("x28_kept_preamble", r"""SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN concat('\documentclass{b} ', text) ELSE concat('\documentclass{a}', chr(10), text) END) AS tex_sha FROM documents""")
def kept_preamble(spark, d):
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\documentclass{b} "), "text")).otherwise(F.col("text"))
    original = F.concat(F.lit("\\documentclass{a}\n\\begin{document}"), "text")
    return table(spark, d, "documents").select("doc_id", F.sha2(rewrite.kept_preamble(reply, original), 256).alias("tex_sha"))


X29_FORM = (
    "\\documentclass{a}\n\\usepackage{cmap}\n\\usepackage[T2A]{fontenc}\n\\usepackage[russian]{babel}\n\n\\AtBeginDocument{\\ifdefined\\shorthandoff\\shorthandoff{\"}\\fi}\n\\usepackage{eso-pic}\n\\usepackage{xcolor}\n"
    "\\newcommand{\\ArxivStamp}[1]{\\AddToShipoutPictureBG*{\\AtPageLowerLeft{\\put(28,0){\\raisebox{0.5\\paperheight}{\\makebox(0,0){\\rotatebox{90}{\\rmfamily\\huge\\color{gray} #1}}}}}}}\n\\ArxivStamp{arXiv:№}\n"
    "\\begin{document}\nтекст ¤"
)


@query("x29_x30_added_support", f"SELECT doc_id, sha256({varied_sql([X29_FORM])}) AS tex_sha, sha256({varied_sql([X29_FORM])}) AS again_sha FROM documents")
def added_support(spark, d):
    tex = F.concat(F.lit("\\documentclass{a}\n\\begin{document}\nтекст "), "text")
    both = lambda t: rewrite.stamped(rewrite.cyrillic_support(t), F.concat(F.lit("arXiv:"), F.col("doc_id").cast("string")))
    rows = table(spark, d, "documents").select("doc_id", both(tex).alias("tex"))
    return rows.select("doc_id", F.sha2("tex", 256).alias("tex_sha"), F.sha2(both(F.col("tex")), 256).alias("again_sha"))


@query("a16_thanks_lines", r"""SELECT doc_id, CASE WHEN 2 * length(t) + 4 >= 1200 THEN 16 WHEN 2 * length(t) + 4 >= 700 THEN 14 WHEN 2 * length(t) + 4 >= 350 THEN 12 ELSE 0 END AS lines FROM (SELECT doc_id, replace(replace(text, '{', ''), '}', '') AS t FROM documents)""")
def thanks_lines(spark, d):
    from foliospark.operators import structure

    t = F.replace(F.replace("text", F.lit("{"), F.lit("")), F.lit("}"), F.lit(""))
    tex = F.concat(F.lit("\\thanks{"), t, F.lit("} x \\thanks{{a}"), t, F.lit("b}"))
    return table(spark, d, "documents").select("doc_id", structure.thanks_lines(tex).alias("lines"))


@query("a22_japanese_style", r"""WITH t AS (SELECT doc_id, concat(translate(text, '\%$&{}<', ''), '。', repeat('これは本である。', 10 + (doc_id % 20)::INT), CASE WHEN doc_id % 2 = 0 THEN 'つまりそのため。' ELSE 'つまり。' END) AS s FROM documents),
p AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM t), q AS (SELECT doc_id, s, list_filter(list_transform(string_split_regex(s, '[。．.]'), lambda x: trim(x)), lambda x: x <> '') AS each FROM p),
n AS (SELECT doc_id, len(each)::INT AS sentences, len(regexp_extract_all(s, 'である|であり|であった'))::INT AS dearu, len(list_filter(each[1:200], lambda x: regexp_matches(x, '^\S{1,24}は')))::INT AS topics, len(regexp_extract_all(s, 'したがって|従って|そのため|なぜなら|つまり')) AS connectors FROM q)
SELECT doc_id, sentences, dearu, topics, sentences >= 18 AND dearu >= 10 AND topics >= 8 AND connectors >= 2 AS literal FROM n""")
def japanese_style(spark, d):
    from foliospark.operators import validation as V

    k = F.col("doc_id")
    plain = F.translate("text", "\\%$&{}<", "")
    tex = F.concat(plain, F.lit("。"), F.repeat(F.lit("これは本である。"), (10 + k % 20).cast("int")), F.when(k % 2 == 0, "つまりそのため。").otherwise("つまり。"))
    s = V.japanese_style(tex)
    rows = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", "s.sentences", "s.dearu", "s.topics", "s.literal")


@query("r35_m18_right_to_left", r"""WITH t AS (SELECT doc_id, translate(text, '\$%{}<', '') AS s FROM documents)
SELECT doc_id, sha256(concat('\begin{document}', chr(10), 'שלום \cite{a} $x$ ', regexp_replace(replace(s, chr(10), concat(chr(10), 'שלום ')), '([A-Za-z][A-Za-z0-9@._:+\-/]*)', '\\LR{\1}', 'g'), chr(10), 'only Latin')) AS tex_sha FROM t""")
def right_to_left(spark, d):
    s = F.replace(F.translate("text", "\\$%{}<", ""), F.lit("\n"), F.lit("\nשלום "))
    tex = F.concat(F.lit("\\begin{document}\nשלום \\cite{a} $x$ "), s, F.lit("\nonly Latin"))
    return table(spark, d, "documents").select("doc_id", F.sha2(rewrite.latin_in_rtl(tex), 256).alias("tex_sha"))


@query("t06_candidate_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, line FROM l WHERE len(list_filter(string_split_regex(lower(line), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2 AND list_contains([""" + ", ".join(f"'{w}'" for w in T.ENGLISH_STOP_WORDS) + r"""], x))) >= 10)
SELECT doc_id, (i - 1)::INT AS i, length(line) AS size FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 25""")
def candidate_lines(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).filter(T.english_words(F.col("line")) >= 10)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).filter("n <= 25").select("doc_id", "i", F.length("line").alias("size"))
