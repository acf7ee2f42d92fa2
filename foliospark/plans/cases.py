"""Rules and masks over every document's whole text, set into constructs that vary by doc_id.

A case says what a rule makes of a construct; in both, ¤ stands for the document's text and № for its doc_id. Spark
builds the first form and applies the operator, SQL builds the second.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.operators import masking, rewrite
from foliospark.plans.catalog import query, table, varied, varied_sql

Cases = list[tuple[str, str]]


def rule_query(name: str, rule: Callable[[Column], Column], cases: Cases) -> None:
    """Register a query that applies a rule once and twice: every rule leaves what it has made alone."""
    after = varied_sql([b for _, b in cases])

    @query(name, f"SELECT doc_id, sha256(t) AS tex_sha, sha256(t) AS again_sha, length(t) AS size FROM (SELECT doc_id, {after} AS t FROM documents)")
    def run(spark, d):
        docs = table(spark, d, "documents").withColumn("tex", varied([a for a, _ in cases])).withColumn("once", rule(F.col("tex")))
        return docs.select("doc_id", F.sha2("once", 256).alias("tex_sha"), F.sha2(rule(F.col("once")), 256).alias("again_sha"), F.length("once").alias("size"))


JA = "私は \\cite{a} と $x$ と 42 です"
EN = "We use \\cite{a} and $x$ with the value 42"
EN_LONG = EN + " in a whole set of many words that make one long English paragraph for this test here"
CLASS = "\\documentclass{article}\n"
CYR = "текст "

RULES: list[tuple[str, Callable[[Column], Column], Cases]] = [
    ("r02_stray_class_lines", rewrite.stray_class_lines, [
        ("Says \\documentclass here\n% kept \\documentclass\n\\documentclass[a]{article}\n¤", "% Says \\documentclass here\n% kept \\documentclass\n\\documentclass[a]{article}\n¤"),
        ("Says \\documentclass here\n¤", "% Says \\documentclass here\n¤"), ("\\documentclass{b}\n¤\nthe \\documentclass again", "\\documentclass{b}\n¤\nthe \\documentclass again")]),
    ("r03_redefined_commands", rewrite.redefined_commands, [
        ("\\newcommand{\\C}[1]{x№}¤", "\\renewcommand{\\C}[1]{x№}¤"), ("\\newcommand{\\c}{y}¤", "\\newcommand{\\c}{y}¤"), ("\\newcommand*{\\C}{z}¤", "\\renewcommand*{\\C}{z}¤")]),
    ("r04_font_encoding", rewrite.font_encoding, [
        ("\\usepackage[T1]{fontenc}\nтекст №\n¤", "\\usepackage[T2A]{fontenc}\nтекст №\n¤"), ("\\usepackage[T1]{fontenc}\n№\n¤", "\\usepackage[T1]{fontenc}\n№\n¤"),
        ("\\usepackage{fontenc}\nтекст\n¤", "\\usepackage[T2A]{fontenc}\nтекст\n¤"), ("\\usepackage[T2A]{fontenc}\n\\usepackage[T1]{fontenc} % old\nтекст\n¤", "\\usepackage[T2A]{fontenc}\nтекст\n¤")]),
    ("r05_times_font", rewrite.times_font, [
        ("\\documentclass{IEEEtran}\n\\usepackage[T2A]{fontenc}\n\\usepackage{graphicx,times}\nтекст ¤", "\\documentclass{IEEEtran}\n\\renewcommand{\\rmdefault}{cmr}\n\n\\usepackage[T2A]{fontenc}\n\\usepackage{graphicx}\nтекст ¤"),
        ("\\usepackage{times}\n¤", "\\usepackage{times}\n¤"), (CLASS + "\\usepackage[T2A]{fontenc}\n\\usepackage{times}x\nтекст ¤", CLASS + "\\usepackage[T2A]{fontenc}\nx\nтекст ¤")]),
    ("r06_w11_bilingual_paragraphs", rewrite.bilingual_paragraphs, [
        (f"{EN_LONG}\n\n{JA}\n\n¤", f"{JA}\n\n¤"), (f"{EN}\n\n{JA}\n\n¤", f"{EN}\n\n{JA}\n\n¤"), (f"{EN_LONG}\n\n¤", f"{EN_LONG}\n\n¤"),
        (f"\\begin{{x}} {EN_LONG}\n\n{JA}\n\n¤", f"\\begin{{x}} {EN_LONG}\n\n{JA}\n\n¤")]),
    ("r07_bilingual_lines", rewrite.bilingual_lines, [
        (f"{EN} and four more words\n{JA}\n¤", f"{JA}\n¤"), (f"% {EN} and four more words\n{JA}\n¤", f"% {EN} and four more words\n{JA}\n¤"),
        (f"{EN} and four more words\n№ 別の文 \\cite{{b}} $y$\n¤", f"{EN} and four more words\n№ 別の文 \\cite{{b}} $y$\n¤")]),
    ("r09_acm_title", rewrite.acm_title, [
        ("\\documentclass{acmart}\nтекст\n\\begin{document}¤", "\\documentclass{acmart}\nтекст\n\n% bold title\n\\makeatletter\n\\def\\@titlefont{\\Huge\\rmfamily\\bfseries}\n\\makeatother\n\\begin{document}¤"),
        ("\\documentclass{acmart}\n\\begin{document}¤", "\\documentclass{acmart}\n\\begin{document}¤"), (CLASS + "текст\\begin{document}¤", CLASS + "текст\\begin{document}¤")]),
    ("r10_acm_countries", rewrite.acm_countries, [
        ("\\documentclass{acmart}\n  % \\city{A№}\n%\\country{B}\n¤", "\\documentclass{acmart}\n  \\city{A№}\n\\country{B}\n¤"), (CLASS + "% \\city{A}\n¤", CLASS + "% \\city{A}\n¤")]),
    ("r11_acm_lines", rewrite.acm_lines, [
        ("\\documentclass{acmart}\nтекст\\maketitle\n¤", "\\documentclass{acmart}\nтекст\\maketitle\n% relaxed line breaking\n\\sloppy\n\\emergencystretch=3em\n\n¤"), (CLASS + "текст\\maketitle\n¤", CLASS + "текст\\maketitle\n¤")]),
    ("r12_package_order", rewrite.package_order, [
        ("\\usepackage[x]{babel}\n\\usepackage[T1]{fontenc}¤", "\\usepackage[T1]{fontenc}\n\\usepackage[x]{babel}\n¤"), ("\\usepackage{fontenc}\n\\usepackage{babel}¤", "\\usepackage{fontenc}\n\\usepackage{babel}¤"),
        ("\\usepackage{babel}№¤", "\\usepackage{babel}№¤")]),
    ("r13_babel_options", rewrite.babel_options, [
        ("\\documentclass{googlecloud}\n\\usepackage[english]{babel}\nтекст¤", "\\PassOptionsToPackage{russian}{babel}\n\\documentclass{googlecloud}\n\nтекст¤"),
        (CLASS + "\\usepackage[german, english]{babel}\nтекст¤", CLASS + "\\usepackage[english,german,russian]{babel}\nтекст¤"), (CLASS + "\\usepackage[english]{babel}\n¤", CLASS + "\\usepackage[english]{babel}\n¤"),
        (CLASS + "\\usepackage[russian]{babel}\nтекст¤", CLASS + "\\usepackage[russian]{babel}\nтекст¤")]),
    ("r14_section_fonts", rewrite.section_fonts, [
        ("\\documentclass{own}\n\\usepackage{sectsty} % fonts\n\\sectionfont{\\large}\nx¤", "\\documentclass{own}\nx¤"), (CLASS + "\\usepackage{sectsty}\n\\sectionfont{\\large}¤", CLASS + "\\usepackage{sectsty}\n\\sectionfont{\\large}¤")]),
    ("r15_cjk_package", rewrite.cjk_package, [
        ("\\usepackage[russian]{babel}\\usepackage{CJK}\n\\begin{CJK}{UTF8}{min}¤\\end{CJK}", "\\usepackage[russian]{babel}¤"), ("\\usepackage{CJK}\n\\begin{CJK}{UTF8}{min}¤\\end{CJK}", "\\usepackage{CJK}\n\\begin{CJK}{UTF8}{min}¤\\end{CJK}")]),
    ("r16_leftover_tokens", masking.without_leftovers, [("<<MATH_№>>¤<<x y>>", "¤"), ("a\n\n\n\nb <<C_1>>¤", "a\n\nb ¤"), ("a\n\n\n\nb ¤", "a\n\n\n\nb ¤")]),
    ("r17_minted", rewrite.minted, [
        ("\\usepackage[n]{minted} % code\n\\begin{minted}[o]{py}¤\\end{minted}", "\\begin{verbatim}\n¤\n\\end{verbatim}"), ("\\inputminted{c}{f№.c}¤", "\\texttt{[code from f№.c omitted]}¤"),
        (" \\setminted{size}\n¤", "¤")]),
    ("r18_floats", rewrite.floats, [
        (CLASS + "\\begin{figure*}¤\\end{figure*}", CLASS + "\\begin{figure}[ht]¤\\end{figure}"), ("\\documentclass{IEEEtran}\n\\begin{figure*}¤\\end{figure*}", "\\documentclass{IEEEtran}\n\\begin{figure*}¤\\end{figure*}"),
        (CLASS + "\\begin{table}¤\\end{table}>", CLASS + "\\begin{table}[ht]¤\\end{table}"), (CLASS + "\\begin{table*}[t]¤\\end{table*}", CLASS + "\\begin{table}[t]¤\\end{table}")]),
    ("r19_column_graphics", rewrite.column_graphics, [
        ("\\documentclass{acmart}\\includegraphics[width=0.9\\textwidth]{f№}¤", "\\documentclass{acmart}\\includegraphics[width=\\columnwidth]{f№}¤"), (CLASS + "\\includegraphics[width=\\textwidth]{f}¤", CLASS + "\\includegraphics[width=\\textwidth]{f}¤")]),
    ("r20_broken_graphics", rewrite.broken_graphics, [("¤\n  \\1\\columnwidth]{f№.png}", "¤\n  \\includegraphics[width=\\columnwidth]{f№.png}"), ("¤\n\\1 x", "¤\n\\1 x")]),
    ("r21_latin_macro", rewrite.latin_macro, [("\\llamавtwo ¤ \\llamавtwo", "\\llamavtwo ¤ \\llamavtwo"), ("\\llama ¤", "\\llama ¤")]),
    ("r28_abstract_page", rewrite.abstract_page, [
        ("№\\begin{abstract}short\\end{abstract}¤", "№\\enlargethispage{3\\baselineskip}\n\\vspace{-0.2in}\n\\begin{abstract}short\\end{abstract}¤"),
        ("\\begin{abstract}" + "long " * 250 + "\\end{abstract}¤", "\\enlargethispage{5\\baselineskip}\n\\vspace{-0.3in}\n\\begin{abstract}" + "long " * 250 + "\\end{abstract}¤"), ("samepage \\begin{abstract}a\\end{abstract}¤", "samepage \\begin{abstract}a\\end{abstract}¤")]),
    ("r29_orphan_bibliography", rewrite.orphan_bibliography, [
        ("¤\n\\begin{thebibliography}{9}\n% none\n\n\\end{document}", "¤\n\\end{document}"), ("¤\n\\begin{thebibliography}{9}\n\\bibitem{a} №\n\\end{document}", "¤\n\\begin{thebibliography}{9}\n\\bibitem{a} №\n\\end{document}")]),
    ("r36_line_spacing", rewrite.line_spacing, [("¤\\begin{document}№", "¤\\linespread{1.08}\n\\begin{document}№"), ("\\linespread{2}¤\\begin{document}", "\\linespread{2}¤\\begin{document}"), ("¤", "¤")]),
    ("r38_bold_sections", rewrite.bold_sections, [("\\section{A №}¤\\subsection*{B}", "\\section{\\textbf{A №}}¤\\subsection*{\\textbf{B}}"), ("\\title{\\textbf{T}}¤", "\\title{\\textbf{T}}¤")]),
    ("r33_rtl_stamp", rewrite.rtl_stamp, [
        ("\\AtPageLowerLeft \\rotatebox{90} #1\n% \\ArxivStamp{№}\n¤", "\\AtPageLowerRight \\rotatebox{90} \\LR{#1}\n\\ArxivStamp{№}\n¤"), ("№¤", "№¤")]),
]

for _name, _rule, _cases in RULES:
    rule_query(_name, _rule, _cases)

for _lang, _heading in (("de", "Zusammenfassung"), ("ja", "概要"), ("ru", "Аннотация")):
    _patch = "\\makeatletter\n\\patchcmd{\\abstract}{Abstract}{\\abstractname}{}{}\n\\patchcmd{\\abstract}{ABSTRACT}{\\abstractname}{}{}\n\\makeatother\n"
    rule_query(f"r27_abstract_name_{_lang}", rewrite.abstract_name(_lang), [
        ("\\documentclass{a}\n\\begin{document}\\begin{abstract}¤\\end{abstract}", f"\\documentclass{{a}}\n\\usepackage{{etoolbox}}\n\n\\renewcommand{{\\abstractname}}{{{_heading}}}\n{_patch}\\begin{{document}}\\begin{{abstract}}¤\\end{{abstract}}"),
        ("\\documentclass{a}\n\\begin{document}¤", "\\documentclass{a}\n\\begin{document}¤")])


def mask_query(name: str, cases: list[tuple[str, str, list[str]]]) -> None:
    """Register a query that masks a form: cases are (form, masked form, originals in token order)."""
    masked_sql, originals = varied_sql([m for _, m, _ in cases]), varied_sql(["\x1f".join(o) for _, _, o in cases])
    counts = "CASE doc_id % {} {} END".format(len(cases), " ".join(f"WHEN {k} THEN {len(o)}" for k, (_, _, o) in enumerate(cases)))

    plain = "(SELECT doc_id, translate(text, '%$\\<', '') AS text FROM documents)"  # what masks look for is in the forms only

    @query(name, f"SELECT doc_id, sha256({masked_sql}) AS masked_sha, sha256({originals}) AS originals_sha, {counts} AS n_tokens, true AS same, 0 AS leftovers FROM {plain}")
    def run(spark, d):
        docs = table(spark, d, "documents").withColumn("text", F.translate("text", "%$\\<", "")).select("doc_id", varied([f for f, _, _ in cases]).alias("tex"))
        rows = masking.masked(docs, "doc_id", "tex").join(docs, "doc_id")
        back = masking.restored(F.col("masked"), F.col("tokens"))
        return rows.select(
            "doc_id", F.sha2("masked", 256).alias("masked_sha"), F.sha2(F.array_join(F.transform("tokens", lambda t: t["original"]), "\x1f"), 256).alias("originals_sha"),
            F.size("tokens").alias("n_tokens"), (back == F.col("tex")).alias("same"), F.size(masking.leftovers(back)).alias("leftovers"),
        )


def _environments(names: tuple[str, ...], kind: str) -> list[tuple[str, str, list[str]]]:
    return [(f"a\\begin{{{n}}}¤№\\end{{{n}}}b", f"a<<{kind}_0>>b", [f"\\begin{{{n}}}¤№\\end{{{n}}}"]) for n in names]


def _names(kind: str, form: str) -> tuple[str, ...]:
    return next(names for _, k, f, names in masking.PASSES if (k, f) == (kind, form))


def _commands(names: tuple[str, ...], kind: str) -> list[tuple[str, str, list[str]]]:
    return [(f"a\\{n}{{x{{№}}y¤}}b", f"a<<{kind}_0>>b", [f"\\{n}{{x{{№}}y¤}}"]) for n in names]


mask_query("m01_comments", [("a % №\n¤\nb \\% c", "a <<COMMENT_0>>\n¤\nb \\% c", ["% №"]), ("¤№", "¤№", []), ("%a\n%b", "<<COMMENT_0>>\n<<COMMENT_1>>", ["%a", "%b"])])
mask_query("m02_m14_code_environments", _environments(_names("CODE", "environment"), "CODE") + [
    ("x\\begin{verbatim}a\\begin{verbatim}№\\end{verbatim}b\\end{verbatim}y", "x<<CODE_0>>y", ["\\begin{verbatim}a\\begin{verbatim}№\\end{verbatim}b\\end{verbatim}"]), ("\\end{verbatim}№\\begin{verbatim}", "\\end{verbatim}№\\begin{verbatim}", [])])
mask_query("m03_delimited_code", [("a \\verb|x№y| b", "a <<CODE_0>> b", ["\\verb|x№y|"]), ("\\verb*+№+\\lstinline!a!", "<<CODE_0>><<CODE_1>>", ["\\verb*+№+", "\\lstinline!a!"]), ("\\verb|№", "\\verb|№", []), ("\\verb|a\\|№|", "<<CODE_0>>", ["\\verb|a\\|№|"])])
mask_query("m04_drawings", _environments(_names("TIKZ", "environment"), "TIKZ") + [("\\begin{figure}\\begin{tikzpicture}№\\end{tikzpicture}\\caption{c}\\end{figure}", "\\begin{figure}<<TIKZ_0>>\\caption{c}\\end{figure}", ["\\begin{tikzpicture}№\\end{tikzpicture}"])])
mask_query("m05_m15_images", [("\\includegraphics[width=1cm]{f{№}.png} x", "<<IMG_0>> x", ["\\includegraphics[width=1cm]{f{№}.png}"]), ("\\includegraphics{a№", "<<IMG_0>>", ["\\includegraphics{a№"])])
mask_query("m06_m14_displays", _environments(_names("MATH_DISP", "environment"), "MATH_DISP"))
mask_query("m07_m08_m09_pairs", [("\\[¤№\\] \\[\nb\\]", "<<MATH_DISP_0>> <<MATH_DISP_1>>", ["\\[¤№\\]", "\\[\nb\\]"]), ("a $$¤№\nb$$ c", "a <<MATH_DISP_0>> c", ["$$¤№\nb$$"]), ("\\(¤№\\)\\(c\\)", "<<MATH_INLINE_0>><<MATH_INLINE_1>>", ["\\(¤№\\)", "\\(c\\)"])])
mask_query("m10_dollars", [("a $x_№$ $b$ c¤", "a <<MATH_INLINE_0>> <<MATH_INLINE_1>> c¤", ["$x_№$", "$b$"]), ("5\\$ and ¤№\\$", "5\\$ and ¤№\\$", []), ("one $ only №", "one $ only №", []), ("\\\\$№$", "\\\\<<MATH_INLINE_0>>", ["$№$"])])
mask_query("m11_m15_commands", _commands(_names("CMD", "command"), "CMD") + [("\\citep[p. №]{a} b", "<<CMD_0>> b", ["\\citep[p. №]{a}"]), ("\\citep[a][b]{№}", "<<CMD_0>>[b]{№}", ["\\citep[a]"]), ("\\href{u}{№}", "\\href{u}{№}", [])])
mask_query("m00_m12_m13_w12_nested_tokens", [
    ("$a$ % №\n\\cite{k}", "<<MATH_INLINE_1>> <<COMMENT_0>>\n<<CMD_2>>", ["% №", "$a$", "\\cite{k}"]),
    ("\\begin{equation}a % №\n\\label{e}\\end{equation}", "<<MATH_DISP_1>>", ["% №", "\\begin{equation}a <<COMMENT_0>>\n\\label{e}\\end{equation}"])])
