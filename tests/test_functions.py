"""Literal cases for the column functions and the rewrite rules."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T
from foliospark.operators import cache, diagnose, report, rewrite, structure, validation


@pytest.mark.parametrize("text,expected", [
    ("https://arxiv.org/abs/1706.03762", "1706.03762"), ("https://arxiv.org/pdf/1706.03762.pdf", "1706.03762"), ("1706.03762", "1706.03762"), (" 1706.03762v3 ", "1706.03762v3"),
    ("hep-th/9901001", "hep-th/9901001"), ("math.CO/1234567", None), ("nothing", None), ("", None),
])
def test_paper_id(value, text, expected):
    assert value(T.paper_id, x=text) == expected


@pytest.mark.parametrize("size,expected", [("0", "0.0 B"), ("1023", "1023.0 B"), ("1024", "1.0 KB"), ("1280", "1.2 KB"), ("1536", "1.5 KB"), ("1073741824", "1.0 GB"), ("2199023255552", "2.0 TB")])
def test_size_label(value, size, expected):
    assert value(lambda c: T.size_label(c.cast("long")), x=size) == expected


@pytest.mark.parametrize("fn,text,expected", [
    (T.file_name, ' a<b>:"c?. ', "a_b___c_"), (T.safe_id, " ..a b/c.. ", "a_b_c"), (T.safe_id, "..", "paper"), (T.without_blank_lines, "a\n  \n\nb", "a\n\nb"), (T.language_code, " JP ", "ja"), (T.language_code, "", "ru"),
    (T.language_name, "de", "German"), (T.without_fence, "```tex\nab\nc\n```", "ab\nc"), (T.without_fence, "```", "```"), (T.english_words, "The cat, and the ICE of a queue", 4),
    (X.without_comments, "a % b\n5\\% c\r\n% d", "a \n5\\% c\r\n"), (X.comment_count, "Hello world % This is a comment\nNext line", 1), (X.braces_balanced, "{a{b}}", True), (X.braces_balanced, "}{", False), (X.braces_balanced, "", True),
    (X.brace_delta, "{{ % }}", 2), (X.escaped, "50% of {a}\\b_c", "50\\% of \\{a\\}\\textbackslash{}b\\_c"), (X.prose_for_validation, "\\section{Title} Hello $x$ % c\n world", "Title Hello world"),
    (X.prose_for_repair, "\\title{A} \\cite{b} text <<MATH_INLINE_1>>", "title A text"), (X.untranslated_heading, "1. Introduction", True), (X.untranslated_heading, "2", False), (X.wide_table, "l|c|r@{x}lll", True),
    (T.like_heading, "3.2 Attention", True), (T.like_heading, "3", True), (T.like_heading, "1\nIntroduction", True), (T.like_heading, "Some prose here.", False), (T.like_authors, "Ann\nann@lab.edu", True),
    (X.packages, "\\usepackage{a, b}\\usepackage[x]{a}", ["a", "b", "a"]), (X.table_rows, "a & b % n\n\\\\ \\hline c", [["a", "b"], ["c"]]), (diagnose.errors, "! a\nx\n! b\n! a", ["! a", "! b"]),
])
def test_cases(value, fn, text, expected):
    assert value(fn, x=text) == expected


def test_nulls_stay_null(value):
    for fn in (T.file_name, T.size_label, X.escaped, X.without_comments, X.prose_for_validation, T.truncated):
        assert value(fn if fn is not T.truncated else lambda c: T.truncated(c, 5), x=None) is None


RULES = [
    (rewrite.closing_signs, r"\usepackage{subfiles>", r"\usepackage{subfiles}"), (rewrite.closing_signs, r"\end{figure}>", r"\end{figure}"),
    (rewrite.single_packages, "\\usepackage{a}\n\\usepackage{ a } % x\n\\begin{document}\n\\usepackage{a}", "\\usepackage{a}\n\\begin{document}\n\\usepackage{a}"),
    (rewrite.stray_class_lines, "\\documentclass command.\n\\documentclass{article}", "% \\documentclass command.\n\\documentclass{article}"), (rewrite.redefined_commands, r"\newcommand{\C}[1]{x}", r"\renewcommand{\C}[1]{x}"),
    (rewrite.font_encoding, "\\usepackage[T1]{fontenc} текст", "\\usepackage[T2A]{fontenc} текст"), (rewrite.package_order, "\\usepackage{babel}\n\\usepackage[T1]{fontenc}", "\\usepackage[T1]{fontenc}\n\\usepackage{babel}\n"),
    (rewrite.babel_options, "\\documentclass{googlecloud}\n\\usepackage[english]{babel}\nтекст", "\\PassOptionsToPackage{russian}{babel}\n\\documentclass{googlecloud}\n\nтекст"),
    (rewrite.babel_options, "\\documentclass{article}\n\\usepackage[english]{babel}\nтекст", "\\documentclass{article}\n\\usepackage[english,russian]{babel}\nтекст"),
    (rewrite.cjk_package, "russian babel \\begin{CJK}{a}{b}字\\end{CJK}", "russian babel 字"), (rewrite.broken_commands, r"\ text \ cite{ref} \lhead\includegraphics{a}", r"\text \cite{ref} \lhead{\includegraphics{a}}"),
    (rewrite.floats, r"\begin{figure*}{\includegraphics[w]{img}}\end{figure*>}", "\\begin{figure}[ht]\n\\includegraphics[w]{img}\\end{figure}"), (rewrite.minted, "\\begin{minted}{py}x\\end{minted}", "\\begin{verbatim}\nx\n\\end{verbatim}"),
    (rewrite.no_bibliography, "\\nobibliography*\n\\bibliography{a} \\nobibliography{b}", "\\bibliography{a} \\bibliography{b}"), (rewrite.combining_marks, "а\u0301б", "аб"), (rewrite.typos, "e.g. \\usepackage{graphix}", "e.g.\\ \\usepackage{graphicx}"),
    (rewrite.last_end, "a\\end{document}\n\nb\\end{document}\nc\\end{document}\n", "abc\\end{document}\n".replace("abc", "ab\nc").replace("b\nc", "bc")),
    (rewrite.ragged_bibliography, "\\begin{thebibliography}", "\\raggedbottom\n\\begin{thebibliography}"), (rewrite.ragged_bibliography, "\\raggedbottom \\begin{thebibliography}", "\\raggedbottom \\begin{thebibliography}"),
    (rewrite.latin_macro, "\\llamавtwo", "\\llamavtwo"), (rewrite.broken_graphics, "  \\1\\columnwidth]{a.pdf}", "  \\includegraphics[width=\\columnwidth]{a.pdf}"),
    (rewrite.column_graphics, "\\documentclass{acmart}\\includegraphics[width=0.9\\textwidth]{a}", "\\documentclass{acmart}\\includegraphics[width=\\columnwidth]{a}"),
    (rewrite.section_fonts, "\\documentclass{acmart}\n\\usepackage{sectsty}\n\\sectionfont{\\bf}\nx", "\\documentclass{acmart}\nx"), (rewrite.bold_sections, "\\section*{A}", "\\section*{\\textbf{A}}"),
]


RULES += [
    (rewrite.latin_in_rtl, "\\begin{document}\nשלום model \\cite{a} $x$\nonly latin\n\\begin{tabular}{l}שלום x\\end{tabular} שלום y", "\\begin{document}\nשלום \\LR{model} \\cite{a} $x$\nonly latin\n\\begin{tabular}{l}שלום x\\end{tabular} שלום \\LR{y}"),
    (rewrite.rtl_stamp, "\\AtPageLowerLeft{\n\\rotatebox{90}{ #1}\n% \\ArxivStamp{a}", "\\AtPageLowerRight{\n\\rotatebox{90}{ \\LR{#1}}\n\\ArxivStamp{a}"),
    (rewrite.cyrillic_support, "\\documentclass{a}\n\\usepackage{babel}\n\\begin{document}текст", "\\documentclass{a}\n\\usepackage{cmap}\n\\usepackage[T2A]{fontenc}\n\n\\usepackage{babel}\n\\AtBeginDocument{\\ifdefined\\shorthandoff\\shorthandoff{\"}\\fi}\n\\begin{document}текст"),
    (lambda c: rewrite.kept_preamble(c, F.lit("\\documentclass{a}\n\\title {x}")), "body", "\\documentclass{a}\nbody"),
]


@pytest.mark.parametrize("rule,tex,expected", RULES)
def test_rules(value, rule, tex, expected):
    once = value(rule, x=tex)
    assert once == expected
    assert value(rule, x=once) == once


def test_abstract_rules(value):
    tex = "\\documentclass{article}\n\\begin{document}\n\\begin{abstract}x\\end{abstract}"
    rule = rewrite.abstract_name("de")
    once = value(rule, x=tex)
    assert "{Zusammenfassung}" in once and once.count("etoolbox") == 1 and value(rule, x=once) == once
    roomy = value(rewrite.abstract_page, x=tex)
    assert "3\\baselineskip" in roomy and value(rewrite.abstract_page, x=roomy) == roomy
    assert "5\\baselineskip" in value(rewrite.abstract_page, x=tex.replace("x", "x" * 1200))


def test_bilingual(value):
    english = "We use \\ref{a} and $x$ with 12 models in this long English line here"
    assert value(rewrite.bilingual_lines, x=f"{english}\n\\ref{{a}} $x$ 12 モデル\nend") == "\\ref{a} $x$ 12 モデル\nend"
    assert value(rewrite.bilingual_lines, x=f"{english}\nend") == f"{english}\nend"


def test_score(value):
    four = lambda: F.array(*[F.lit("other")] * 4)
    assert value(lambda c: validation.score(four())) == 0.8
    assert value(lambda c: validation.score(F.array(F.lit("Section count mismatch: 2 vs 1")))) == 0.7
    assert value(lambda c: validation.structure_issues(F.lit("\\section{A} \\section{B}"), F.lit("\\section{A}"))) == ["Translation is suspiciously short (ratio 0.48)", "Section count mismatch: 2 vs 1"]


def test_cache_key(value):
    import hashlib
    import json

    text = 'a "quoted" \\ line\nnext é \t'
    expected = json.dumps({"max_tokens": 16000, "model": "m", "system": "s", "temperature": 0.3, "user": text}, sort_keys=True, ensure_ascii=False)
    assert value(lambda c: cache.cache_key(F.lit("s"), c, "m", 0.3, 16000), x=text) == hashlib.sha256(expected.encode()).hexdigest()


def test_verdict(value):
    reasons = lambda: F.array(F.lit("missing_package: a.sty"), F.lit("log_category: x"))
    v = value(lambda c: diagnose.verdict(reasons(), F.lit("fine"), F.lit(True)))
    assert v.reasons == ["missing_package: a.sty"] and v.warnings == ["nonfatal_log_category: x"]
    v = value(lambda c: diagnose.verdict(reasons(), F.lit("! Emergency stop."), F.lit(True)))
    assert len(v.reasons) == 2 and not v.warnings


def test_stamp_and_parts(value):
    once = value(lambda c: rewrite.stamped(c, F.lit("arXiv:1")), x="\\begin{document}")
    assert once.endswith("\\ArxivStamp{arXiv:1}\n\\begin{document}") and value(lambda c: rewrite.stamped(c, F.lit("arXiv:1")), x=once) == once
    parts = value(lambda c: report.token_breakdown(F.lit("s" * 40), c, F.lit("{" + "g" * 6 + "}")), x="u" * 10)
    assert parts.asDict() == {"system": 8, "glossary": 2, "document": 2, "total": 12}
    assert value(lambda c: report.prompt(c, F.lit(" "), F.lit("b")), x="a") == "a\nb"
    assert value(structure.thanks_lines, x="\\thanks{" + "a{b{c}}" * 60 + "}") == 12
    style = value(validation.japanese_style, x="これは本である。" * 20 + "つまりそのため")
    assert style.literal and style.topics == 20


def test_footnotes_by_mark_and_length(value):
    kind = lambda x, **most: value(lambda c: structure.block_kind(F.lit("plain_text"), c, F.lit(1), **most), x=x)
    assert (kind("†" + "a" * 198), kind("†" + "a" * 199), kind("†" + "a" * 199, footnote_below=None)) == ("footnote", "paragraph", "footnote")
    assert kind("1 " + chr(769) + "a") == "list_item" and kind("1 a") == "section_heading"


def test_spans(spark):
    rows = [(0, 0, 100.0, 100.0, "Title here", True), (0, 1, 101.0, 100.5, "x", False), (0, 2, 300.0, 101.0, "Title", False), (0, 3, 5.0, 300.0, "accepted paper", False), (0, 4, 200.0, 300.0, "other", False), (1, 0, 100.0, 100.0, "x", False)]
    df = spark.createDataFrame(rows, "page int, ord int, x double, y double, text string, is_title boolean")
    assert {(r.page, r.ord) for r in structure.distinct_spans(df).collect()} == {(0, 0), (0, 4), (1, 0)}
    ab = spark.createDataFrame([("latex", True, 4.0), ("latex", False, 9.0), ("typst", True, 2.0)], "renderer string, ok boolean, seconds double")
    assert {r.renderer: (r.successes, r.rate, r.speedup) for r in report.compared(ab).collect()} == {"latex": (1, 0.5, 1.0), "typst": (1, 1.0, 2.0)}
