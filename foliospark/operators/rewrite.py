"""Ordered rewrite rules for translated LaTeX. Every rule is Column -> Column and can be applied twice without harm."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T
from foliospark.operators.masking import without_leftovers

#: Name of the abstract by language (fixed values).
ABSTRACT_NAMES = {
    "ru": "Аннотация", "uk": "Анотація", "be": "Анатацыя", "bg": "Резюме", "pl": "Streszczenie", "cs": "Abstrakt", "sk": "Abstrakt",
    "de": "Zusammenfassung", "fr": "Résumé", "es": "Resumen", "pt": "Resumo", "it": "Sommario", "nl": "Samenvatting",
    "sv": "Sammanfattning", "no": "Sammendrag", "da": "Resumé", "fi": "Tiivistelmä", "tr": "Özet", "ar": "الملخص", "he": "תקציר",
    "fa": "چکیده", "hi": "सारांश", "ja": "概要", "jp": "概要", "jpn": "概要", "zh": "摘要", "zhs": "摘要", "zht": "摘要", "ko": "초록",
}
#: Classes that load babel themselves, and classes that get on with sectsty (fixed values).
BABEL_CLASSES = ("googlecloud", "acl", "aclpub", "nips", "neurips", "icml", "aaai", "ijcai", "emnlp", "naacl", "coling", "acl_natbib", "acmart", "revtex")
STANDARD_CLASSES = ("article", "report", "book", "letter", "slides", "memoir", "scrartcl", "scrreprt", "scrbook", "extarticle", "extreport", "extbook")
#: Commands that lose their backslash's neighbour, and misspelt packages (fixed values).
SPACED_COMMANDS = ("text", "cite", "ref", "label", "section", "chapter", "item", "begin", "end", "caption", "include", "input")
PACKAGE_TYPOS = {"pifong": "pifont", "graphix": "graphicx", "hypperef": "hyperref"}

Rule = Callable[[Column], Column]


def lines_of(t: Column) -> Column:
    return F.split(t, "\n", -1)


def _is_class(t: Column, *names: str) -> Column:
    return reduce(lambda a, b: a | b, [X.document_class(t).contains(n) for n in names])


def closing_signs(t: Column) -> Column:
    """A greater-than sign or parenthesis where a brace should close."""
    return X.replaced(
        t, (r"\\usepackage\{([^}]+)>", r"\\usepackage{$1}"), (r"\\usepackage\{([^}]+)\)", r"\\usepackage{$1}"),
        (r"\\(begin|end)\{([^}]+)>", r"\\$1{$2}"), (r"\\(begin|end)\{([^}]+)\}>", r"\\$1{$2}"),
    )


def _split_at(t: Column, at: Column) -> tuple[Column, Column]:
    """What comes before a place (1 is the first, 0 none: all of the text) and the rest."""
    end = F.when(at > 0, at - 1).otherwise(F.length(t))
    return F.substring(t, F.lit(1), end), F.substring(t, end + 1, F.length(t))


def single_packages(t: Column) -> Column:
    """Of equal package lines before the document begins the first stays; spaces and comments do not count.

    Only the preamble, which is short, is folded line by line.
    """
    preamble, rest = _split_at(t, F.instr(t, "\\begin{document}"))
    kind = "struct<out: array<string>, seen: array<string>>"
    key = lambda line: F.regexp_replace(F.regexp_replace(line, "%.*", ""), r"(?U)\s+", "")
    start = F.struct(F.array().alias("out"), F.array().alias("seen")).cast(kind)

    def add(acc: Column, line: Column) -> Column:
        package = F.ltrim(line).startswith("\\usepackage")
        again = package & F.array_contains(acc["seen"], key(line))
        return F.struct(
            F.when(again, acc["out"]).otherwise(F.array_append(acc["out"], line)).alias("out"),
            F.when(package & ~again, F.array_append(acc["seen"], key(line))).otherwise(acc["seen"]).alias("seen"),
        ).cast(kind)

    single = F.aggregate(lines_of(preamble), start, add, lambda acc: F.array_join(acc["out"], "\n"))
    return F.when(F.regexp_count(preamble, F.lit(r"\\usepackage")) > 1, F.concat(single, rest)).otherwise(t)


def stray_class_lines(t: Column) -> Column:
    """Lines that mention the class command without braces, before the real one, become comments."""
    real = F.regexp_extract(t, r"(?m)(^\s*\\documentclass(?:\[[^\]]*\])?\{[^}]+\})", 1)
    head, rest = _split_at(t, F.when(real != "", F.instr(t, real)).otherwise(0))
    fixed = F.regexp_replace(head, r"(?m)^([ \t]*)(?![ \t%])([^\n{]*\\documentclass[^\n{]*)$", "$1% $2")
    return F.when(head.contains("\\documentclass"), F.concat(fixed, rest)).otherwise(t)


def redefined_commands(t: Column) -> Column:
    return F.regexp_replace(t, r"\\newcommand(\*?)\{\\C\}(\[[^\]]*\])?", r"\\renewcommand$1{\\C}$2")


def font_encoding(t: Column) -> Column:
    """With Cyrillic text, T2A in place of T1."""
    has = t.contains("\\usepackage[T2A]{fontenc}") | t.contains("\\usepackage[T2A,T1]{fontenc}")
    without_t1 = F.regexp_replace(t, r"\\usepackage\[T1\]\{fontenc\}\s*(%[^\n]*)?\n?", "")
    given = F.regexp_extract(t, r"(?i)\\usepackage\[([^\]]*)\]\{fontenc\}", 1)
    options = F.when(given == "", F.lit("T2A")).when(given.contains("T1"), F.replace(given, F.lit("T1"), F.lit("T2A"))).otherwise(F.concat(F.lit("T2A,"), given))
    found = F.regexp_extract(t, r"(?i)(\\usepackage(?:\[[^\]]*\])?\{fontenc\})", 1)
    at = F.instr(t, found)
    changed = F.when(found == "", t).otherwise(F.concat(F.substring(t, F.lit(1), at - 1), F.lit("\\usepackage["), options, F.lit("]{fontenc}"), F.substring(t, at + F.length(found), F.length(t))))
    return F.when(T.has_cyrillic(t), F.regexp_replace(F.when(has, without_t1).otherwise(changed), "\n\n\n+", "\n\n")).otherwise(t)


def times_font(t: Column) -> Column:
    plain = F.replace(F.replace(t, F.lit("\\usepackage{graphicx,times}"), F.lit("\\usepackage{graphicx}")), F.lit("\\usepackage{times}"), F.lit(""))
    ieee = X.document_class(t).contains("ieeetran") & ~t.contains("\\renewcommand{\\rmdefault}{cmr}")
    with_default = F.when(ieee, F.regexp_replace(plain, r"(?s)^(.*?\\documentclass(?:\[[^\]]*\])?\{[^}]+\})", "$1\n\\\\renewcommand{\\\\rmdefault}{cmr}\n")).otherwise(plain)
    return F.when(t.contains("\\usepackage[T2A]{fontenc}") & T.has_cyrillic(t), F.regexp_replace(with_default, r"\n\s*\n\s*\n+", "\n\n")).otherwise(t)


_CJK = "[ぁ-ゟ゠-ヿ一-龯]"


def _without_twins(parts: Column, joint: str, is_twin) -> Column:
    """Parts joined again without those that are twins of the part after them."""
    pairs = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.struct(a.alias("own"), F.coalesce(b, F.lit("")).alias("after")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: ~is_twin(p["own"], p["after"])), lambda p: p["own"]), joint)


def _same_anchors(a: Column, b: Column, least: float) -> Column:
    x, y = X.anchors(a), X.anchors(b)
    return ((F.size(x) >= 2) | (F.size(y) >= 2)) & (X.jaccard(x, y) >= least)


def bilingual_lines(t: Column) -> Column:
    """An English line goes if the next is its translation: kana or han, and the same anchors."""
    twin = lambda a, b: ~F.ltrim(a).startswith("%") & (F.regexp_count(a, F.lit(r"\b[A-Za-z]{3,}\b")) >= 6) & b.rlike(_CJK) & _same_anchors(a, b, 0.55)
    return F.when(t.rlike(_CJK), _without_twins(lines_of(t), "\n", twin)).otherwise(t)


def bilingual_paragraphs(t: Column) -> Column:
    """The same for paragraphs, outside environments and bibliographies."""
    plain = lambda p: ~(p.contains("\\begin{") | p.contains("\\end{") | p.contains("\\bibitem"))
    twin = lambda a, b: (F.regexp_count(a, F.lit(r"\b[A-Za-z]{3,}\b")) >= 18) & ~a.rlike(_CJK) & b.rlike(_CJK) & plain(a) & plain(b) & _same_anchors(a, b, 0.45)
    return F.when(t.rlike(_CJK), _without_twins(F.split(t, r"\n\s*\n", -1), "\n\n", twin)).otherwise(t)


def acm_title(t: Column) -> Column:
    patch = "\n% bold title\n\\makeatletter\n\\def\\@titlefont{\\Huge\\rmfamily\\bfseries}\n\\makeatother\n"
    return F.when(T.has_cyrillic(t) & _is_class(t, "acmart") & ~t.contains("\\@titlefont") & t.contains("\\begin{document}"), X.insert_before_document(t, F.lit(patch))).otherwise(t)


def acm_countries(t: Column) -> Column:
    return F.when(_is_class(t, "acmart"), F.regexp_replace(t, r"(?m)^([ \t]*)%\s*(\\(?:city|country)\{[^}]*\})", "$1$2")).otherwise(t)


def acm_lines(t: Column) -> Column:
    apply = T.has_cyrillic(t) & _is_class(t, "acmart") & ~t.contains("\\emergencystretch=3em") & t.contains("\\maketitle")
    return F.when(apply, F.regexp_replace(t, r"(?s)^(.*?\\maketitle)", "$1\n% relaxed line breaking\n\\\\sloppy\n\\\\emergencystretch=3em\n")).otherwise(t)


def package_order(t: Column) -> Column:
    """fontenc comes before babel."""
    font = F.regexp_extract(t, r"(\\usepackage(?:\[[^\]]*\])?\{fontenc\})", 1)
    babel = F.regexp_extract(t, r"(\\usepackage(?:\[[^\]]*\])?\{babel\})", 1)
    late = (font != "") & (babel != "") & (F.instr(t, font) > F.instr(t, babel))
    at = F.instr(t, font)
    cut = F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(font), F.length(t)))
    to = F.instr(cut, babel)
    moved = F.concat(F.substring(cut, F.lit(1), to - 1), font, F.lit("\n"), F.substring(cut, to, F.length(cut)))
    return F.when(late, F.regexp_replace(moved, r"\n\s*\n\s*\n", "\n\n")).otherwise(t)


def babel_options(t: Column) -> Column:
    """With Cyrillic text: one babel with Russian last, or its option passed on where the class loads babel."""
    rx = r"(?i)\\usepackage(?:\[([^\]]*)\])?\{babel\}"
    passes = F.split(t, r"\\documentclass")[0].contains("russian") & t.contains("\\PassOptionsToPackage")
    option = F.lit("\\PassOptionsToPackage{russian}{babel}\n")
    at = F.instr(t, "\\documentclass")
    early = lambda x: F.when(passes | (at == 0), x).otherwise(F.concat(F.substring(x, F.lit(1), F.instr(x, "\\documentclass") - 1), option, F.substring(x, F.instr(x, "\\documentclass"), F.length(x))))
    own = F.regexp_replace(early(F.regexp_replace(t, rx, "")), r"\n\s*\n\s*\n", "\n\n")
    given = F.transform(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(1)), lambda o: F.split(o, ","))), lambda o: F.trim(o))
    others = F.array_sort(F.array_distinct(F.filter(given, lambda o: (o != "") & (F.lower(o) != "russian"))))
    merged = F.concat(F.lit("\\usepackage["), F.array_join(F.array_append(others, F.lit("russian")), ","), F.lit("]{babel}"))
    first = F.regexp_extract(t, r"(?i)(\\usepackage(?:\[[^\]]*\])?\{babel\})", 1)
    place = F.instr(t, first)
    rest = F.regexp_replace(F.substring(t, place + F.length(first), F.length(t)), rx, "")
    joined = F.concat(F.substring(t, F.lit(1), place - 1), merged, rest)
    settled = (F.regexp_count(t, F.lit(rx)) == 1) & F.exists(given, lambda o: F.lower(o) == "russian")
    usual = F.when(first == "", F.when(passes | (at == 0), t).otherwise(F.concat(option, t))).when(settled, t).otherwise(F.regexp_replace(joined, r"\n\s*\n\s*\n", "\n\n"))
    return F.when(~T.has_cyrillic(t), t).when(_is_class(t, *BABEL_CLASSES), own).otherwise(usual)


def section_fonts(t: Column) -> Column:
    bad = t.contains("\\usepackage{sectsty}") & (X.document_class(t) != "") & ~F.trim(X.document_class(t)).isin(*STANDARD_CLASSES)
    commands = r"(?i)\\(?:allsections|section|subsection|subsubsection|paragraph|chapter|part)font\{[^}]*\}\s*\n?"
    return F.when(bad, X.replaced(t, (r"(?i)\\usepackage\{sectsty\}\s*(%[^\n]*)?\n?", ""), (commands, ""), (r"\n\s*\n\s*\n", "\n\n"))).otherwise(t)


def cjk_package(t: Column) -> Column:
    """With Russian babel the CJK package and its environments go; what is in them stays."""
    apply = (t.contains("\\usepackage{CJK}") | t.contains("\\begin{CJK}")) & t.contains("russian") & t.contains("babel")
    return F.when(apply, X.replaced(t, (r"\\usepackage\{CJK\}\s*\n?", ""), (r"(?s)\\begin\{CJK\}\{[^}]*\}\{[^}]*\}(.*?)\\end\{CJK\}", "$1"))).otherwise(t)


def minted(t: Column) -> Column:
    """minted becomes verbatim, where its environments are closed."""
    begin = r"\\begin\{minted\}(\[[^\]]*\])?\{[^}]*\}"
    opened = F.regexp_replace(t, begin, "\\\\begin{verbatim}\n")
    closed = F.replace(opened, F.lit("\\end{minted}"), F.lit("\n\\end{verbatim}"))
    t = F.when(F.regexp_count(t, F.lit(begin)) == F.regexp_count(t, F.lit(r"\\end\{minted\}")), closed).otherwise(t)
    return X.replaced(
        t, (r"\\usepackage(\[[^\]]*\])?\{minted\}\s*(%[^\n]*)?\n?", ""),
        (r"\\inputminted(?:\[[^\]]*\])?\{[^}]*\}\{([^}]*)\}", r"\\texttt{[code from $1 omitted]}"),
        (r"(?m)^\s*\\setminted(\[[^\]]*\])?\{[^}]*\}\s*(%[^\n]*)?\n?", ""),
    )


def floats(t: Column) -> Column:
    """Plain floats with a place, except in two-column classes; stray signs and braces around graphics go."""
    t = F.regexp_replace(t, r"\{(figure|table)\*>", r"{$1*")
    plain = X.replaced(t, (r"(?i)\\begin\{(figure|table)\*\}(\[[^\]]*\])", r"\\begin{$1}$2"), (r"(?i)\\begin\{(figure|table)\*\}", r"\\begin{$1}[ht]"), (r"(?i)\\end\{(figure|table)\*\}", r"\\end{$1}"))
    one = F.when(_is_class(t, "ieeetran", "acmart"), t).otherwise(plain)
    graphics = r"(\\includegraphics[^{}]*\{[^{}]*\})"
    return X.replaced(
        one, (r"(?i)(\\(?:begin|end)\{(?:figure|table)\*?\})>", "$1"),
        (r"(?i)\\begin\{(figure|table)\}(?!\[[^\]]*\])", r"\\begin{$1}[ht]"),
        (rf"(?i)(\\begin\{{(?:figure|table)\}}(?:\[[^\]]*\])?)\{{\s*{graphics}\s*\}}", "$1\n$2"), (rf"(?<!\S)\{{\s*{graphics}\s*\}}", "$1"),
    )


def column_graphics(t: Column) -> Column:
    return F.when(_is_class(t, "acmart"), F.regexp_replace(t, r"(\\includegraphics\[[^\]]*width=)[0-9.]*\\textwidth", r"$1\\columnwidth")).otherwise(t)


def broken_graphics(t: Column) -> Column:
    return F.regexp_replace(t, r"(?m)^(\s*)\\1\\columnwidth]\{([^}]+)\}", r"$1\\includegraphics[width=\\columnwidth]{$2}")


def latin_macro(t: Column) -> Column:
    return F.replace(t, F.lit("\\llamавtwo"), F.lit("\\llamavtwo"))


def broken_commands(t: Column) -> Column:
    """A space after the backslash of common commands, and lost braces after header commands."""
    spaced = r"\\ (" + "|".join(SPACED_COMMANDS) + ")"
    return X.replaced(t, (spaced, r"\\$1"), (r"(?i)\\([lcr](?:head|foot))(\\includegraphics(?:\[[^\]]*\])?\{[^}]+\})", r"\\$1{$2}"))


def typos(t: Column) -> Column:
    """A controlled space after e.g. and i.e., and misspelt packages."""
    steps = [(r"(e\.g\.|i\.e\.) ", r"$1\\ ")] + [(rf"\\(usepackage|RequirePackage)(\[[^\]]*\])?\{{{a}\}}", rf"\\$1$2{{{b}}}") for a, b in PACKAGE_TYPOS.items()]
    return X.replaced(t, *steps)


def abstract_name(lang: str) -> Rule:
    """The abstract's heading in the target language, also where a class has it fixed."""
    name = ABSTRACT_NAMES.get(lang.strip().lower() or "ru")

    def rule(t: Column) -> Column:
        if not name:
            return t
        fixed = F.regexp_replace(t, r"\\\\renewcommand\{\\\\abstractname\}", r"\\renewcommand{\\abstractname}")
        uses = fixed.contains("\\begin{abstract}") | fixed.contains("\\begin{leapabstract}")
        named = fixed.rlike(r"\\renewcommand\{\\abstractname\}\{[^}]*\}")
        tools = F.when(fixed.contains("{etoolbox}"), fixed).otherwise(F.regexp_replace(fixed, r"(?s)^(.*?\\documentclass(?:\[.*?\])?\{.*?\})", "$1\n\\\\usepackage{etoolbox}"))
        renamed = F.when(named, F.regexp_replace(tools, r"\\renewcommand\{\\abstractname\}\{[^}]*\}", rf"\\renewcommand{{\\abstractname}}{{{name}}}")).otherwise(tools)
        own = F.when(named, F.lit(None)).otherwise(F.lit(f"\\renewcommand{{\\abstractname}}{{{name}}}"))
        patch = "\\makeatletter\n\\patchcmd{\\abstract}{Abstract}{\\abstractname}{}{}\n\\patchcmd{\\abstract}{ABSTRACT}{\\abstractname}{}{}\n\\makeatother"
        patched = F.when(fixed.contains("\\patchcmd{\\abstract}{Abstract}"), F.lit(None)).otherwise(F.lit(patch))
        block = F.concat_ws("\n", own, patched)
        done = F.when((block == "") | ~renamed.contains("\\begin{document}"), renamed).otherwise(X.insert_before_document(renamed, F.concat(F.lit("\n"), block, F.lit("\n"))))
        return F.when(uses, done).otherwise(fixed)

    return rule


def abstract_page(t: Column) -> Column:
    """Room for the abstract on its page, more for a long one."""
    begin = F.when(t.contains("\\begin{leapabstract}"), "leapabstract").when(t.contains("\\begin{abstract}"), "abstract")
    at = F.instr(t, F.concat(F.lit("\\begin{"), begin, F.lit("}")))
    tail = F.substring(t, at, F.length(t))
    end = F.instr(tail, F.concat(F.lit("\\end{"), begin, F.lit("}")))
    long = end + F.length(begin) + 5 > 1000
    block = F.when((end > 0) & long, "\\enlargethispage{5\\baselineskip}\n\\vspace{-0.3in}\n").otherwise("\\enlargethispage{3\\baselineskip}\n\\vspace{-0.2in}\n")
    ahead = F.substring(t, F.greatest(at - 200, F.lit(1)), F.least(at - 1, F.lit(200)))
    free = begin.isNotNull() & ~ahead.contains("enlargethispage") & ~ahead.contains("samepage")
    return F.when(free, F.concat(F.substring(t, F.lit(1), at - 1), block, tail)).otherwise(t)


def orphan_bibliography(t: Column) -> Column:
    """A last bibliography that holds nothing but comments before the document ends, and has no end of its own, goes."""
    begin, end = F.lit("\\begin{thebibliography}"), F.lit("\\end{document}")
    inside = F.substring_index(t, "\\begin{thebibliography}", -1)
    plain = T.stripped(F.regexp_replace(F.regexp_replace(inside, r"^\{[^}]+\}", ""), r"(?m)^[ \t]*%.*$", ""))
    head = F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(inside) - F.length(begin)), F.lit(" \t"))
    orphan = t.contains("\\begin{thebibliography}") & plain.startswith(end) & head.endswith("\n")
    return F.when(orphan, F.concat(head, F.substring(inside, F.instr(inside, "\\end{document}"), F.length(inside)))).otherwise(t)


def ragged_bibliography(t: Column) -> Column:
    return F.when(t.contains("\\begin{thebibliography}") & ~t.contains("\\raggedbottom"), F.replace(t, F.lit("\\begin{thebibliography}"), F.lit("\\raggedbottom\n\\begin{thebibliography}"))).otherwise(t)


def no_bibliography(t: Column) -> Column:
    return X.replaced(t, (r"\\nobibliography\*\s*\n?", ""), (r"\\nobibliography(\{[^}]+\})", r"\\bibliography$1"))


def combining_marks(t: Column) -> Column:
    return F.regexp_replace(t, r"\p{Mn}", "")


def line_spacing(t: Column) -> Column:
    return F.when(t.contains("\\linespread") | ~t.contains("\\begin{document}"), t).otherwise(X.insert_before_document(t, F.lit("\\linespread{1.08}\n")))


def last_end(t: Column) -> Column:
    """Of several ends of the document the last stays."""
    return F.regexp_replace(t, r"\\end\{document\}[\n\r]*(?=[\s\S]*\\end\{document\})", "")


def bold_sections(t: Column) -> Column:
    """Not in the chain: headings and the title in bold."""
    return X.replaced(t, (r"\\((?:sub)*(?:section|paragraph)|chapter|part|title)(\*?)\{(?!\\textbf\{)([^}]+)\}", r"\\$1$2{\\textbf{$3}}"))


_RTL = "[\u0590-\u05ff\u0600-\u06ff]"
_LATIN = r"[A-Za-z][A-Za-z0-9@._:+\-/]*"
#: What a line of right-to-left prose keeps as it is, and what makes a line no prose (fixed values).
_RTL_KEPT = r"\\\[.*?\\\]|\$[^$]*\$|\\(?:[Cc]ite(?:t|p|alp|author)?|(?:eq|auto|page)?ref|label|url|href)\s*\{[^}]*\}|\\[A-Za-z@]+\*?"
_RTL_NO_PROSE = r"\\(?:setlength|addtolength|newcommand|renewcommand|providecommand|def|let|Declare|usepackage|begin\{|end\{|includegraphics|bibitem|bibliography|AtBeginDocument)"
_RTL_BLOCKS = r"(?s)(?=\\begin\{(?:thebibliography|tabular|array|longtable|align|flalign|alignat|equation|gather|multline))|(?<=\\end\{(?:thebibliography|tabularx|tabular|array|longtable|align|flalign|alignat|equation|gather|multline|align\*|equation\*|gather\*)\})"


def wrapped_latin(line: Column) -> Column:
    """Latin words of a line in left-to-right groups; commands, formulas and references stay. One pass over the line's tokens."""
    tokens = F.regexp_extract_all(line, F.lit(f"(?s){_RTL_KEPT}|{_LATIN}|."), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^{_LATIN}$"), F.concat(F.lit("\\LR{"), t, F.lit("}"))).otherwise(t)), "")


def latin_in_rtl(t: Column) -> Column:
    """In the body of a right-to-left document Latin words are wrapped, line by line, outside tables, formulas and bibliographies."""
    head, body = _split_at(t, F.instr(t, "\\begin{document}"))
    plain = F.regexp_replace(F.substring(body, 17, 1 << 30), r"\\{1,2}[LR][LR]\{([^{}]*)\}", "$1")
    prose = lambda x: x.rlike(_RTL) & ~F.ltrim(x).startswith("%") & ~x.rlike(_RTL_NO_PROSE)
    lines = lambda part: F.array_join(F.transform(lines_of(part), lambda x: F.when(prose(x), wrapped_latin(x)).otherwise(x)), "\n")
    block = r"^\\begin\{(?:thebibliography|tabular|array|longtable|align|flalign|alignat|equation|gather|multline)"
    parts = F.transform(F.split(plain, _RTL_BLOCKS, -1), lambda part: F.when(part.rlike(block), part).otherwise(lines(part)))
    return F.when(t.rlike(_RTL) & t.contains("\\begin{document}"), F.concat(head, F.lit("\\begin{document}"), F.array_join(parts, ""))).otherwise(t)


#: A command's argument with two more levels of braces inside; what a right-to-left title keeps as it is (fixed patterns).
_ARGUMENT = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
_TITLE_KEPT = r"\\(?:texttt|url)\s*\{[^}]*\}|\\href\s*\{[^}]*\}\s*\{[^}]*\}|\$[^$]*\$|\\\[.*?\\\]|\\[A-Za-z@]+\*?"


def latin_in_title(t: Column) -> Column:
    """In the title and authors of a right-to-left document, before it begins, Latin words are wrapped; addresses, formulas and command names stay."""
    head, body = _split_at(t, F.instr(t, "\\begin{document}"))
    parts = F.regexp_extract_all(head, F.lit(rf"(?s)\\(?:title|author)\s*{_ARGUMENT}|[^\\]+|\\"), F.lit(0))
    tokens = lambda x: F.regexp_extract_all(x, F.lit(rf"(?s){_TITLE_KEPT}|{_LATIN}|."), F.lit(0))
    wrap = lambda x: F.array_join(F.transform(tokens(F.regexp_replace(x, r"\\(?:LR|RL)\{([^{}]*)\}", "$1")), lambda w: F.when(w.rlike(f"^{_LATIN}$"), F.concat(F.lit("\\LR{"), w, F.lit("}"))).otherwise(w)), "")
    done = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\\(?:title|author)\s*\{"), wrap(p)).otherwise(p)), "")
    return F.when(t.rlike(_RTL) & t.contains("\\begin{document}"), F.concat(done, body)).otherwise(t)


def joined_dollars(t: Column) -> Column:
    """Not in the chain: a space between two dollar signs goes. It joins neighbouring formulas, so it is for texts that have none."""
    return F.replace(t, F.lit("$ $"), F.lit("$$"))


def _supported(needle: str, block: str) -> Rule:
    return lambda t: F.when(t.contains(needle) | ~t.contains("\\begin{document}"), t).otherwise(X.insert_before_document(t, F.lit(block)))


#: Packages that wrapped and wide tables need, before the document, once.
tabularx_support = _supported("\\newcolumntype{Y}", "\\usepackage{tabularx}\n\\newcolumntype{Y}{>{\\raggedright\\arraybackslash}X}\n")
adjustbox_support = _supported("\\usepackage{adjustbox}", "\\usepackage{adjustbox}\n")


def thanks_layout(t: Column) -> Column:
    """Thanks in small print, and room for them on the title page: ten lines, more for long ones."""
    from foliospark.operators.structure import thanks_lines

    patch = "\\makeatletter\n\\let\\folio@thanks\\@thanks\n\\def\\@thanks{\\par\\begingroup\\scriptsize\\folio@thanks\\par\\endgroup}\n\\makeatother\n"
    begin = F.lit("\\begin{document}")
    at = F.instr(t, "\\begin{document}")
    small = F.when(t.contains("\\folio@thanks") | (at == 0), t).otherwise(F.concat(F.substring(t, F.lit(1), at - 1), begin, F.lit("\n" + patch), F.substring(t, at + 16, F.length(t))))
    near = small.rlike(r"\\maketitle\s*\n\s*\\enlargethispage\*?\{") | small.rlike(r"\\enlargethispage\*?\{[^}]+\}\s*\n\s*\\maketitle")
    room = F.concat(F.lit("\\maketitle\n\\enlargethispage*{"), F.greatest(thanks_lines(t), F.lit(10)).cast("string"), F.lit("\\baselineskip}"))
    title = F.instr(small, "\\maketitle")
    done = F.when(near, small).otherwise(F.concat(F.substring(small, F.lit(1), title - 1), room, F.substring(small, title + 10, F.length(small))))
    return F.when(t.contains("\\maketitle"), done).otherwise(t)


def rtl_stamp(t: Column) -> Column:
    """The stamp at the logical right edge, its text from left to right, and its call no comment."""
    return X.replaced(t, (r"\\AtPageLowerLeft", r"\\AtPageLowerRight"), (r"(?m)^(.*rotatebox.*) #1", r"$1 \\LR{#1}"), (r"(?m)^\s*%[% ]*(\\ArxivStamp\{)", "$1"))


def kept_preamble(translated: Column, original: Column) -> Column:
    """A translation that lost its class gets the original's preamble, up to the title or the document's begin."""
    title, begin = F.regexp_extract(original, r"(?s)^(.*?)\\title\s*\{", 1), F.regexp_extract(original, r"(?s)^(.*?)\\begin\s*\{document\}", 1)
    preamble = F.when(original.rlike(r"\\title\s*\{"), title).otherwise(begin)
    return F.when(translated.contains("\\documentclass"), translated).otherwise(F.concat(preamble, translated))


def cyrillic_support(t: Column) -> Column:
    """Packages for Cyrillic text after the class, as far as none of their kind is there, a harmless double quote, and UTF-8 listings."""
    wanted = F.concat_ws(
        "\n", F.when(t.contains("\\usepackage{cmap}"), None).otherwise("\\usepackage{cmap}"), F.when(t.rlike(r"\\usepackage.*?\{fontenc\}"), None).otherwise("\\usepackage[T2A]{fontenc}"),
        F.when(t.rlike(r"\\usepackage.*?\{babel\}"), None).otherwise("\\usepackage[russian]{babel}"),
    )
    named = F.regexp_extract(t, r"(\\documentclass(?:\[.*?\])?\{.*?\})", 1)
    at = F.instr(t, named) + F.length(named)
    added = F.when(wanted == "", t).otherwise(F.concat(F.substring(t, F.lit(1), at - 1), F.lit("\n"), wanted, F.lit("\n"), F.substring(t, at, F.length(t))))
    quoted = F.when(t.contains('\\shorthandoff{"}'), F.lit("")).otherwise(F.lit('\\AtBeginDocument{\\ifdefined\\shorthandoff\\shorthandoff{"}\\fi}\n'))
    lists = t.rlike(r"\\usepackage(?:\[[^\]]*\])?\{listings\}|\\tcbuselibrary\{listings\}|\\begin\{lstlisting\}|\\lstset\s*\{|\\lstinputlisting\b")
    utf8 = F.when(lists & ~t.contains("\\usepackage{listingsutf8}"), F.lit("\\usepackage{listingsutf8}\n")).otherwise("")
    encoding = F.when(lists & ~t.contains("inputencoding=utf8"), F.lit("\\lstset{inputencoding=utf8,extendedchars=true}\n")).otherwise("")
    extra = F.concat(quoted, utf8, encoding)
    done = F.when(extra == "", added).otherwise(X.insert_before_document(added, extra))
    return F.when(T.has_cyrillic(t) & (named != ""), done).otherwise(t)


def stamped(t: Column, stamp: Column) -> Column:
    """The page stamp's packages, macro and call before the document, each once."""
    macro = "\\newcommand{\\ArxivStamp}[1]{\\AddToShipoutPictureBG*{\\AtPageLowerLeft{\\put(28,0){\\raisebox{0.5\\paperheight}{\\makebox(0,0){\\rotatebox{90}{\\rmfamily\\huge\\color{gray} #1}}}}}}}"
    call = F.concat(F.lit("\\ArxivStamp{"), stamp, F.lit("}"))
    absent = lambda needle, what: F.when(t.contains(needle), None).otherwise(what)
    block = F.concat_ws("\n", absent("\\usepackage{eso-pic}", "\\usepackage{eso-pic}"), absent("\\usepackage{xcolor}", "\\usepackage{xcolor}"), absent("\\ArxivStamp", F.lit(macro)), F.when(t.contains(call), None).otherwise(call))
    return F.when(F.coalesce(stamp, F.lit("")).eqNullSafe("") | (block == ""), t).otherwise(X.insert_before_document(t, F.concat(block, F.lit("\n"))))


#: What a text must hold for a rule to change it: searching for that is much cheaper than the rule's patterns.
NEEDLES = {
    "closing_signs": ("\\usepackage{", "\\begin{", "\\end{"), "stray_class_lines": ("\\documentclass",), "times_font": ("T2A",), "babel_options": ("\\documentclass", "{babel}"), "redefined_commands": ("\\newcommand",), "section_fonts": ("sectsty",), "cjk_package": ("CJK",), "leftover_tokens": ("<<",), "minted": ("minted",),
    "floats": ("{figure", "{table", "includegraphics", "{Figure", "{Table"), "column_graphics": ("textwidth",), "broken_graphics": ("\\1",), "broken_commands": ("\\ ", "head", "foot"),
    "typos": ("e.g.", "i.e.", *PACKAGE_TYPOS), "abstract_name": ("abstract",), "abstract_page": ("abstract}",), "orphan_bibliography": ("thebibliography",),
    "no_bibliography": ("nobibliography",), "last_end": ("\\end{document}",), "acm_countries": ("acmart",), "acm_title": ("acmart",), "acm_lines": ("acmart",), "package_order": ("fontenc",), "rtl_stamp": ("ArxivStamp",), "thanks_layout": ("\\maketitle",),
}


def gated(name: str, rule: Rule) -> Rule:
    needles = NEEDLES.get(name)
    return rule if not needles else lambda t: F.when(reduce(lambda a, b: a | b, [t.contains(n) for n in needles]), rule(t)).otherwise(t)


def chain(lang: str = "ru") -> list[tuple[str, Rule]]:
    """The rules in order for a target language."""
    rules: list[tuple[str, Rule]] = [
        ("closing_signs", closing_signs), ("single_packages", single_packages), ("stray_class_lines", stray_class_lines), ("redefined_commands", redefined_commands),
        ("font_encoding", font_encoding), ("times_font", times_font), ("bilingual_paragraphs", bilingual_paragraphs), ("bilingual_lines", bilingual_lines), ("thanks_layout", thanks_layout),
        ("acm_title", acm_title), ("acm_countries", acm_countries), ("acm_lines", acm_lines), ("package_order", package_order), ("babel_options", babel_options),
        ("section_fonts", section_fonts), ("cjk_package", cjk_package), ("leftover_tokens", without_leftovers), ("minted", minted), ("floats", floats),
        ("column_graphics", column_graphics), ("broken_graphics", broken_graphics), ("latin_macro", latin_macro), ("broken_commands", broken_commands), ("typos", typos),
        ("abstract_name", abstract_name(lang)), ("abstract_page", abstract_page), ("orphan_bibliography", orphan_bibliography),
        ("ragged_bibliography", ragged_bibliography), ("no_bibliography", no_bibliography), ("combining_marks", combining_marks),
    ]
    if lang in ("ar", "he"):
        rules += [("rtl_stamp", rtl_stamp), ("latin_in_title", latin_in_title), ("latin_in_rtl", latin_in_rtl)]
    if lang in ("ja", "jp", "jpn"):
        rules.append(("line_spacing", line_spacing))
    return [(name, gated(name, rule)) for name, rule in (*rules, ("last_end", last_end))]


def rewritten(df: DataFrame, column: str, lang: str = "ru", rules: list[tuple[str, Rule]] | None = None) -> DataFrame:
    """df with `column` sent through the rules; one projection a rule, so no expression is doubled inside the next."""
    for _, rule in chain(lang) if rules is None else rules:
        df = df.withColumn(column, rule(F.col(column)))
    return df
