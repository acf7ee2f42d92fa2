"""Column functions on LaTeX source. Each chain is one expression; Catalyst keeps it in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T

HEADINGS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph"
TOKEN = r"<<[A-Z_]+_\d+>>"


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular expressions replaced one after another."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


#: What counts as mathematics in prose, in order (fixed patterns).
_MATH = [(r"(?s)\$\$.*?\$\$", " "), (r"\$[^$]*\$", " "), (r"(?s)\\\[.*?\\\]", " "), (r"(?s)\\begin\{equation\*?\}.*?\\end\{equation\*?\}", " "), (r"(?s)\\begin\{align\*?\}.*?\\end\{align\*?\}", " ")]


def prose_for_validation(tex: Column) -> Column:
    """Comments, mathematics and command names go; arguments stay."""
    return T.squeezed(replaced(tex, (r"(?d)%.*", " "), *_MATH, (r"\\[a-zA-Z]+\*?", " "), (r"[{}\[\]]", " ")))


def prose_for_repair(tex: Column) -> Column:
    """Tokens, comments, commands with their arguments (but for title, author, thanks) and mathematics go."""
    command = r"\\(?!author\b|title\b|thanks\b)[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})*"
    return T.squeezed(replaced(tex, (TOKEN, ""), (r"(?d)%.*", ""), (command, " "), *_MATH, (r"[{}\\$%&]", " ")))


def prose_for_chunks(tex: Column) -> Column:
    """Tokens, commands with their arguments and special characters go; white space stays."""
    return T.stripped(replaced(tex, (TOKEN, ""), (r"\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})*", ""), (r"[{}\\$%&]", "")))


def cell_prose(cell: Column) -> Column:
    return T.squeezed(replaced(cell, (r"\$[^$]*\$", ""), (r"\\[a-zA-Z*]+(?:\[[^\]]*\])?(?:\{[^{}]*\})?", ""), (r"[{}]", " ")))


def without_comments(tex: Column) -> Column:
    """Lines up to their first unescaped percent sign."""
    return F.regexp_replace(tex, r"(?md)(?<!\\)%.*$", "")


def comment_count(tex: Column) -> Column:
    return F.regexp_count(tex, F.lit(r"(?md)(?<!\\)%.*$"))


def heading_titles(tex: Column) -> Column:
    return F.array_join(F.regexp_extract_all(tex, F.lit(rf"\\(?:{HEADINGS})\*?\{{([^}}]*)\}}"), F.lit(1)), "\n")


def braces_balanced(tex: Column) -> Column:
    """Depth never below zero, and zero at the end; escapes do not count."""
    marks = F.split(F.regexp_replace(tex, r"[^{}]", ""), "")
    depth = F.aggregate(
        F.filter(marks, lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda acc, c: F.struct((acc["now"] + F.when(c == "{", 1).otherwise(-1)).alias("now"), F.least(acc["least"], acc["now"] + F.when(c == "{", 1).otherwise(-1)).alias("least")),
    )
    return (depth["now"] == 0) & (depth["least"] >= 0)


def brace_delta(line: Column) -> Column:
    head = F.regexp_replace(line, r"(?d)(?<!\\)%.*", "")
    return F.regexp_count(head, F.lit(r"\{")) - F.regexp_count(head, F.lit(r"\}"))


def document_class(tex: Column) -> Column:
    return F.lower(F.regexp_extract(tex, r"\\documentclass(?:\[[^\]]*\])?\{([^}]+)\}", 1))


def packages(tex: Column) -> Column:
    """Names of used packages in order, repeats kept."""
    lists = F.regexp_extract_all(tex, F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"), F.lit(1))
    return F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x))


def insert_before_document(tex: Column, snippet: Column) -> Column:
    at = F.instr(tex, "\\begin{document}")
    return F.when(at > 0, F.concat(F.substring(tex, F.lit(1), at - 1), snippet, F.substring(tex, at, F.length(tex)))).otherwise(F.concat(tex, F.lit("\n"), snippet))


def escaped(text: Column) -> Column:
    """Plain text as LaTeX: backslashes first, then the other special characters."""
    out = F.replace(text, F.lit("\\"), F.lit("\u0001"))
    for c in "&%$#_{}":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    for c, name in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\u0001", "\\textbackslash{}")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def untranslated_heading(title: Column) -> Column:
    """A known English section name, or for Russian four ASCII letters and no Cyrillic."""
    t = F.trim(F.regexp_replace(F.lower(T.squeezed(title)), r"(?U)^[\d\W_]+", ""))
    names = ("abstract", "introduction", "background", "methods", "materials and methods", "method", "results", "discussion", "conclusion", "conclusions", "related work", "experiments", "acknowledgements", "acknowledgments", "references", "appendix")
    return F.when(t == "", F.lit(False)).otherwise(t.isin(*names) | ((F.regexp_count(t, F.lit("[A-Za-z]")) >= 4) & ~T.has_cyrillic(t)))


def anchors(text: Column) -> Column:
    """The set of commands, inline mathematics and numbers that a translation keeps."""
    # Fixed patterns.
    patterns = (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", r"\$[^$]*\$", r"\b\d+(?:\.\d+)?\b")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def table_rows(body: Column) -> Column:
    """Rows of cells: comments and rules go, rows end at unescaped double backslashes, cells at ampersands."""
    rows = F.split(without_comments(body), r"(?<!\\)\\\\", -1)
    clean = F.filter(F.transform(rows, lambda r: T.stripped(F.replace(r, F.lit("\\hline"), F.lit("")))), lambda r: r != "")
    return F.transform(clean, lambda r: F.transform(F.split(r, "&", -1), T.stripped))


def wide_table(spec: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(spec, r"@\{[^}]*\}", ""), "[^lcr]", "")) >= 6


def without_command(tex: Column, prefix: str) -> Column:
    """tex without commands whose names begin with `prefix` and their argument (braces in it up to three deep)."""
    return F.regexp_replace(tex, rf"\\{prefix}[A-Za-z]*\*?\s*\{{(?:[^{{}}\\]++|\\.|\{{(?:[^{{}}\\]++|\\.|\{{[^{{}}]*+\}})*+\}})*+\}}", "")


def wraps_pdf(tex: Column) -> Column:
    """Whether a document only includes a PDF, so that there is nothing to translate."""
    return tex.contains("pdfpages") & tex.contains("includepdf")


def special_command(name: Column, commands: Column, used: Column) -> Column:
    """Whether a command is one of `commands` or its name begins with or holds the name of a package in `used`."""
    return F.array_contains(commands, name) | F.exists(used, lambda p: name.contains(p))


#: Kinds of chunks that are translated and checked (fixed values).
TRANSLATABLE = ("intro", "section", "subsection", "paragraph")


def translatable(kind: Column) -> Column:
    return kind.isin(*TRANSLATABLE)


def full_command(line: Column) -> Column:
    """The first command of a line with one optional and all required arguments (braces up to two deep)."""
    return F.regexp_extract(line, r"(\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{(?:[^{}]++|\{[^{}]*+\})*+\})*)", 1)
