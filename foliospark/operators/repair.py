"""Error-driven repair: which rules a run's errors call for, in order, and what the rules do to the text.

A rule is asked for by error lines that hold all needles of one of its groups (and, for some, by the text itself). Every
edit is Column -> Column and changes nothing the second time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.operators import rewrite

Edit = Callable[[Column], Column]
CLASS_LINE = r"(?m)^[ \t]*\\documentclass(?:\[[^\]]*\])?\{[^}]+\}.*$"


def _lines(t: Column, edit: Callable[[Column], Column]) -> Column:
    """Each line that is no comment, edited."""
    return F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.when(F.ltrim(x).startswith("%"), x).otherwise(edit(x))), "\n")


def inputenc_utf8(t: Column) -> Column:
    return F.regexp_replace(t, r"(?i)\\usepackage\[(?![^\]]*utf8)\s*[^\]\s][^\]]*\]\{inputenc\}", r"\\usepackage[utf8]{inputenc}")


#: What stands in for letters that an encoding lacks (fixed values).
EMPTY_ETH = "\\providecommand{\\DH}{}\n\\renewcommand{\\DH}{DH}\n\\providecommand{\\dh}{}\n\\renewcommand{\\dh}{dh}\n"
PLAIN_ETH = "\\providecommand{\\DH}{DH}\n\\providecommand{\\dh}{dh}\n\\renewcommand{\\DH}{DH}\n\\renewcommand{\\dh}{dh}\n"


def eth_letters(t: Column) -> Column:
    return F.when(t.contains(EMPTY_ETH), t).otherwise(X.insert_before_document(t, F.lit(EMPTY_ETH)))


def _after_class(t: Column, block: Column) -> Column:
    """block, which ends in a line feed, on lines of its own after the class line; nothing without one."""
    line = F.regexp_extract(t, f"({CLASS_LINE})", 1)
    at = F.instr(t, line) + F.length(line)
    rest = F.substring(t, at + 1, F.length(t))
    return F.when(line == "", t).otherwise(F.concat(F.substring(t, F.lit(1), at - 1), F.lit("\n"), F.rtrim(block, F.lit("\n")), F.when(F.substring(t, at, F.lit(1)) == "\n", F.concat(F.lit("\n"), rest)).otherwise(F.lit(""))))


def eth_letters_in_old_encoding(t: Column) -> Column:
    return F.when(t.contains(PLAIN_ETH), t).otherwise(_after_class(t, F.lit(PLAIN_ETH)))


def node_labels(t: Column) -> Column:
    return _lines(t, lambda x: F.regexp_replace(x, r"\\1\s*;", "{};"))


def stray_placeholders(t: Column) -> Column:
    return _lines(t, lambda x: F.when(x.rlike(r"^\s*\\1\s*$"), F.lit("\\relax")).otherwise(x))


def doubled_brace_in_index(t: Column) -> Column:
    return F.regexp_replace(t, r"\$_\{([^}]+)\}\}\$", r"\$_{$1}\$")


def open_headings(t: Column) -> Column:
    """Heading and caption lines that open more braces than they close get the missing ones."""
    head = r"^\s*\\(section|subsection|subsubsection|caption)\b"
    return _lines(t, lambda x: F.when(x.rlike(head) & (X.brace_delta(x) > 0), F.concat(x, F.repeat(F.lit("}"), X.brace_delta(x).cast("int")))).otherwise(x))


def _package(name: str) -> Edit:
    line = f"\\usepackage{{{name}}}"
    return lambda t: F.when(t.contains(line), t).otherwise(X.insert_before_document(t, F.lit(line + "\n")))


def cyrillic_setup(t: Column) -> Column:
    """Russian for babel before the class, inputenc and babel after it, as far as they are absent."""
    loaded = lambda name: F.exists(F.split(t, "\n", -1), lambda x: ~F.ltrim(x).startswith("%") & x.rlike(r"\\(usepackage|RequirePackage)") & x.contains(f"{{{name}}}"))
    passed = "\\PassOptionsToPackage{russian}{babel}"
    block = F.concat(F.when(loaded("inputenc"), F.lit("")).otherwise(F.lit("\\usepackage[utf8]{inputenc}\n")), F.when(loaded("babel"), F.lit("")).otherwise(F.lit("\\usepackage[russian]{babel}\n")))
    after = F.when(block == "", t).otherwise(_after_class(t, block))
    at = F.instr(after, F.regexp_extract(after, f"({CLASS_LINE})", 1))
    early = F.substring(after, F.lit(1), at - 1).contains(passed)
    return F.when(~t.rlike(CLASS_LINE), t).otherwise(F.when(early, after).otherwise(F.concat(F.substring(after, F.lit(1), at - 1), F.lit(passed + "\n"), F.substring(after, at, F.length(after)))))


def class_words(t: Column) -> Column:
    """Lines that mention the class command without braces become comments, wherever they stand."""
    return _lines(t, lambda x: F.when(x.contains("\\documentclass") & ~x.contains("{"), F.regexp_replace(x, r"^(\s*)", "$1% ")).otherwise(x))


def packages_after_class(t: Column) -> Column:
    """Package lines that stand before the class move behind it, in order."""
    line = F.regexp_extract(t, f"({CLASS_LINE})", 1)
    at = F.instr(t, line)
    is_package = lambda x: ~F.ltrim(x).startswith("%") & x.rlike(r"^\s*\\(usepackage|RequirePackage)(\[[^\]]*\])?\{[^}]+\}")
    head = F.split(F.substring(t, F.lit(1), at - 2), "\n", -1)
    moved = F.filter(head, is_package)
    stay = F.filter(head, lambda x: ~is_package(x))
    rest = F.substring(t, at + F.length(line), F.length(t))
    done = F.concat(F.array_join(F.concat(stay, F.array(line), moved), "\n"), rest)
    return F.when((line == "") | (at <= 1) | (F.size(moved) == 0), t).otherwise(done)


def without_hyperxmp(t: Column) -> Column:
    return F.regexp_replace(t, r"(?i)(?<!% )\\(usepackage|RequirePackage)(\[[^\]]*\])?\{hyperxmp\}", r"% \\$1$2{hyperxmp}")


@dataclass(frozen=True)
class Repair:
    """Its number in order, groups of needles (an error that holds all of one group asks for it), what the text must hold, and its edit."""

    number: int
    asked: tuple[tuple[str, ...], ...]
    holds: str | None = None
    edit: Edit | None = None


#: What TeX prints and what it calls for (fixed values, in order); rules without an edit are diagnosed only.
REPAIRS = (
    Repair(1, (("Command", "already defined"),)),
    Repair(2, (("Option clash for package babel",),), None, rewrite.babel_options),
    Repair(3, (("Package inputenc Error: Keyboard character used is undefined",),), None, inputenc_utf8),
    Repair(4, (("unavailable in encoding T1",),), None, rewrite.font_encoding),
    Repair(5, (("Command \\DH unavailable in encoding",),), None, eth_letters),
    Repair(6, (("sectsty", "doesn't work"), ("sectsty", "rror")), None, rewrite.section_fonts),
    Repair(7, (("\\inserted", "undefined"), ("\\moved", "undefined"), ("\\modified", "undefined"))),
    Repair(8, (("Package tikz Error: Sorry, the system call",),)),
    Repair(9, (("A node must have a",),), None, node_labels),
    Repair(10, (("Undefined control sequence",),), r"(?m)^\s*\\1\b", stray_placeholders),
    Repair(11, (("Extra }, or forgotten $",), ("Missing } inserted",)), None, doubled_brace_in_index),
    Repair(12, (("Runaway argument",), ("\\@xdblarg",)), None, open_headings),
    Repair(13, (("File ˋfig1' not found",), ("fig1.png", "not found"))),
    Repair(14, (("\\end{IEEEbiography}",),)),
    Repair(15, (("ended by \\end{tikzpicture}",),)),
    Repair(16, (("Package pgfplots Error: Could not read table file",), ("TeX capacity exceeded",))),
    Repair(17, (("end{tikzpicture}",),)),
    Repair(18, (("Environment equation* undefined",),), None, _package("amsmath")),
    Repair(19, (("Undefined control sequence",),), "includegraphics", _package("graphicx")),
    Repair(20, (("Undefined control sequence",),), "CJK", rewrite.cjk_package),
    Repair(21, (("Unicode character",),), None, cyrillic_setup),
    Repair(22, (("c.cls",),), None, class_words),
    Repair(23, (("\\usepackage before \\documentclass",),), None, packages_after_class),
    Repair(24, (("hyperxmp Error", "hyperref must be loaded before hyperxmp"),), None, without_hyperxmp),
    Repair(25, (("Command \\DH unavailable in encoding OT1",), ("Command \\dh unavailable in encoding OT1",)), None, eth_letters_in_old_encoding),
    Repair(26, (("@iiiparbox",), ("caption@xdblarg",))),
    Repair(27, (("begin{tikzpicture}", "ended by \\end{figure}"),)),
    Repair(28, (("begin{thebibliography}", "ended by \\end{document"),)),
    Repair(29, (("Package tikz Error", "system call"),)),
    Repair(30, (("! LaTeX Error: File", "not found"),)),
    Repair(31, (("Invalid UTF-8 byte sequence", "lst@EC"),)),
    Repair(32, (("Extra \\or.",),)),
    Repair(33, (("\\begin{tabular}", "ended by \\end{tabularx}"), ("\\begin{tabular}", "ended by \\end{adjustbox}"))),
    Repair(34, (("Paragraph ended before \\title was complete",),)),
    Repair(35, (("Paragraph ended before \\@textcolor was complete",), ("Too many }",))),
    Repair(36, (("There's no line here to end",), ("Missing \\begin{document}",), ("macro parameter character #",))),
    Repair(37, (("Runaway argument",), ("\\@argdef",))),
    Repair(38, (("pgfkeys@@qset",),)),
    Repair(39, (("Missing } inserted",),), r"\\begin\{wraptable"),
    Repair(40, (("Package titletoc Error", "No partial toc named"),)),
    Repair(41, (("__tcobox_new_tcolorbox:w",),)),
    Repair(42, (("Too many }",),)),
    Repair(43, (("\\Gscale@box@dd",), ("Division by 0",))),
    Repair(44, (("no legal \\end found",), ("Emergency stop",))),
    Repair(45, (("\\begin{table}", "ended by \\end{document}"), ("internal vertical mode",), ("\\Gscale@box@dd",), ("Division by 0",))),
    Repair(46, (("\\unskip",), ("\\@iiiparbox",))),
    Repair(47, (("Extra }, or forgotten \\endgroup",),)),
    Repair(48, (("\\begin{document} ended by \\end{definition}",),)),
    Repair(49, (("Too many }",), ("Extra }, or forgotten \\endgroup",), ("Paragraph ended before \\@textcolor was complete",), ("endabstract",)), r"(?s)\\begin\{abstract\}.*\\end\{abstract\}"),
    Repair(50, (("Too many }",), ("Extra }, or forgotten \\endgroup",))),
    Repair(51, (("Package graphics Error: Division by 0",),)),
    Repair(52, (("Lonely \\item",), ("\\begin{document} ended by \\end{enumerate}",), ("\\begin{document} ended by \\end{itemize}",))),
    Repair(53, (("Package enumitem Error: Misplaced \\item.",), ("Something's wrong--perhaps a missing \\item",))),
    Repair(54, (("begin{tabular}", "end{adjustbox}"),)),
)


def _asked(rule: Repair, errors: Column, tex: Column) -> Column:
    said = F.exists(errors, lambda e: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [e.contains(n) for n in group]) for group in rule.asked]))
    return said & tex.rlike(rule.holds) if rule.holds else said


def asked_rules(errors: Column, tex: Column) -> Column:
    """Numbers of the rules that array `errors` and the text call for, in order: one pass over a narrow array."""
    return F.filter(F.array(*[F.when(_asked(r, errors, tex), F.lit(r.number)) for r in REPAIRS]), lambda n: n.isNotNull())


def defined_twice(t: Column, errors: Column) -> Column:
    """Commands that the errors call already defined are defined again (renewcommand); their names come from the errors."""
    found = F.filter(F.array_distinct(F.transform(errors, lambda e: F.regexp_extract(e, r"Command \\(\w+) already defined", 1))), lambda n: n != "")
    once = lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"\\newcommand(\*?)\{\\"), n, F.lit(r"\}")), F.concat(F.lit(r"\\renewcommand$1{\\"), n, F.lit("}")))
    return F.aggregate(found, t, once)


def repaired(df: DataFrame, tex: str, errors: str) -> DataFrame:
    """df with `rules`, the numbers that its errors (array<string>) call for, and `tex` after the edits of these, in order.

    One projection a rule, each behind its own test, so a text without errors is not searched.
    """
    out = df.withColumn("rules", asked_rules(F.col(errors), F.col(tex)))
    out = out.withColumn(tex, F.when(F.array_contains("rules", 1), defined_twice(F.col(tex), F.col(errors))).otherwise(F.col(tex)))
    for rule in REPAIRS:
        if rule.edit:
            out = out.withColumn(tex, F.when(F.array_contains("rules", rule.number), rule.edit(F.col(tex))).otherwise(F.col(tex)))
    return out
