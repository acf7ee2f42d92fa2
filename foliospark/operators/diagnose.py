"""Typesetting logs: failures, warnings, errors to repair, the next step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T

#: Categories by pattern, in order (fixed values).
LOG_ERRORS = (
    ("missing_file", r"LaTeX Error: File `[^']+' not found"), ("missing_package", r"! LaTeX Error: File `[^']+\.sty' not found"),
    ("bibtex_error", r"I couldn't open database file"), ("bibtex_error", r"BibTeX.*error"), ("runaway_argument", r"Runaway argument\?"),
    ("emergency_stop", r"! Emergency stop\.?"), ("undefined_control_sequence", r"Undefined control sequence\.?"),
)
#: Marks in logs by what they ask for (fixed values).
UNRESOLVED = ("There were undefined references", "Rerun to get cross-references right")
BIBER = ("please (re)run biber", "run biber")
RERUN = ("There were undefined references", "Rerun to get cross-references right", "Label(s) may have changed", "Rerun LaTeX")
FATAL = ("Fatal error occurred", "no output PDF file produced", "job aborted", "no legal \\end found", "! Emergency stop")
KEY_ERRORS = ("Unicode character", "\\usepackage before \\documentclass", "c.cls")


def _some(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def any_of(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def failures(log: Column) -> Column:
    """Reasons to fail, in order: a missing file by its kind or the first error, then categories."""
    name = F.trim(F.regexp_extract(log, r"! LaTeX Error: File `([^']+)' not found", 1))
    kind = F.when(F.lower(name).endswith(".sty"), "missing_package: ").when(F.lower(name).endswith(".cls"), "missing_class: ").otherwise("missing_file: ")
    first = F.when(name != "", F.concat(kind, name)).when(log.contains("! LaTeX Error:"), F.concat(F.lit("latex_error: "), F.trim(F.regexp_extract(log, r"(?d)(! LaTeX Error:.*)", 1))))
    return _some(first, *[F.when(log.rlike("(?d)" + p), F.lit(f"log_category: {c}")) for c, p in LOG_ERRORS])


def warnings(log: Column) -> Column:
    low = F.lower(log)
    over, under = (F.regexp_count(log, F.lit(rf"{w} \\hbox")) for w in ("Overfull", "Underfull"))
    return _some(
        F.when(log.contains("Compilation timed out"), "pdflatex_timeout"), F.when(log.contains("Citation") & log.contains("undefined"), "undefined_citations"),
        F.when(log.contains("Reference") & log.contains("undefined"), "undefined_references"), *[F.when(log.contains(m), F.lit(f"rerun_marker: {m}")) for m in UNRESOLVED],
        F.when(low.contains("biblatex") & any_of(low, BIBER), "biblatex_biber_marker"), F.when(log.rlike(r"No file [^\s]+\.bbl\.?"), "missing_bbl"),
        F.when(over > 0, F.concat(F.lit("overfull_hbox="), over.cast("string"))), F.when(under > 0, F.concat(F.lit("underfull_hbox="), under.cast("string"))),
    )


def tex_issues(tex: Column) -> Column:
    """Left tokens, doubled question marks outside comments and side notes, headings in ASCII only (three at most)."""
    notes = r"\\sidenote[a-zA-Z]*\s*\{(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\})*\}"
    plain = F.regexp_replace(X.without_comments(tex), notes, "")
    titles = F.regexp_extract_all(tex, F.lit(rf"\\(?:{X.HEADINGS})\*?\{{([^}}]*)\}}"), F.lit(1))
    bad = F.filter(titles, lambda t: F.lower(T.squeezed(t)).rlike(r"^[a-z0-9 .,:;\-]+$") & F.lower(t).rlike("[a-z]"))
    listed = F.concat(F.lit("untranslated_headings: ['"), F.array_join(F.slice(bad, 1, 3), "', '"), F.lit("']"))
    return _some(F.when(tex.rlike(X.TOKEN), "unrestored_tokens"), F.when(plain.contains("??"), "double_question_marks_in_tex"), F.when(F.size(bad) > 0, listed))


def verdict(log_reasons: Column, log: Column, has_pdf: Column) -> Column:
    """struct<reasons, warnings>: with a PDF and no fatal marker all but missing packages and classes are warnings."""
    demote = has_pdf & ~any_of(log, FATAL)
    hard = lambda r: r.startswith("missing_package:") | r.startswith("missing_class:")
    none = F.array().cast("array<string>")
    kept = F.when(demote, F.filter(log_reasons, hard)).otherwise(log_reasons)
    soft = F.when(demote, F.transform(F.filter(log_reasons, lambda r: ~hard(r)), lambda r: F.concat(F.lit("nonfatal_"), r))).otherwise(none)
    return F.struct(kept.alias("reasons"), soft.alias("warnings"))


def errors(log: Column, most: int = 25) -> Column:
    """Lines that start with an exclamation mark, once each; of more than twice `most` the key ones, the first and the last."""
    found = F.filter(F.split(log, "\n", -1), lambda x: x.startswith("!"))
    trimmed = F.concat(F.filter(found, lambda x: any_of(x, KEY_ERRORS)), F.slice(found, 1, most), F.slice(found, -most, most))
    return F.array_distinct(F.when(F.size(found) <= 2 * most, found).otherwise(trimmed))


def needs_rerun(log: Column) -> Column:
    cited = log.rlike(r"(?d)Citation [`'][^`']+[`'] on page .* undefined")
    warned = log.contains("LaTeX Warning:") & log.contains("undefined") & (log.contains("Citation") | log.contains("Reference"))
    return any_of(log, RERUN) | cited | warned


def needs_bibtex(aux: Column) -> Column:
    return aux.contains("\\bibdata") | aux.contains("\\bibstyle")


def unicode_error(log: Column) -> Column:
    return log.contains("LaTeX Error") & log.contains("Unicode character")


def table_errors(found: Column) -> Column:
    """Whether the errors speak of a broken table."""
    joined = F.array_join(found, "\n")
    return joined.contains("\\begin{tabular}") & any_of(joined, ("Misplaced \\noalign", "Extra alignment tab", "Missing } inserted", "Misplaced alignment tab"))


#: Marks of a failed run in the second engine's log (fixed values).
TYPST_FAILURES = ("error:", "unclosed delimiter", "failed")


def typst_check(log: Column) -> Column:
    """struct<reasons, warnings> of the second engine's log: its first failure mark unless it returned 0, and another return code."""
    low = F.lower(log)
    fine = low.contains("returncode: 0")
    mark, code = F.lit(None).cast("string"), F.regexp_extract(low, r"returncode:\s*(\d+)", 1)
    for m in reversed(TYPST_FAILURES):
        mark = F.when(low.contains(m), F.lit(f"typst_log_marker: {m}")).otherwise(mark)
    absent = F.trim(F.coalesce(log, F.lit(""))) == ""
    reasons = _some(F.when(~fine, mark), F.when(~fine & ~code.isin("", "0"), F.concat(F.lit("typst_returncode="), code)))
    none = F.array().cast("array<string>")
    return F.struct(F.when(absent, none).otherwise(reasons).alias("reasons"), F.when(absent, F.array(F.lit("missing_typst_log"))).otherwise(none).alias("warnings"))


def error_context(log: Column, after: int = 2) -> Column:
    """The first error line of a log with the lines after it."""
    lines = F.split(log, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: x.startswith("!")), True)
    return F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.lit(after + 1)), "\n"))
