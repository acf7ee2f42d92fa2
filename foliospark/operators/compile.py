"""What a compile run decides from texts: engine, preamble, bibliography tool, what may be deleted afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import text as T

#: What only XeTeX and LuaTeX read, engines in the order in which they are tried, and what a run leaves behind (fixed values).
XETEX_NEEDLES = ("\\usepackage{fontspec}", "\\setmainfont", "\\usepackage{xeCJK}", "\\XeTeXlinebreaklocale")
ENGINES = ("pdflatex", "xelatex", "lualatex")
LEFT_BEHIND = (".tex", ".aux", ".log", ".out", ".pdf", ".bbl", ".blg", ".bcf", ".run.xml", ".synctex.gz")
#: Scripts by code points (fixed values).
SCRIPTS = {
    "kana": "\u3040-\u30ff\u31f0-\u31ff", "hangul": "\u1100-\u11ff\u3130-\u318f\uac00-\ud7af", "han": "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff",
    "arabic": "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff", "hebrew": "\u0590-\u05ff\ufb1d-\ufb4f",
}
#: Fonts by script in the order in which they are sought (fixed values).
LATIN_FONTS = ("Times New Roman", "TeX Gyre Termes", "STIX Two Text", "Libertinus Serif", "DejaVu Serif", "FreeSerif")
CJK_FONTS = {
    "ja": ("Hiragino Mincho ProN", "Noto Serif CJK JP", "IPAexMincho", "FandolSong-Regular"),
    "ko": ("Apple SD Gothic Neo", "Noto Sans CJK KR", "UnBatang", "FandolSong-Regular"),
    "zh": ("PingFang SC", "Noto Serif CJK SC", "FandolSong-Regular"),
}
RTL_FONTS = {
    "arabic": ("Amiri", "Scheherazade New", "Noto Naskh Arabic", "Geeza Pro", "Arial Unicode MS", "Times New Roman", "DejaVu Serif", "FreeSerif"),
    "hebrew": ("Arial Hebrew", "Ezra SIL", "SBL Hebrew", "Arial Unicode MS", "Times New Roman", "DejaVu Serif", "FreeSerif"),
}


def requires_xetex(name: Column, tex: Column) -> Column:
    """Whether a file's name or its text asks for a Unicode engine."""
    return F.lower(name).contains("unicode") | reduce(lambda a, b: a | b, [tex.contains(n) for n in XETEX_NEEDLES])


def engine(forced: Column) -> Column:
    """The engine that a setting forces, else the first."""
    given = F.lower(F.trim(F.coalesce(forced, F.lit(""))))
    return F.when(given == "", F.lit(ENGINES[0])).otherwise(given)


def next_engine(current: Column) -> Column:
    """The engine to try after a failure; null after the last."""
    out = F.lit(None).cast("string")
    for a, b in zip(ENGINES, ENGINES[1:]):
        out = F.when(current == a, b).otherwise(out)
    return out


def needs_biber(has_bcf: Column, log: Column) -> Column:
    """Whether biber is to run: its control file is there, or the log speaks of biblatex and biber."""
    low = F.lower(F.coalesce(log, F.lit("")))
    return has_bcf | (low.contains("biblatex") & low.contains("biber"))


def bibliography_tool(aux: Column, has_bcf: Column, log: Column) -> Column:
    """biber, bibtex or none."""
    return F.when(needs_biber(has_bcf, log), "biber").when(aux.contains("\\bibdata") | aux.contains("\\bibstyle"), "bibtex")


def left_behind(file: Column, stem: str) -> Column:
    """Whether a file is a temporary one of repaired sources: {stem}_fixed_* with an ending that a run leaves."""
    ending = "|".join(e.replace(".", r"\.") for e in LEFT_BEHIND)
    return file.rlike(rf"^\Q{stem}\E_fixed_[^/]*({ending})$")


def _first_font(fonts: tuple[str, ...], command: str) -> str:
    """The command with the first font that the system has; nothing where it has none."""
    return reduce(lambda rest, font: f"\\IfFontExistsTF{{{font}}}{{{command}{{{font}}}}}{{{rest}}}", reversed(fonts), "")


def _commented(t: Column, *packages: str) -> Column:
    return F.regexp_replace(t, rf"(?mi)^([ \t]*)(?![ \t%])(.*\\usepackage(?:\[[^\]]*\])?\{{(?:{'|'.join(packages)})\}}.*)$", "$1% $2")


def unicode_preamble(tex: Column) -> Column:
    """For a Unicode engine: encodings become comments, fonts, line breaking and direction follow the class line by the scripts in the text.

    A text that loads fontspec, has no letters beyond ASCII or no class line stays as it is.
    """
    has = {name: tex.rlike(f"[{ranges}]") for name, ranges in SCRIPTS.items()}
    rtl, cjk = has["arabic"] | has["hebrew"], has["kana"] | has["hangul"] | has["han"]
    plain = _commented(tex, "inputenc", "fontenc")
    plain = F.when(rtl, _commented(plain, "babel", "microtype")).otherwise(plain)
    language = lambda name: F.lit(f"\\setdefaultlanguage{{{name}}}\n{_first_font(RTL_FONTS[name], f'\\newfontfamily\\{name}font[Script={name.capitalize()}]')}\n")
    broken = lambda code: F.lit(f'\\usepackage{{xeCJK}}\n\\AtBeginDocument{{\\XeTeXlinebreaklocale "{code}"\\XeTeXlinebreakskip=0pt plus 1pt}}\n{_first_font(CJK_FONTS[code], "\\setCJKmainfont")}\n')
    none = F.lit("")
    block = F.concat(
        F.lit("\\usepackage{fontspec}\n\\defaultfontfeatures{Ligatures=TeX}\n"), F.when(rtl, "\\usepackage{polyglossia}\n").otherwise(none), F.lit(_first_font(LATIN_FONTS, "\\setmainfont") + "\n"),
        F.when(has["arabic"], language("arabic")).when(has["hebrew"], language("hebrew")).otherwise(none),
        F.when(has["kana"], broken("ja")).when(has["hangul"], broken("ko")).when(cjk, broken("zh")).otherwise(none), F.lit("\\emergencystretch=2em\n\\sloppy\n"),
    )
    line = F.regexp_extract(plain, r"(?m)^(\\documentclass[^\n]*\n)", 1)
    end = F.instr(plain, line) + F.length(line)
    patched = F.concat(F.substring(plain, F.lit(1), end - 1), block, F.substring(plain, end, F.length(plain)))
    loaded = tex.contains("\\usepackage{fontspec}") | tex.contains("\\usepackage[no-math]{fontspec}")
    return F.when(loaded | ~T.has_foreign_letters(tex) | (line == ""), tex).otherwise(patched)


def for_engine(name: Column, tex: Column) -> Column:
    """The text that an engine gets: patched for the Unicode ones only."""
    return F.when(F.lower(F.trim(name)).isin("xelatex", "lualatex"), unicode_preamble(tex)).otherwise(tex)
