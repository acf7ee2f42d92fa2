"""Scores of a translation beside its original. The texts of issues are result values (fixed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T

#: What an issue costs, in hundredths, by the first cue that its text holds (fixed values).
PENALTIES = (("mismatch", 30), ("glossary term left untranslated", 20), ("glossary translation missing", 15), ("colloquial", 10), ("informal", 10), ("excessive", 10))
OTHER_PENALTY = 5
#: Words of a casual register (fixed values).
CASUAL = ("типа", "короче", "в общем", "ну ", "ладно", "окей", "круто", "супер", "просто ", "реально")


def length_ratio(original: Column, translated: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(translated).cast("double"), F.length(original)), F.lit(0.0))


def section_count(tex: Column) -> Column:
    return F.regexp_count(tex, F.lit(r"\\section\{"))


def display_count(tex: Column) -> Column:
    return F.regexp_count(tex, F.lit(r"\$\$")) + F.regexp_count(tex, F.lit(r"\\\["))


def structure_issues(original: Column, translated: Column) -> Column:
    """Issues of length, sections and displayed formulas, in that order."""
    ratio, so, st, mo, mt = length_ratio(original, translated), section_count(original), section_count(translated), display_count(original), display_count(translated)
    said = lambda word: F.concat(F.lit(f"Translation is suspiciously {word} (ratio "), F.format_string("%.2f", ratio), F.lit(")"))
    versus = lambda what, a, b: F.concat(F.lit(f"{what} count mismatch: "), a.cast("string"), F.lit(" vs "), b.cast("string"))
    return F.filter(
        F.array(
            F.when(ratio < 0.5, said("short")).when(ratio > 2.0, said("long")),
            F.when(so != st, versus("Section", so, st)),
            F.when(F.abs(mo - mt) > 2, versus("Display math", mo, mt)),
        ),
        lambda x: x.isNotNull(),
    )


def style_issues(translated: Column) -> Column:
    """Issues of register in Russian prose."""
    prose = X.prose_for_validation(translated)
    low = F.lower(prose)
    hits = F.sort_array(F.filter(F.array(*map(F.lit, CASUAL)), lambda w: low.contains(w)))
    marks = F.regexp_count(prose, F.lit("!"))
    return F.filter(
        F.array(
            F.when(F.size(hits) > 0, F.concat(F.lit("Colloquial register detected: "), F.array_join(hits, ", "))),
            F.when(marks >= 2, F.concat(F.lit("Excessive exclamation marks: "), marks.cast("string"))),
            F.when(prose.contains("!!") | prose.contains("???"), F.lit("Informal punctuation detected")),
            F.when(low.rlike(r"(?U)(^|\s)я(\s|$)"), F.lit("First-person singular detected ('я')")),
        ),
        lambda x: x.isNotNull(),
    )


def term_issues(expected: Column, translated: Column) -> Column:
    """Issues of array<struct<term, translation>>: terms left as they are, translations that are absent."""
    low = F.lower(X.prose_for_validation(translated))
    each = lambda e: F.array(
        F.when(F.rlike(low, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(e["term"]), F.lit(r"\E(?!\w)"))), F.concat(F.lit("Glossary term left untranslated: '"), e["term"], F.lit("'"))),
        F.when(~low.contains(F.lower(e["translation"])), F.concat(F.lit("Glossary translation missing for '"), e["term"], F.lit("' -> '"), e["translation"], F.lit("'"))),
    )
    return F.filter(F.flatten(F.transform(expected, each)), lambda x: x.isNotNull())


def score(issues: Column) -> Column:
    """1 less the issues' costs, not below 0. Costs are whole hundredths, so their order does not matter."""

    def cost(issue: Column) -> Column:
        low, out = F.lower(issue), F.lit(OTHER_PENALTY)
        for cue, value in reversed(PENALTIES):
            out = F.when(low.contains(cue), F.lit(value)).otherwise(out)
        return out

    return F.greatest(F.lit(100) - F.aggregate(issues, F.lit(0), lambda acc, i: acc + cost(i)), F.lit(0)).cast("double") / 100


def english_gate(text: Column, cjk: bool = False) -> Column:
    """Whether a translated chunk still has an English block."""
    blocks = F.split(text, r"(?U)\n\s*\n", -1)
    return F.exists(blocks, lambda b: T.english_heavy(b, 80 if cjk else 120, 4 if cjk else 6))


def japanese_style(text: Column) -> Column:
    """struct<sentences, dearu, topics, connectors, literal>: signs of literal translation in Japanese prose; topics are sought in the first 200 sentences."""
    t = F.trim(F.regexp_replace(X.prose_for_chunks(text), r"\s+", " "))
    sentences = F.filter(F.transform(F.split(t, "[。．.]"), lambda s: F.trim(s)), lambda s: s != "")
    n, dearu = F.size(sentences), F.regexp_count(t, F.lit("である|であり|であった"))
    topics = F.size(F.filter(F.slice(sentences, 1, 200), lambda s: s.rlike(r"^\S{1,24}は")))
    connectors = F.regexp_count(t, F.lit("したがって|従って|そのため|なぜなら|つまり"))
    literal = (n >= 18) & (dearu >= 10) & (topics >= 8) & (connectors >= 2)
    return F.struct(n.alias("sentences"), dearu.alias("dearu"), topics.alias("topics"), connectors.alias("connectors"), literal.alias("literal"))
