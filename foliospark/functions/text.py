"""Column functions on plain text: identifiers, names, sizes, languages, cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A paper's identifier, new form or old (fixed pattern).
PAPER_ID = r"(\d{4}\.\d{4,5}(v\d+)?|\w+-\w+/\d{7}(v\d+)?)"

#: Spellings of language codes, and their names (fixed values).
LANGUAGE_ALIASES = {
    "ch": "zh", "cn": "zh", "zh-cn": "zh", "zh-hans": "zh", "zh-hant": "zh", "jp": "ja", "jpn": "ja", "ja-jp": "ja",
    "kr": "ko", "kor": "ko", "ko-kr": "ko", "korean": "ko",
}
LANGUAGE_NAMES = {
    "ru": "Russian", "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese",
    "nl": "Dutch", "pl": "Polish", "tr": "Turkish", "uk": "Ukrainian", "cs": "Czech", "sv": "Swedish", "no": "Norwegian",
    "da": "Danish", "fi": "Finnish", "el": "Greek", "zh": "Chinese", "ja": "Japanese", "jp": "Japanese", "jpn": "Japanese",
    "ko": "Korean",
}
#: Common English words that mark untranslated text (fixed values).
ENGLISH_STOP_WORDS = (
    "the", "and", "or", "of", "to", "in", "for", "with", "without", "from", "on", "at", "by", "as", "that", "this", "these", "those", "which", "who",
    "whom", "whose", "a", "an", "is", "are", "was", "were", "be", "been", "being", "it", "its", "we", "our", "us", "their", "they", "them", "can",
    "could", "may", "might", "will", "would", "should", "also", "such", "than", "then", "there", "here", "where", "when", "while",
)


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def mapped(value: Column, table: dict[str, str], default: Column) -> Column:
    """Lookup in a small fixed table."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), default)


def paper_id(text: Column) -> Column:
    """The identifier in a paper's address, or the text itself if it is one; else null."""
    in_url = F.regexp_extract(text, r"(?U)arxiv\.org/(?:abs|pdf)/" + PAPER_ID, 1)
    bare = F.regexp_extract(F.trim(text), r"(?U)^" + PAPER_ID + "$", 1)
    return F.coalesce(F.nullif(in_url, F.lit("")), F.nullif(bare, F.lit("")))


def file_name(text: Column) -> Column:
    return F.btrim(F.translate(text, '<>:"/\\|?*', "_" * 9), F.lit(" ."))


def short_name(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "")), 1, 50)


def safe_id(text: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}\-_.]", "_"), F.lit("._-"))
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit("paper")).otherwise(cleaned)


def size_label(size: Column) -> Column:
    """Bytes with one decimal in the largest unit that leaves less than 1024."""
    value = size.cast("double")
    steps = [("B", 0), ("KB", 1), ("MB", 2), ("GB", 3)]
    label = F.format_string("%.1f TB", F.bround(value / 1024.0**4, 1))
    for unit, power in reversed(steps):
        scaled = value / 1024.0**power
        label = F.when(scaled < 1024, F.format_string(f"%.1f {unit}", F.bround(scaled, 1))).otherwise(label)
    return F.when(size.isNotNull(), label)


def without_blank_lines(text: Column) -> Column:
    """Drops lines of white space only; empty lines stay."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: (line == "") | line.rlike(r"(?U)\S")), "\n")


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def cut_at_sentence(text: Column, most: int = 500, share: float = 0.7) -> Column:
    """At most `most` characters: up to the last sentence end if that is late enough, else with an ellipsis."""
    head = F.substring(text, 1, most)
    back = F.reverse(head)
    last = reduce(F.greatest, [F.when(F.instr(back, mark) > 0, F.length(head) - F.instr(back, mark) + 1).otherwise(0) for mark in ".!?"])
    return F.when(F.length(text) <= most, text).when(last > most * share, F.substring(head, F.lit(1), last)).otherwise(F.concat(head, F.lit("...")))


def language_code(lang: Column) -> Column:
    given = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    code = F.when(given == "", F.lit("ru")).otherwise(given)
    return mapped(code, LANGUAGE_ALIASES, code)


def language_name(lang: Column) -> Column:
    given = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return F.when(given == "", F.lit("Russian")).otherwise(mapped(given, LANGUAGE_NAMES, lang))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def joined_lines(parts: Column) -> Column:
    """Parts of a text cut across pages: a trailing hyphen goes, else a space comes between."""
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(
        F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda acc, part: F.when(acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), part)).otherwise(F.concat(acc, F.lit(" "), part)))
    )


def without_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    t = stripped(text)
    lines = F.split(t, "\n", -1)
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return stripped(F.when(t.startswith("```") & (F.size(lines) > 2), inner).otherwise(t))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words in which each letter is tried once: words that begin alike share their beginning."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    each = "|".join(c + _any_of(rest) for c, rest in sorted(tails.items()))
    return "" if not each else f"(?:{each})" + ("?" if "" in words else "")


def english_words(text: Column) -> Column:
    """How many of the text's ASCII words of two letters or more are common English ones."""
    return F.regexp_count(F.lower(text), F.lit(r"(?U)\b" + _any_of([w for w in ENGLISH_STOP_WORDS if len(w) > 1]) + r"\b"))


def ascii_share(squeezed_text: Column) -> Column:
    """ASCII letters over all characters but spaces; what is counted is what goes when they are taken out, a run at a time."""
    letters = F.length(squeezed_text) - F.length(F.regexp_replace(squeezed_text, "[A-Za-z]+", ""))
    return F.try_divide(letters, F.greatest(F.length(F.replace(squeezed_text, F.lit(" "), F.lit(""))), F.lit(1)))


def english_heavy(text: Column, least: int = 140, hits: int = 6) -> Column:
    """Long text that is mostly ASCII letters and holds enough common English words; the cheap tests come first."""
    t = squeezed(text)
    return (F.length(t) >= least) & (ascii_share(t) >= 0.25) & (english_words(t) >= hits)


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яА-ЯёЁ]")


def has_foreign_letters(text: Column) -> Column:
    return text.rlike(r"[\p{L}&&[^\x00-\x7F]]")


#: Ranges of code points that need fonts of their own (fixed values).
SCRIPTS = {"kana": "\u3040-\u30ff", "hangul": "\uac00-\ud7af", "han": "\u4e00-\u9fff", "arabic": "\u0600-\u06ff", "hebrew": "\u0590-\u05ff"}


def has_script(text: Column, script: str) -> Column:
    return text.rlike(f"[{SCRIPTS[script]}]")


def cut_log_tail(text: Column, lines: int = 60) -> Column:
    each = F.split(text, "\n", -1)
    return F.array_join(F.slice(each, F.greatest(F.size(each) - lines + 1, F.lit(1)), F.lit(lines)), "\n")


def looks_numeric(text: Column) -> Column:
    return text.rlike(r"^[\d\s.,+\-()%/]+$")


def like_heading(text: Column) -> Column:
    """Numbered, a number over a short line, few words in capitals, or a known section name."""
    t = stripped(text)
    lines = F.split(t, "\n", -1)
    numbered = (t.rlike(r"^\d+(\.\d+)*\.?$") & (F.length(t) < 10)) | t.rlike(r"(?U)^\d+(\.\d+)*\.?\s+[\p{L}\p{N}_]")
    two = (F.size(lines) == 2) & F.trim(F.get(lines, F.lit(0))).rlike(r"^\d+(\.\d+)*$") & (F.length(F.trim(F.get(lines, F.lit(1)))) < 50)
    capitals = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}") & (F.size(F.split(squeezed(t), " ")) <= 5)
    return numbered | two | capitals | F.lower(t).isin(*SECTION_NAMES)


#: Names of sections (fixed values).
SECTION_NAMES = (
    "introduction", "background", "related work", "methods", "methodology", "results", "discussion", "conclusion",
    "conclusions", "abstract", "acknowledgements", "acknowledgments", "references", "appendix", "experiments", "evaluation",
    "model", "model architecture", "training", "attention", "self-attention", "multi-head attention", "encoder", "decoder",
)


def like_authors(text: Column) -> Column:
    """Short text with an address cue; .edu and .org are cues without an @."""
    t, low = stripped(text), F.lower(text)
    lines = F.split(t, "\n", -1)
    cue = (text.contains("@") & low.contains(".com")) | low.contains(".edu") | low.contains(".org")
    block = F.size(lines).between(2, 4) & F.forall(lines, lambda x: F.length(x) < 50) & t.contains("@")
    return (F.length(t) <= 150) & (cue | block)
