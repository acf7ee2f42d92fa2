"""Reversible masking of what must not be translated, and its restoration.

Nested environments and balanced arguments are beyond regular languages, so the scanner is an Arrow UDF over whole
texts; everything after it (restoring, checking, counting) is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is masked, pass by pass: statistic, token kind, form, names (fixed values; the order matters).
PASSES = (
    ("comments", "COMMENT", "comment", ()),
    ("verbatim", "CODE", "environment", ("verbatim", "lstlisting", "minted")),
    ("verbatim", "CODE", "delimited", ("verb", "lstinline")),
    ("specialized", "TIKZ", "environment", ("tikzpicture", "pgfpicture", "xymatrix", "xy", "pspicture", "circuitikz", "tikzcd", "forest")),
    ("images", "IMG", "command", ("includegraphics",)),
    ("math_display", "MATH_DISP", "environment", (
        "equation", "equation*", "align", "align*", "alignat", "alignat*", "multline", "multline*", "gather", "gather*",
        "flalign", "flalign*", "eqnarray", "eqnarray*", "split", "cases", "IEEEeqnarray", "IEEEeqnarray*")),
    ("math_display", "MATH_DISP", "pair", (r"\\\[", r"\\\]")),
    ("math_display", "MATH_DISP", "pair", (r"\$\$", r"\$\$")),
    ("math_inline", "MATH_INLINE", "pair", (r"\\\(", r"\\\)")),
    ("math_inline", "MATH_INLINE", "dollars", ()),
    ("commands", "CMD", "command", ("cite", "citep", "citet", "ref", "label", "url", "doi", "eqref", "autoref")),
)
STATISTICS = ("comments", "verbatim", "specialized", "math_display", "math_inline", "images", "commands")
#: Longest inline formula, in characters.
LONGEST_INLINE = 5000
RESULT = "masked string, tokens array<struct<token: string, kind: string, original: string>>, stats map<string,int>"

Span = tuple[int, int]
#: Characters without which a text has none of a form: looking for them is much cheaper than scanning.
MARKS = {"comment": "%", "dollars": "$", "pair": "$\\"}


def _environment_spans(text: str, name: str) -> list[Span]:
    """Outermost begin/end pairs of an environment; ends without a begin are ignored, begins without an end too."""
    if f"\\begin{{{name}}}" not in text:
        return []
    open_at: list[int] = []
    pairs: list[Span] = []
    for m in re.finditer(rf"\\(begin|end)\{{{re.escape(name)}\}}", text):
        if m[1] == "begin":
            open_at.append(m.start())
        elif open_at:
            pairs.append((open_at.pop(), m.end()))
    outer: list[Span] = []
    for a, b in sorted(pairs):
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer[::-1]  # numbered from the last, as they are replaced


def _closing(text: str, at: int, opening: str, closing: str) -> int:
    """Just past the partner of the bracket at `at`; the end of the text without one."""
    depth = 0
    for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.end()
    return len(text)


def _command_spans(text: str, name: str) -> Iterator[Span]:
    """A command with one optional and one required argument; a second optional one ends it."""
    if f"\\{name}" not in text:
        return
    rx, at = re.compile(rf"\\{re.escape(name)}(?=[\[{{])"), 0
    while m := rx.search(text, at):
        end = m.end()
        if text[end] == "[":
            end = _closing(text, end, "[", "]")
        if text[end : end + 1] == "{":
            end = _closing(text, end, "{", "}")
        yield m.start(), end
        at = end


def _delimited_spans(text: str, name: str) -> Iterator[Span]:
    """A command whose argument stands between two equal characters; a backslash before the second one escapes it."""
    if f"\\{name}" not in text:
        return
    rx, at = re.compile(rf"\\{name}\*?(\S)"), 0
    while m := rx.search(text, at):
        close = re.compile(rf"(?<!\\){re.escape(m[1])}").search(text, m.end())
        if close:
            yield m.start(), close.end()
        at = close.end() if close else m.end()


def _dollar_spans(text: str) -> Iterator[Span]:
    """Single dollars around a formula; escaped and doubled ones are none."""
    singles = [(m.start(1), len(m[1])) for m in re.finditer(r"(?:(?<=[^\\])|^)(?:\\\\)*(\$\$?)", text)]
    places = [at for at, size in singles if size == 1]
    k = 0
    while k + 1 < len(places):
        if places[k + 1] - places[k] <= LONGEST_INLINE:
            yield places[k], places[k + 1] + 1
            k += 2
        else:
            k += 1


def _spans(text: str, form: str, names: tuple[str, ...]) -> Iterator[list[Span]]:
    """Spans to replace at once, in the order in which they are numbered."""
    if form in MARKS and not any(mark in text for mark in MARKS[form]):
        return
    if form == "comment":
        yield [m.span() for m in re.finditer(r"(?<!\\)%[^\n]*", text)]
    elif form == "pair":
        yield [m.span() for m in re.finditer(f"{names[0]}.*?{names[1]}", text, re.DOTALL)]
    elif form == "dollars":
        yield list(_dollar_spans(text))


def mask_text(text: str) -> tuple[str, list[tuple[str, str, str]], dict[str, int]]:
    """Masked text, (token, kind, original) in masking order, and counts."""
    tokens: list[tuple[str, str, str]] = []
    stats = dict.fromkeys(STATISTICS, 0)

    def put(text: str, spans: list[Span], kind: str, stat: str) -> str:
        named = []
        for a, b in spans:
            token = f"<<{kind}_{len(tokens)}>>"
            tokens.append((token, kind, text[a:b]))
            named.append((a, b, token))
        stats[stat] += len(named)
        out, last = [], 0
        for a, b, token in sorted(named):
            out += [text[last:a], token]
            last = b
        return "".join([*out, text[last:]])

    finders = {"environment": _environment_spans, "command": _command_spans, "delimited": _delimited_spans}
    for stat, kind, form, names in PASSES:
        if form in finders:
            for name in names:
                text = put(text, list(finders[form](text, name)), kind, stat)
        else:
            for spans in _spans(text, form, names):
                text = put(text, spans, kind, stat)
    return text, tokens, stats


def masked(df: DataFrame, key: str, tex: str) -> DataFrame:
    """key, masked, tokens, stats for each document; null text gives null."""
    rows = df.select(F.col(key), F.col(tex).alias("tex"))

    def run(batches):
        import pyarrow as pa

        struct = pa.list_(pa.struct([("token", pa.string()), ("kind", pa.string()), ("original", pa.string())]))
        for batch in batches:
            found = [mask_text(t) if t is not None else (None, None, None) for t in batch.column("tex").to_pylist()]
            texts, tokens, stats = (list(x) for x in zip(*found)) if found else ([], [], [])
            lists = [None if t is None else [dict(zip(("token", "kind", "original"), x)) for x in t] for t in tokens]
            maps = [None if s is None else list(s.items()) for s in stats]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string()), pa.array(lists, struct), pa.array(maps, pa.map_(pa.string(), pa.int32()))], names=[key, "masked", "tokens", "stats"])

    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {RESULT}")


TOKEN = r"<<[A-Z_]+_\d+>>"


def _looked_up(text: Column, originals: Column) -> Column:
    """text with each token that map `originals` knows replaced, in one pass."""
    parts, found = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.zip_with(parts, found, lambda p, t: F.concat(p, F.coalesce(F.try_element_at(originals, t), t, F.lit("")))), "")


def restored(text: Column, tokens: Column, rounds: int = 10) -> Column:
    """Tokens replaced by their originals, nested ones too, at most `rounds` levels deep.

    Originals that hold tokens are resolved first, among themselves; the text is cut at its tokens once.
    """
    as_map = lambda ts: F.map_from_entries(F.transform(ts, lambda e: F.struct(e["token"], e["original"])))
    nested = lambda ts: F.exists(ts, lambda e: e["original"].rlike(TOKEN))
    deeper = lambda ts: F.element_at(F.transform(F.array(as_map(ts)), lambda m: F.transform(ts, lambda e: F.struct(e["token"].alias("token"), F.when(e["original"].rlike(TOKEN), _looked_up(e["original"], m)).otherwise(e["original"]).alias("original")))), 1)
    own = F.transform(tokens, lambda e: F.struct(e["token"].alias("token"), e["original"].alias("original")))
    known = F.aggregate(F.sequence(F.lit(1), F.lit(rounds - 1)), own, lambda acc, _: F.when(nested(acc), deeper(acc)).otherwise(acc))
    whole = F.element_at(F.transform(F.array(as_map(known)), lambda m: _looked_up(text, m)), 1)
    return F.when(text.contains("<<") & (F.size(tokens) > 0), whole).otherwise(text)


def unmasked(text: Column, tokens: Column) -> Column:
    """One pass in masking order; tokens inside later tokens stay."""
    return F.aggregate(tokens, text, lambda acc, e: F.replace(acc, e["token"], e["original"]))


def leftovers(text: Column) -> Column:
    """Distinct tokens still in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<<[A-Z_]+_\d+>>"), F.lit(0)))


def missing(text: Column, tokens: Column) -> Column:
    """Tokens of the map that a reply has lost, before restoration."""
    return F.transform(F.filter(tokens, lambda e: ~text.contains(e["token"])), lambda e: e["token"])


def without_leftovers(text: Column) -> Column:
    return F.when(text.rlike("<<[^>]+>>"), F.regexp_replace(F.regexp_replace(text, "<<[^>]+>>", ""), "\n\n\n+", "\n\n")).otherwise(text)


#: What a translation of running text keeps: citations, numbered references, formulas, addresses, acronyms (fixed patterns).
PRESERVED = r"\[[\d,\s\-–]+\]|\(Eq\.?\s*\d+\)|\(Figure\s*\d+[a-z]?\)|\(Fig\.?\s*\d+[a-z]?\)|\(Table\s*\d+\)|\$[^$]+\$|https?://[^\s]+|\b[A-Z]{2,}\b"


def numbered_mask(text: Column, pattern: str, token: str) -> Column:
    """struct<masked, kept>: matches of a pattern, in order, as token with its number from 0 (`token` holds one %)."""
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before, after = token.split("%")
    named = F.transform(kept, lambda _, i: F.concat(F.lit(before), i.cast("string"), F.lit(after)))
    masked = F.array_join(F.zip_with(F.split(text, pattern, -1), named, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return F.struct(F.when(text.isNotNull(), masked).alias("masked"), kept.alias("kept"))


def numbered_unmask(text: Column, kept: Column, token: str) -> Column:
    """text with its numbered tokens as what `kept` has at their numbers; numbers beyond it stay."""
    before, after = (re.escape(x) for x in token.split("%"))
    rx = f"{before}(\\d+){after}"
    numbers = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    own = F.transform(numbers, lambda t: F.coalesce(F.get(kept, F.regexp_extract(t, rx, 1).cast("int")), t))
    return F.array_join(F.zip_with(F.split(text, rx, -1), own, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
