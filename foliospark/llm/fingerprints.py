"""Document fingerprints: Merkle trees over paragraphs and sections.

Leaves are the hashes of a text's paragraphs: lines, cut further after sentence ends. A paragraph of more than LONG
code points is cut on where its own words say so (the first letter and length of the word, or the wide character, before the cut), and every
so many words at the latest, so one edit in a long line does not change all of it and no leaf is without bound. A
section is a run of paragraphs that ends at a paragraph whose hash says so, so an edit moves no other section's
borders. A section is the hash of its leaves' full hashes, the root the hash of its sections' full hashes. Equal roots
mean equal texts; where roots differ, descending into the sections that differ, and in them the leaves, locates the
edit. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import store
from foliospark.sources.shared import few_files

#: After a line feed, or after white space that follows a sentence end. Nothing is lost: pieces keep their ends.
PARAGRAPH_END = r"(?<=\n)|(?<=[.!?]\s)(?=\S)"
#: Code points from which a paragraph is cut at its own words.
LONG = 100
#: A wide character, or up to 64 others and the white space after them, or white space.
TOKEN = r"[\x{2E80}-\x{10FFFF}]|[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]{1,64}[\x20\x09-\x0D]{0,64}|[\x20\x09-\x0D]{1,64}"
#: Tokens end a leaf if the code point of their first character and their length have a sum divisible by TOKEN_END, and
#: so does each 64th token of a paragraph.
TOKEN_END = 8
MOST_TOKENS = 64
#: Marks a cut; where the text itself has the first of the two, ESCAPE follows it there.
MARK, SIGN, ESCAPE = "\x01\x03", "\x01", "\x02"
#: Hex digits of a leaf that are shown; a paragraph whose hash ends in one of SECTION_END (an eighth) ends its section.
DIGITS = 12
SECTION_END = "01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraphs(text: Column) -> Column:
    """The pieces that are leaves, in order; joined they are the text with each SIGN escaped."""
    lines = F.filter(F.split(F.replace(text, F.lit(SIGN), F.lit(SIGN + ESCAPE)), PARAGRAPH_END, -1), lambda p: p != "")

    def cut(p: Column) -> Column:
        ends = lambda t, i: ((F.ascii(t) + F.char_length(t)) % TOKEN_END == 0) | (i % MOST_TOKENS == MOST_TOKENS - 1)
        marked = F.transform(F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0)), lambda t, i: F.when(ends(t, i), F.concat(t, F.lit(MARK))).otherwise(t))
        return F.filter(F.split(F.array_join(marked, ""), MARK, -1), lambda x: x != "")

    return F.flatten(F.transform(lines, lambda p: F.when(F.char_length(p) > LONG, cut(p)).otherwise(F.array(p))))


def tree(text: Column) -> Column:
    """struct of `fingerprint`, root;section:leaf,leaf,...;section:leaf,... as text, and `leaves`, the different ones in it.

    Equal texts have equal fingerprints. Root and sections are shown whole, so the root can be checked from them; of
    leaves the first DIGITS digits are shown.
    """
    shown = lambda run: F.regexp_replace(run, rf"([0-9a-f]{{{DIGITS}}})[0-9a-f]{{{64 - DIGITS}}}", "$1")
    runs = lambda leaves: F.split(F.array_join(leaves, ","), f"(?<=[{SECTION_END}]),")
    sections = lambda leaves: F.transform(runs(leaves), lambda run: F.concat(F.sha2(run, 256), F.lit(":"), shown(run)))
    root = lambda s: F.sha2(F.array_join(F.transform(s, lambda x: F.substring(x, 1, 64)), ","), 256)
    whole = lambda s: F.concat(root(s), F.lit(";"), F.array_join(s, ";"))
    short = lambda leaves: F.array_distinct(F.transform(leaves, lambda x: F.substring(x, 1, DIGITS)))
    leaves = F.transform(paragraphs(text), lambda p: F.sha2(p, 256))
    return _let(leaves, lambda own: F.struct(_let(sections(own), whole).alias("fingerprint"), short(own).alias("leaves")))


def fingerprint(text: Column) -> Column:
    return tree(text)["fingerprint"]


def _dice(a: Column, b: Column) -> Column:
    """Twice the common elements over all of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double") * 2, F.size(a) + F.size(b)), F.lit(0.0))


def _leaves(sections: Column) -> Column:
    """The different leaves of an array of sections."""
    each = F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, ":", -1), ",")))
    return F.array_distinct(F.filter(each, lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves over all leaves of two fingerprints, 0 to 1; 1 for equal ones."""
    return F.when(a == b, F.lit(1.0)).otherwise(_dice(_leaves(_sections(a)), _leaves(_sections(b))))


def _sections(fingerprint: Column) -> Column:
    return F.slice(F.split(fingerprint, ";"), 2, 1 << 30)


def changes(a: Column, b: Column) -> Column:
    """Where fingerprint `a` differs from `b`, by descending from the root: struct of the numbers of different sections and
    leaves that `a` has and `b` has not, and the path of the first, as section/leaf counted from 0 (null for equal roots,
    and where `b` only has more).

    Leaves are compared only inside sections that differ.
    """
    differing = lambda x: F.struct(x["a"].alias("all"), F.array_except(x["a"], x["b"]).alias("mine"), F.array_except(x["b"], x["a"]).alias("other"))
    compared = lambda x: F.struct(x["all"].alias("all"), x["mine"].alias("mine"), F.array_except(_leaves(x["mine"]), _leaves(x["other"])).alias("fresh"))

    def located(x: Column) -> Column:
        first = F.get(x["mine"], F.lit(0))
        at = F.array_position(F.transform(F.split(F.substring_index(first, ":", -1), ","), lambda l: F.array_contains(x["fresh"], l)), True)
        path = F.when(F.size(x["mine"]) > 0, F.concat_ws("/", F.array_position(x["all"], first) - 1, F.greatest(at - 1, F.lit(0))))
        return F.struct(F.size(x["mine"]).alias("sections"), F.size(x["fresh"]).alias("leaves"), path.alias("first"))

    none = F.struct(F.lit(0).alias("sections"), F.lit(0).alias("leaves"), F.lit(None).cast("string").alias("first"))
    both = F.struct(_sections(a).alias("a"), _sections(b).alias("b"))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), none).otherwise(_let(_let(_let(both, differing), compared), located))


def document_order(docs: DataFrame) -> DataFrame:
    """h, g, prev_h, prev_g, prev_n: of each different document in docs(doc_id, n, h, g) the one before it and its code points.

    Documents are in order of doc_id, null last, then hash; the last comes before the first.
    """
    numbered = store.save(store.numbered(docs.distinct(), [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("g")], "tree-order", "no"), "tree-numbers")
    count = numbered.count()
    before = numbered.select(((F.col("no") + 1) % F.lit(max(count, 1))).alias("no"), F.col("h").alias("prev_h"), F.col("g").alias("prev_g"), F.col("n").alias("prev_n"))
    return store.save(numbered.join(before, "no").select("h", "g", "prev_h", "prev_g", "prev_n"), "tree-previous")


def merkle_fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed_sections, n_changed_leaves, first_change and next_id
    for each row of `df` (doc_id, text).

    A document's edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document's, by doc_id, the last being followed by the first. Null text is empty. Documents are ordered by
    doc_id (null last), then by a hash; repeated rows count once in that order and are all returned. A table of one
    document follows itself; an empty table gives no rows. Other columns are ignored.

    Texts move once, by their key; what a document lends to the one before it moves there: as much of its beginning as
    that one's length asks for, its root and its leaves.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = df.select("doc_id", text.alias("text"))
    docs = docs.withColumn("h", F.xxhash64(F.lit(0), "doc_id", "text")).withColumn("g", F.xxhash64(F.lit(1), "doc_id", "text"))
    order = document_order(docs.select("doc_id", F.char_length("text").alias("n"), "h", "g"))
    own = docs.join(order.hint("merge"), ["h", "g"])
    lent = own.select(
        F.col("prev_h").alias("h"), F.col("prev_g").alias("g"), F.col("doc_id").alias("next_id"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("lent"), tree(F.col("text")).alias("t"),
    )
    lent = lent.select("h", "g", F.struct("next_id", "lent", F.substring("t.fingerprint", 1, 64).alias("root"), F.array_join("t.leaves", ",").alias("leaves")).alias("next"))
    lent = lent.groupBy("h", "g").agg(F.min("next").alias("next"))  # a repeated row lends once
    n = F.char_length("text")
    kept = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int"))
    trees = own.join(lent.hint("merge"), ["h", "g"]).select("doc_id", n.cast("long").alias("n_chars"), F.concat(kept, F.col("next.lent")).alias("edited"), tree(F.col("text")).alias("own"), "next")
    trees = trees.withColumn("new", tree(F.col("edited")))
    compared = trees.withColumn("changed", changes(F.col("own.fingerprint"), F.col("new.fingerprint")))
    next_leaves = F.filter(F.split("next.leaves", ","), lambda x: x != "")
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own.fingerprint").alias("fingerprint"), F.col("new.fingerprint").alias("edited_fingerprint"),
        F.when(F.col("own.fingerprint") == F.col("new.fingerprint"), 1.0).otherwise(_dice(F.col("own.leaves"), F.col("new.leaves"))).alias("near_edited"),
        F.when(F.substring("own.fingerprint", 1, 64) == F.col("next.root"), 1.0).otherwise(_dice(F.col("own.leaves"), next_leaves)).alias("near_next"),
        F.col("changed.sections").alias("n_changed_sections"), F.col("changed.leaves").alias("n_changed_leaves"), F.col("changed.first").alias("first_change"),
        F.col("next.next_id").alias("next_id"),
    )


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(merkle_fingerprints(store.documents(spark, sf_dir)))


def _sql() -> str:
    mark = "chr(1) || chr(3)"
    ends = f"(ord(t) + length(t)) % {TOKEN_END} = 0"
    tokens = f"regexp_extract_all(p, '{TOKEN}')"
    cut = f"string_split(array_to_string(list_transform({tokens}, lambda t, i: t || CASE WHEN {ends} OR i % {MOST_TOKENS} = 0 THEN {mark} ELSE '' END), ''), {mark})"

    def tree_sql(t: str) -> str:
        sentence = lambda x: f"regexp_replace({x}, '([.!?]\\s)([^\\s\\x01])', '\\1' || {mark} || '\\2', 'g')"
        lines = f"string_split({sentence(sentence(f'replace(replace({t}, chr(1), chr(1) || chr(2)), chr(10), chr(10) || {mark})'))}, {mark})"
        pieces = f"flatten(list_transform({lines}, lambda p: CASE WHEN length(p) > {LONG} THEN {cut} ELSE [p] END))"
        leaves = f"array_to_string(list_transform(list_filter({pieces}, lambda p: p <> ''), lambda p: sha256(p)), ',')"
        runs = f"string_split(regexp_replace({leaves}, '([{SECTION_END}]),', '\\1;', 'g'), ';')"
        return f"list_transform({runs}, lambda r: concat(sha256(r), ':', regexp_replace(r, '([0-9a-f]{{{DIGITS}}})[0-9a-f]{{{64 - DIGITS}}}', '\\1', 'g')))"

    def shown(s: str) -> str:
        return f"concat(sha256(array_to_string(list_transform({s}, lambda x: left(x, 64)), ',')), ';', array_to_string({s}, ';'))"

    def leaves_in(s: str) -> str:
        return f"list_distinct(regexp_extract_all({s}, '[:,]([0-9a-f]{{{DIGITS}}})', 1))"

    def near(a: str, b: str) -> str:
        x, y = leaves_in(a), leaves_in(b)
        return f"CASE WHEN {a} = {b} THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE * 2 / (len({x}) + len({y})) END"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT *, concat(left(text, length(text) - length(text) // 2), left(after, length(text) // 2)) AS edited FROM n),
s AS (SELECT *, {tree_sql("text")} AS ts, {tree_sql("edited")} AS es, {tree_sql("after")} AS ats FROM e),
f AS (SELECT *, {shown("ts")} AS fingerprint, {shown("es")} AS edited_fingerprint, {shown("ats")} AS after_fingerprint,
  list_filter(ts, lambda x: NOT list_contains(es, x)) AS mine, list_filter(es, lambda x: NOT list_contains(ts, x)) AS other FROM s),
c AS (SELECT *, list_filter({leaves_in("array_to_string(mine, ';')")}, lambda l: NOT list_contains({leaves_in("array_to_string(other, ';')")}, l)) AS fresh FROM f)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, {near("fingerprint", "edited_fingerprint")} AS near_edited, {near("fingerprint", "after_fingerprint")} AS near_next,
 len(list_distinct(mine)) AS n_changed_sections, len(fresh) AS n_changed_leaves,
 CASE WHEN len(mine) > 0 THEN concat(list_position(ts, mine[1]) - 1, '/', greatest(coalesce(list_position(list_transform(string_split(split_part(mine[1], ':', 2), ','), lambda l: list_contains(fresh, l)), true), 0) - 1, 0)) END AS first_change,
 next_id FROM c
"""


SQL = _sql()
