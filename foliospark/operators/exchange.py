"""Batches of texts sent to an injected model and read back: numbered blocks, retries, repair, tables put back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import tex as X
from foliospark.functions import text as T

#: A numbered block of a prompt or reply (fixed pattern).
NUMBERED = r"(?s)@@@(\d+)@@@(.*?)@@@END\1@@@"
LINE_NUMBERED = r"(?m)^[ \t]*@@@(\d+)@@@[ \t]*(.*)$"

Model = Callable[[str], str | None]


def prompt(items: DataFrame, key: str) -> DataFrame:
    """key, prompt: the texts of items(key, i, text) between numbered marks, in order of i."""
    mark = F.lpad(F.col("i").cast("string"), 4, "0")
    block = F.concat(F.lit("@@@"), mark, F.lit("@@@\n"), F.coalesce("text", F.lit("")), F.lit("\n@@@END"), mark, F.lit("@@@"))
    rows = items.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", block.alias("block")))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["block"]), "\n").alias("prompt"))


def answers(items: DataFrame, replies: DataFrame, key: str, pattern: str = NUMBERED, positional: bool = False) -> DataFrame:
    """items(key, i, text) with `answer`: the part of replies(key, reply) with the item's number, the text itself without one.

    Blank parts count as none; of several with one number the last wins. With `positional`, a reply without any mark but
    with as many lines that are not blank as there are items answers them in order. The join is on key and number.
    """
    parts = replies.select(key, F.posexplode(F.regexp_extract_all("reply", F.lit(pattern), F.lit(0))).alias("at", "part"))
    named = parts.select(key, F.regexp_extract("part", pattern, 1).cast("long").alias("i"), T.stripped(F.regexp_extract("part", pattern, 2)).alias("got"), "at").filter("got <> ''")
    found = named.groupBy(key, "i").agg(F.max_by("got", "at").alias("got"))
    if positional:
        lines = F.filter(F.split("reply", "\n", -1), lambda x: F.trim(x) != "")
        bare = replies.filter(F.size(F.regexp_extract_all("reply", F.lit(pattern), F.lit(0))) == 0).select(key, lines.alias("lines"))
        sizes = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        plain = bare.join(sizes, key).filter(F.size("lines") == F.col("n")).select(key, F.posexplode("lines").alias("at", "got")).select(key, (F.col("at") + 1).cast("long").alias("i"), T.stripped(F.col("got")).alias("got"))
        found = found.unionByName(plain)
    return items.join(found, [key, "i"], "left").withColumn("answer", F.coalesce("got", "text")).drop("got")


def asked(df: DataFrame, question: str, answer: str, model: Model, needed: Column | None = None) -> DataFrame:
    """df with `answer` = model(question) for the rows that need one (all without `needed`); others keep the answer they have.

    The model is called once a row, in Arrow batches; None or an error's row keeps null, so the caller's fallback holds.
    """
    rows = df if answer in df.columns else df.withColumn(answer, F.lit(None).cast("string"))
    rows = rows.withColumn("_needed", F.lit(True) if needed is None else F.coalesce(needed, F.lit(False)))

    def run(batches):
        for pdf in batches:
            pdf[answer] = [model(q) if n and q is not None else a for q, n, a in zip(pdf[question], pdf["_needed"], pdf[answer])]
            yield pdf

    return rows.mapInPandas(run, rows.schema).drop("_needed")


def translated_blocks(items: DataFrame, key: str, model: Model, pattern: str = NUMBERED, positional: bool = False) -> DataFrame:
    """items(key, i, text) with `answer`, one model call for each key's blocks."""
    replies = asked(prompt(items, key), "prompt", "reply", model).select(key, F.coalesce("reply", F.lit("")).alias("reply"))
    return answers(items, replies, key, pattern, positional)


def with_retries(df: DataFrame, text: str, model: Callable[[str, int], str | None], refused: Callable[[Column, Column], Column], retries: int = 2) -> DataFrame:
    """df with answer and attempts: model(text, attempt) until refused(text, answer) is false, at most `retries` times more.

    The attempts follow each other in one pass over the rows; only refused rows are asked again, and the last answer stays.
    """
    out = df.withColumn("answer", F.lit(None).cast("string")).withColumn("attempts", F.lit(0))
    for attempt in range(retries + 1):
        open_ = F.lit(True) if attempt == 0 else F.coalesce(refused(F.col(text), F.col("answer")), F.lit(True))
        out = out.withColumn("_open", open_).withColumn("attempts", F.col("attempts") + F.col("_open").cast("int"))
        out = asked(out, text, "answer", lambda q, a=attempt: model(q, a), F.col("_open")).drop("_open")
    return out


def repaired(df: DataFrame, key: str, text: str, model: Model, most: int = 6, least: int = 6) -> DataFrame:
    """key, text: documents whose most English lines (`most` of them, `least` stop words or more) went through the model as numbered blocks.

    An answer is taken if its braces are balanced; lines keep their places.
    """
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "text")).withColumn("i", (F.col("i") + 1).cast("long"))
    scored = lines.withColumn("score", T.english_words(F.col("text"))).filter(F.col("score") >= least)
    chosen = scored.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "i"))).filter(F.col("n") <= most).select(key, "i", "text")
    fixed = translated_blocks(chosen, key, model).filter(X.braces_balanced(F.col("answer"))).select(key, "i", "answer")
    whole = lines.join(fixed, [key, "i"], "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("answer", "text").alias("line")))).alias("p"))
    return whole.select(key, F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


def english_spans(block: Column, cjk: bool = False) -> Column:
    """Different runs of plain English in a block: 61 characters or more without TeX signs, with enough stop words, in order."""
    spans = F.transform(F.regexp_extract_all(block, F.lit(r"[A-Za-z][^\\{}$\n]{60,}"), F.lit(0)), T.squeezed)
    return F.array_distinct(F.filter(spans, lambda s: T.english_words(s) >= (10 if cjk else 16)))


def environments_put_back(translated: Column, original: Column, name: str = "table") -> Column:
    """The i-th environment `name` of a translation replaced by the original's i-th; those beyond either's number stay."""
    rx = rf"(?s)\\begin\{{{name}\*?\}}.*?\\end\{{{name}\*?\}}"
    own = lambda t: F.regexp_extract_all(t, F.lit(rx), F.lit(0))
    both = F.transform(own(translated), lambda x, i: F.coalesce(F.get(own(original), i), x))
    return F.array_join(F.zip_with(F.split(translated, rx, -1), both, lambda t, x: F.concat(t, F.coalesce(x, F.lit("")))), "")


def summary(abstract: Column, reply: Column) -> Column:
    """A short abstract as it is, else the model's summary, else the abstract's first 400 characters."""
    return F.when(F.length(abstract) < 50, abstract).otherwise(F.coalesce(reply, F.substring(abstract, 1, 400)))
