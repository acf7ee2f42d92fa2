"""Case results, histograms, costs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a million input and output tokens, by model (fixed values).
PRICES = {"gpt-4o-mini": ("0.15", "0.60"), "gpt-5.1": ("1.25", "10.00")}


def cost(inputs: Column, outputs: Column, model: str = "gpt-4o-mini") -> Column:
    """Exact decimal dollars of a request."""
    a, b = (F.lit(x).cast("decimal(10,4)") for x in PRICES[model])
    return ((inputs.cast("decimal(18,0)") * a + outputs.cast("decimal(18,0)") * b) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,9)")


def backoff(attempt: Column, first: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most))


def histogram(df: DataFrame, column: str, order: str, but: str = "cli_output_tail:") -> DataFrame:
    """value, n, first: how often each element of an array column occurs; ties go by first occurrence."""
    each = df.select(F.col(order).alias("o"), F.posexplode(column).alias("p", "value")).filter(~F.col("value").startswith(but))
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first")).orderBy(F.desc("n"), "first")


def totals(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def in_tier(df: DataFrame, tier: str) -> DataFrame:
    """Rows of a tier; all and * pass every row, a missing tier is extended."""
    t = tier.strip().lower() or "all"
    if t in ("all", "*"):
        return df
    if t not in ("smoke", "extended"):
        raise ValueError(f"unknown tier: {tier}")
    return df.filter(F.lower(F.trim(F.coalesce(F.nullif("tier", F.lit("")), F.lit("extended")))) == t)


def since_last(df: DataFrame, order: str, marker: Column) -> DataFrame:
    """Rows from the last one on that the marker is true of; all rows without one.

    The marker's place is one aggregate value, joined back: no window over the whole table.
    """
    last = df.agg(F.coalesce(F.max(F.when(marker, F.col(order))), F.min(order)).alias("last_mark"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(order) >= F.col("last_mark")).drop("last_mark")


def markdown_rows(df: DataFrame) -> DataFrame:
    """line: a table row for each case (case_id, label, ok, seconds, warnings)."""
    status = F.when(F.col("ok"), "PASS").otherwise("FAIL")
    cells = [F.col("case_id").cast("string"), F.col("label"), status, F.col("seconds").cast("string"), F.array_join(F.slice("warnings", 1, 3), ", ")]
    return df.select("case_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def timeout_stage(*exists: Column) -> Column:
    """How far a timed-out case came, from which artefacts exist: translation, normalised, raw, logs, original, folder."""
    names = ("translate_or_later", "normalize_or_later", "extract_or_later", "extract_in_progress", "downloaded_pdf_or_pre_extract", "creating_paper_dir_or_downloading_pdf")
    out = F.lit("unknown")
    for name, there in reversed(list(zip(names, exists))):
        out = F.when(there, F.lit(name)).otherwise(out)
    return out


def token_breakdown(system: Column, user: Column, glossary: Column) -> Column:
    """struct of estimated input tokens by part, a quarter of the characters each; the system prompt holds the glossary, a shorter one counts as 0."""
    size = lambda c: F.length(c) / 4
    terms = F.when(F.coalesce(glossary, F.lit("{}")) == "{}", 0.0).otherwise(size(glossary))
    whole = lambda c: c.cast("bigint")
    return F.struct(whole(F.when(size(system) < terms, 0.0).otherwise(size(system) - terms)).alias("system"), whole(terms).alias("glossary"), whole(size(user)).alias("document"), whole(size(system) + size(user)).alias("total"))


def prompt(*parts: Column) -> Column:
    """Parts of a prompt on lines of their own; blank ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.rlike(r"[^\t\n\f\r ]")), "\n")


def compared(df: DataFrame, kind: str = "renderer") -> DataFrame:
    """kind, total, successes, rate, seconds of the successes: the two sides of a comparison, and how much faster each is than the slowest."""
    rows = df.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successes"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("seconds"))), F.lit(0.0)).alias("seconds"))
    slowest = rows.agg(F.max("seconds").alias("slowest"))
    return rows.crossJoin(F.broadcast(slowest)).withColumn("rate", F.col("successes") / F.col("total")).withColumn("speedup", F.try_divide("slowest", "seconds")).drop("slowest")
