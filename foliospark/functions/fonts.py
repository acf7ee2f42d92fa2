"""Column functions on font names, and the fonts that take their place in a target language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of names by kind (fixed values).
MATH = "cmsy|cmmi|cmex|msam|msbm|math|symbol"
SANS = "arial|helvetica|sans|calibri|verdana"
MONO = "courier|mono|consolas|typewriter|cmtt"
#: Target fonts by language and kind; others use the default row (fixed values).
TARGETS = (
    ("*", "serif", "Noto Serif"), ("*", "sans", "Noto Sans"), ("*", "mono", "Noto Sans Mono"),
    ("zh", "serif", "Noto Serif CJK SC"), ("zh", "sans", "Noto Sans CJK SC"), ("ja", "serif", "Noto Serif CJK JP"), ("ja", "sans", "Noto Sans CJK JP"),
)


def family(name: Column) -> Column:
    plain = F.regexp_replace(name, r"^[^+]*\+", "")
    for part in ("-Bold", "-Italic", "-BoldItalic", "-Regular", "Bold", "Italic", "Regular", "Light", "Medium"):
        plain = F.replace(plain, F.lit(part), F.lit(""))
    return F.trim(plain)


def style(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("bold") & low.contains("italic"), "bolditalic").when(low.contains("bold"), "bold").when(low.rlike("italic|oblique"), "italic").otherwise("regular")


def is_math(name: Column) -> Column:
    return F.lower(name).rlike(MATH)


def is_mono(name: Column) -> Column:
    return F.lower(name).rlike(MONO)


def is_serif(name: Column) -> Column:
    """Serif unless a name says otherwise."""
    return ~F.lower(name).rlike(SANS)


def with_targets(df: DataFrame, lang: str) -> DataFrame:
    """df(font, kind) with target and scale: by language and kind, else the default; mathematical fonts keep themselves."""
    rows = df.sparkSession.createDataFrame(list(TARGETS), "lang string, kind string, name string")
    own = F.broadcast(rows.filter(F.col("lang") == lang).select("kind", F.col("name").alias("own")))
    usual = F.broadcast(rows.filter("lang = '*'").select("kind", F.col("name").alias("usual")))
    scale = 0.95 if lang in ("zh", "ja", "ko") else 1.05 if lang == "ru" else 1.0
    math = is_math(F.col("font"))
    joined = df.join(own, "kind", "left").join(usual, "kind", "left")
    return joined.withColumn("target", F.when(math, F.col("font")).otherwise(F.coalesce("own", "usual"))).withColumn("scale", F.when(math, 1.0).otherwise(scale)).drop("own", "usual")
