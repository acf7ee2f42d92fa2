"""Mixing sources to target weights by capped water-filling.

Each source gets its weight's share of all words, but no more than `epochs` times its own; what is clamped is shared
again among the others by weight until nothing is above its cap. A document is then taken whole as often as its
source's target asks, and once more for the fractional epoch if it falls under a seeded cut through the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import store

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Hex digits of the seeded hash that name a bucket; a bucket holds 1/65536 of its source.
BUCKET_DIGITS = 4


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """`sources` (source, source_size: one row a source) with its target in words.

    Sources in code-point order, null last, weigh `weights` in turn. With sources sorted by cap / weight, those that
    are clamped are a prefix: source i is clamped if what it and all later sources would get per weight, after the
    caps of the earlier ones, reaches its own cap / weight. All sums are whole numbers until the last division.
    """
    one = F.lit(0)
    ranked = sources.withColumn("rank", F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(epochs).cast("long"))
    order = Window.partitionBy(one).orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(one)
    water = (
        capped.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("clamped", F.col("cap").cast("decimal(38,0)") * F.col("shares") <= F.col("rest").cast("decimal(38,0)") * F.col("weight"))
        .withColumn("free", F.max(F.when(~F.col("clamped"), F.struct("shares", "rest"))).over(whole))
    )
    level = (F.col("free.rest") * F.col("weight")).cast("double") / F.col("free.shares").cast("double")
    return water.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(level)).select("source", "source_size", "weight", "target")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(store.WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix", carry: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, repeats for each row of `df` (doc_id, text, source, any others).

    Size is the number of words (null text: 0). A null source is a source of its own, the last. Reruns agree: the cut
    depends on the seed, doc_id and size only; repeated rows are cut one by one. The words taken from a source differ
    from its target by half a document at most. An empty table gives no rows. With `carry` the whole input row comes along
    as struct column `row`.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    sized = df.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("cut_key"), *row)
    table = store.save(sized.withColumn("bucket", F.substring("cut_key", 1, BUCKET_DIGITS)), "mix-sizes")
    by_bucket = store.save(table.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = store.save(water_fill(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs), "mix-targets")
    epochs_of = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(epochs_of)).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = plan.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    filled = by_bucket.join(plan.select("of", "part"), same).withColumn(
        "before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bucket_size")
    )
    # The bucket in which the cut falls; all before it are taken, none after.
    edge = filled.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("bucket_size") >= F.col("part"))).select(
        "of", F.col("bucket").alias("edge"), F.col("before").alias("edge_before")
    )
    plan = store.save(plan.join(edge.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2"), "mix-plan")
    n = plan.count()
    rows = table.join(store.small(plan, n, 200), same)
    at_edge = (F.col("bucket") == F.col("edge")).cast("boolean")
    plain = rows.filter(F.col("edge").isNull() | ~at_edge).withColumn("more", F.coalesce(((F.col("bucket") < F.col("edge")) & (F.col("size") > 0)).cast("long"), F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("cut_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.col("edge_before")
    cut = rows.filter(at_edge).withColumn("upto", upto).withColumn("more", ((F.col("upto") * 2 - F.col("size") <= F.col("part") * 2) & (F.col("size") > 0)).cast("long")).drop("upto")
    mixed = plain.unionByName(cut).withColumn("repeats", F.col("whole") + F.col("more"))
    return mixed.select("doc_id", "size", "source", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats", *(["row"] if carry else []))


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The rows of `df` as often as the mix takes them."""
    taken = mix(df, carry=True, **how).filter("repeats > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("repeats").cast("int"))).alias("row")).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(store.documents(spark, sf_dir))


SQL = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))) AS cut_key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM r),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shares
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * shares <= rest * weight AS clamped FROM o),
f AS (SELECT max(shares) FILTER (NOT clamped) AS free_shares, arg_max(rest, shares) FILTER (NOT clamped) AS free_rest FROM c),
g AS (SELECT source, source_size,
             CASE WHEN clamped THEN cap::DOUBLE ELSE (free_rest * weight)::DOUBLE / free_shares::DOUBLE END AS target FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
q AS (SELECT *, round(target - whole * source_size)::BIGINT AS part FROM p),
u AS (SELECT t.*, q.source_size, q.target, q.whole, q.part,
             sum(size) OVER (PARTITION BY t.source ORDER BY cut_key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
v AS (SELECT *, whole + (upto * 2 - size <= part * 2 AND size > 0)::BIGINT AS repeats FROM u)
SELECT doc_id, size, source, source_size, target, (repeats * size)::BIGINT AS taken, repeats FROM v
"""
