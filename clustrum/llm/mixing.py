"""Mixing sources to target weights: repetition rates per source, whole and hash-seeded copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, read_table, spare
from .textkit import WORD_END

#: Rows of the source table up to which it is broadcast; a larger one is joined by a shuffle that splits hot keys.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_END)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 digest of the key and the seed: the same in every engine and run."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code-point order, null last, get the weights in turn. The shares are min(cap, weight * level); the level
    is the largest of (total - caps of sources that fill up sooner) / (weights of the others), because it only rises
    while capped sources are taken out and only falls afterwards.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - before) / rest)
    per = per.withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


#: The columns that mix_plan() adds.
PLAN = ("_size", "_source_size", "_target", "_copies")


def _draw_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with what each row draws by: its doc_id; a row without one, or with one that others have too, also draws by
    its text and its place in the input, else equal rows would all be taken or none."""
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(f"{name}_id")), "mix-repeated")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    if again.isEmpty():
        return docs.withColumn(name, key)
    if again.count() <= BROADCAST_SOURCES:
        again = F.broadcast(again)
    here = F.concat(key, F.lit("|"), F.md5(F.coalesce("text", F.lit(""))), F.lit("|"), F.col(f"{name}_at").cast("string"))
    told = docs.withColumn(f"{name}_at", F.monotonically_increasing_id()).join(again.withColumn(f"{name}_met", F.lit(True)), F.col("doc_id").eqNullSafe(F.col(f"{name}_id")), "left")
    return told.withColumn(name, F.when(F.col(f"{name}_met"), here).otherwise(key)).drop(f"{name}_at", f"{name}_id", f"{name}_met")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """docs with _size, _source_size, _target and _copies.

    A source whose words number S and whose target is T has the rate T / S (0 if S is 0). Each document gets
    floor(rate) copies and one more with probability rate - floor(rate), drawn from a hash of doc_id and seed.
    A null or empty text has size 0; a null source is a source of its own; rows without a doc_id, or that repeat one,
    draw by their text and place in the input too, so a rerun over the same files agrees; an empty table gives an empty
    result; columns of docs that have one of the new names are replaced, others are kept whatever they are called.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in PLAN])
    of, key = spare([*docs.columns, *PLAN], "_of", "_drawn_by")
    sized = _draw_key(docs, key).withColumn("_size", word_count(F.col("text")))
    targets = cut(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, max_repeats), "mix-targets")
    targets = targets.select(F.col("source").alias(of), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    out = sized.join(targets, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    extra = uniform(F.col(key), seed) < rate - F.floor(rate)
    return out.withColumn("_copies", F.floor(rate).cast("long") + extra.cast("long")).drop(key)


def emit(plan: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, without the plan's columns."""
    kept = [c for c in plan.columns if c not in PLAN]
    (copy,) = spare(plan.columns, "_copy")
    taken = plan.where(F.col("_copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return taken.select(*kept)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mix_plan(docs)
    return plan.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"),
        F.col("_target").cast("double").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS cap FROM per
), filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM filled
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null') || '|7'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM copied
"""
