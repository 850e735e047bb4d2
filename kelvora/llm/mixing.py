"""Mixing sources to target weights.

Sizes (words) are summed per source. Each source's target is its weight's share of the whole mix, at most
``most`` times its size; what exceeds that is shared again by weight. target / size is the source's rate: every
document is emitted floor(rate) times and once more with the fraction as probability, by a keyed hash of its id.

Defined results: a null text has size 0; null is a source of its own, last in order; a source of size 0 has target
0 and takes nothing; rows with the same doc_id are drawn alike; rows without one are drawn by their text; a very long
text counts whole; a table without rows gives none; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvora.llm.common import materialise, table, unused, words_of

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2.0
SEED = "mix"


def uniform(key: Column, seed: str = SEED) -> Column:
    """In [0, 1), by MD5 of the seed and the key: 48 bits, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size). A row per source is all that meets in one task.

    With sources ordered by cap / weight, the filled ones are a prefix: source j is filled exactly if its cap is at
    most its share of what the sources before it leave."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = weighed.select(
        "source", "source_size", "w", "cap",
        ((F.lit(total) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(rest)).alias("level"),
    )
    first = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("level").alias("level")))).over(whole)["level"]
    return level.withColumn("at", first).select("source", "source_size", F.when(F.col("at").isNull() | (F.col("cap") <= F.col("w") * F.col("at")), F.col("cap")).otherwise(F.col("w") * F.col("at")).alias("target"))


NAMES = ("size", "source_size", "target", "copies")


def plan(docs: DataFrame, names: Sequence[str] = NAMES, **how) -> DataFrame:
    """docs with size, source_size, target and copies, under these names."""
    size, whole, target, copies = names
    # The draw is made before the join, so that a caller who asks for no text moves none.
    drawn = unused(docs, "mixed_draw")
    sized = docs.select("*", F.size(words_of("text")).cast("long").alias(size), uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).alias(drawn))
    source = unused(sized, "mixed_source")
    told = targets(sized.select("source", F.col(size).alias("size")), **how).select(F.col("source").alias(source), F.col("source_size").alias(whole), F.col("target").alias(target))
    # A row per source, but hosts have no proven bound: it is written, so that Spark knows its size and broadcasts it only
    # below its own limit, without moving a document first.
    joined = sized.join(materialise(told, "targets"), F.col("source").eqNullSafe(F.col(source)))
    rate = F.when(F.col(whole) > 0, F.col(target) / F.col(whole)).otherwise(F.lit(0.0))
    return joined.withColumn(copies, (F.floor(rate) + F.when(F.col(drawn) < rate - F.floor(rate), 1).otherwise(0)).cast("long")).drop(source, drawn)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    names = [unused(docs, f"mixed_{n}") for n in NAMES]
    taken = plan(docs, names, **how).where(F.col(names[-1]) > 0)
    return taken.withColumn(unused(docs, "mixed_copy"), F.explode(F.sequence(F.lit(1), F.col(names[-1]).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS drawn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT source, source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, {MOST}::DOUBLE * source_size AS cap FROM per
), level AS (
  SELECT *, ({TOTAL}::DOUBLE * (SELECT sum(source_size) FROM per)
     - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv,
     row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn FROM weighed
), found AS (
  SELECT arg_min(lv, rn) AS lambda0 FROM level WHERE cap > w * lv
), target AS (
  SELECT source, source_size, CASE WHEN lambda0 IS NULL OR cap <= w * lambda0 THEN cap ELSE w * lambda0 END AS target FROM level, found
), rate AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || drawn), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rate
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
