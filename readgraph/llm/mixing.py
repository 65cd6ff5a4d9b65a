"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash, and a source takes the documents below a threshold of it. The threshold comes
from histograms: words are summed by source and leading hash bits, the bucket in which the running sum
passes the budget is found, and only the documents of that bucket are counted again by the next bits.
After the last bits the bucket holds one hash value. Nothing is sorted but the buckets, at most
2**BITS for a source, and a document is taken or left by one comparison.

A budget above the source's size takes every document once or twice first; the thresholds of larger
budgets thus hold those of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size
BITS, LEVELS = 12, 5
#: Source tables up to so many rows (about 100 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source as a key without nulls, size, and a 60-bit hash of the key."""
    digits = F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 1, 15)
    return docs.select(
        F.col(f"`{key}`").alias("__id"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("t")).alias("__source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(digits, 16, 10).cast("long").alias("__hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of sources: ``__source, source_size`` in; adds ``target``.

    Sources in order weigh by ``weights``, repeating, and share all words; none gets more than ``most``
    times its size, and the excess goes to the others by weight. So target = least(most * size, level *
    weight). In order of most * size / weight, the level that is left when all sources before are at their
    most rises up to the first source that stays below its own, and falls after it: it is the largest level
    that fits its source. One row a source: the windows over all
    sources run in one task, whatever the number of documents.
    """
    by_source, all_rows = Window.orderBy("__source"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_source) - 1) % len(weights)) + 1)
    weighed = sizes.withColumn("w", choice.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(order), F.lit(0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    with_level = weighed.withColumn("level", level.cast("double"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    return with_level.withColumn("level", F.max(fits).over(all_rows)).select(
        "__source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: the key, ``size, source_size, target, taken`` and ``copies`` (taken / size).

    Size is the number of words; a null text has none. A source without words has a target of 0, and its
    documents are taken 0 times. Documents with one key have one hash and are taken alike, repeated rows
    too; the threshold falls on the hash value with which the sum is nearest to the target (the smaller
    one if both are as near). An empty table gives an empty one; other columns are not read.
    """
    sized = materialize(_sized(docs, key, text, source), "mix-sizes")
    totals = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = materialize(targets(totals, weights, most).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    rows = sized.filter("size > 0").select("__source", "size", "__hash")
    bound = plan.select("__source", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        here = rows.join(side(bound), "__source").filter(F.shiftrightunsigned("__hash", shift + BITS) == F.col("prefix"))
        counted = here.groupBy("__source", F.shiftrightunsigned("__hash", shift).alias("bucket"), "rest", "below").agg(F.sum("size").alias("mass"))
        running = Window.partitionBy("__source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        reached = counted.withColumn("upto", F.col("below") + F.sum("mass").over(running)).filter(F.col("upto") > F.col("rest"))
        first = reached.groupBy("__source").agg(F.min(F.struct("bucket", "upto", "mass", "rest")).alias("b"))
        bound = first.select("__source", "b.rest", (F.col("b.upto") - F.col("b.mass")).alias("below"), F.col("b.bucket").alias("prefix"), F.col("b.mass").alias("mass"))
        if level < LEVELS:
            bound = bound.drop("mass")
        if level == 1:  # from here on only the boundary buckets, one of 2**BITS, are read
            bound = materialize(bound, "mix-bound")
            own = rows.join(side(bound.select("__source", "prefix")), "__source").filter(F.shiftrightunsigned("__hash", shift) == F.col("prefix"))
            rows = materialize(own.drop("prefix"), "mix-boundary")
    nearer = (F.col("below") + F.col("mass") - F.col("rest")) < (F.col("rest") - F.col("below"))
    threshold = bound.select("__source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))
    decided = materialize(plan.join(threshold, "__source", "left"), "mix-thresholds")
    copies = F.col("whole") + F.coalesce(F.col("__hash") < F.col("threshold"), F.col("rest") > 0).cast("long")
    return (
        sized.join(side(decided), "__source")
        .withColumn("copies", F.least(F.lit(most).cast("long"), copies))
        .select(F.col("__id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "__source")
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (0 to ``most`` times)."""
    decided = mix(docs, key, text, source, weights, most).filter("copies > 0")
    decided = decided.groupBy(F.col(f"`{key}`").alias("id"), F.col("__source").alias("s")).agg(F.max("copies").alias("n"))
    row, own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("t"))
    rows = docs.select(row, F.col(f"`{key}`").alias("row_id"), own.alias("row_source"))
    joined = rows.join(decided, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_source") == F.col("s")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * s / w AS ratio,
         CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS lam
  FROM sources WINDOW b AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, s, least(CAST(3 * s AS DOUBLE), (SELECT max(lam) FROM levels WHERE lam <= ratio) * w) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN s > 0 THEN least(3, CAST(floor(target / s) AS BIGINT)) ELSE 0 END AS whole FROM plan),
hashes AS (
  SELECT source, h, sum(size) AS mass FROM sized GROUP BY source, h),
running AS (
  SELECT source, h, mass, sum(mass) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
chosen AS (
  SELECT r.source, r.h, r.upto <= p.target - p.whole * p.s
         OR (r.upto - r.mass <= p.target - p.whole * p.s
             AND r.upto - (p.target - p.whole * p.s) < (p.target - p.whole * p.s) - (r.upto - r.mass)) AS more
  FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, p.s AS source_size, p.target,
       CAST(d.size * least(3, p.whole + CAST(c.more AS BIGINT)) AS BIGINT) AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
