"""Sharding by proportional stratified interleaving.

The rows of each source are ranked in a seeded random order. Sorted by
fractional rank, (rank - 1/2) / rows of the source, every stretch of the whole
order holds the sources in proportion, so that equal cuts are equal mixtures.

Ranks are worked out without a sort of a whole source in one task: rows are put
into buckets by the leading bits of their random key, the buckets are counted,
and a rank is the rows in the buckets before plus the row's place in its own.
The same is done for the place in the whole order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
SEED = "7"
#: Rows that a bucket shall hold on average.
BUCKET = 50_000


def _place(df: DataFrame, by: list[str], bucket: F.Column, order: list, name: str) -> DataFrame:
    """df with the 1-based place of each row within its `by`, in the order of (bucket, *order)."""
    df = df.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    offsets = counts.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__row", row).join(offsets, on).withColumn(name, F.col("__before") + F.col("__row")).drop("__bucket", "__row", "__before", *(f"__{i}" for i in range(len(keys))))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, shard (from 0) and place (from 1, within the shard) of every row of docs.

    A null source is a source of its own; a null doc_id has a random key as any
    other. Rows of equal doc_id and source are interchangeable and keep a place
    each. Shards differ by a row at most; with fewer rows than shards some are
    empty. Texts aren't read, so their length doesn't matter. Other columns are
    ignored; an empty table gives an empty one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    n = base.count()
    buckets = max(1, -(-n // BUCKET))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = base.withColumn("key", digest)
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bucket = F.floor(lead * buckets / F.lit(1 << 32)).cast("int")
    ranked = _place(keyed, ["source"], bucket, ["key", F.col("doc_id").asc_nulls_first()], "rank")
    sizes = base.groupBy("source").agg(F.count("*").alias("size")).select(F.col("source").alias("__source"), "size")
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # (2 rank - 1) / (2 size), compared through its rounded-down share of SCALE and then exactly as it stands
    fraction = (2 * F.col("rank") - 1) / (2 * F.col("size")).cast("double")
    ranked = ranked.withColumn("fraction", fraction)
    cut = F.floor(F.col("fraction") * buckets).cast("int")
    placed = _place(ranked, [], cut, ["fraction", F.col("source").asc_nulls_first(), "rank"], "position")
    at = F.floor((F.col("position") - 1) * shards / F.lit(n)).cast("int")
    first = F.ceil(at.cast("long") * n / F.lit(shards)).cast("long")
    return placed.select("doc_id", "source", at.alias("shard"), (F.col("position") - first).alias("place"))


ORACLE = f"""
WITH k AS (SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) AS rank, count(*) OVER (PARTITION BY source) AS size, count(*) OVER () AS n FROM k),
p AS (SELECT doc_id, source, n, row_number() OVER (ORDER BY (2 * rank - 1) / CAST(2 * size AS DOUBLE), source NULLS FIRST, rank) AS position FROM r),
s AS (SELECT *, CAST(((position - 1) * {SHARDS}) // n AS INTEGER) AS shard FROM p)
SELECT doc_id, source, shard, CAST(position - ((CAST(shard AS BIGINT) * n + {SHARDS} - 1) // {SHARDS}) AS BIGINT) AS place FROM s
"""
