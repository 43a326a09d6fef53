"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows of each source are ranked in a seeded order, all rows are sorted by fractional rank
(rank - 1/2) / (rows of the source), and the order is cut into shards of equal row counts, so every shard has each
source in the mixture's share, up to rounding.

No rank is computed over a whole source or the whole table in one task.  A source is split into buckets
by leading bits of the seeded hash, in proportion to its rows; a rank is the number of rows in earlier
buckets (from a small table of bucket counts) plus the rank within the bucket.  The global order is
split in the same way by fractional rank.  Buckets hold about four times the square root of the number of
rows, whatever the skew: that balances what a task ranks against the number of buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored

SHARDS = 16
SEED = "quill-7"
LEAST_BUCKET = 500


def interleave(
    df: DataFrame, source: str = "source", identity: tuple[str, ...] = ("doc_id",), shards: int = SHARDS, seed: str = SEED, bucket: int | None = None
) -> DataFrame:
    """``df`` with columns ``shard`` and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one row apart.  Rows are ordered by the md5 of the seed and the identity
    columns, then by the identity itself; rows equal in it are in no set order, and their
    other columns decide nothing.  A null source is a stratum of its own.  Existing columns named
    ``shard`` or ``slot`` are replaced.  An empty table gives an empty result.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(quoted(c)) for c in names])
    key = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]).cast("binary"))
    keyed = stored(
        df.select(
            row.alias("row"),
            F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
            key.alias("key"),
            # the first 48 bits of the key as a share of one
            (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)).alias("u"),
            F.struct(*[F.col(c) for c in identity]).alias("id"),
        ),
        "keyed",
    )
    # as a written table its size is known: Spark broadcasts a small one and no row is dealt by its source, while a large
    # one is joined by a shuffle whose hot partitions can be split
    sizes = stored(keyed.groupBy("stratum").agg(F.count("*").alias("n")), "sizes")
    total = keyed.count()
    bucket = bucket or max(LEAST_BUCKET, 4 * math.isqrt(total))
    part = F.floor(F.col("u") * F.ceil(F.col("n") / bucket))
    # dealt by bucket before the ranks: else they would be computed where the join has put whole sources
    placed = keyed.join(sizes, "stratum").withColumn("part", part).repartition("stratum", "part")
    before = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("stratum", "part").count().select("stratum", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("stratum", "part").orderBy("key", "id")
    ranked = placed.withColumn("r", F.row_number().over(within)).join(offsets, ["stratum", "part"])
    share = (F.col("r") + F.col("earlier") - F.lit(0.5)) / F.col("n")
    slices = max(1, -(-total // bucket))
    spread = stored(
        ranked.select("row", "stratum", "key", "id", share.alias("share")).withColumn("slice", F.floor(F.col("share") * slices)), "spread"
    )
    # one row for each slice: total / bucket rows
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("slice").orderBy("share", "stratum", "key", "id")
    position = F.col("start") + F.col("i") - 1
    placed = spread.withColumn("i", F.row_number().over(inside)).join(starts, "slice").select("row", position.alias("position"))
    shard = F.expr(f"((position + 1) * {shards} - 1) div {max(1, total)}")
    return placed.withColumn("shard", shard).select(
        *[F.col("row")[c].alias(c) for c in names],
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"position - (shard * {total}) div {shards}").alias("slot"),
    )


def assign(docs: DataFrame) -> DataFrame:
    """The contract's columns: only ids, sizes and checksums travel, texts stay where they are read."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = interleave(small, identity=("doc_id", "text_crc32", "size"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


ORACLE_SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), b AS (
  SELECT doc_id, source, encode(coalesce(text, '')) AS body FROM documents
), d AS (
  SELECT doc_id, source, octet_length(body) + 1 AS size,
    xor(list_reduce(list_transform(range(octet_length(body)), lambda k: ('0x' || substr(hex(body), (2 * k + 1)::bigint, 2))::bigint),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295) AS text_crc32
  FROM b, crc
), k AS (
  SELECT *, md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || text_crc32 || ':' || size) AS key,
    coalesce('=' || source, '') AS stratum FROM d
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key) - 0.5::double) / count(*) OVER (PARTITION BY stratum) AS share FROM k
), p AS (
  SELECT *, row_number() OVER (ORDER BY share, stratum, key) - 1 AS position, count(*) OVER () AS total FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (((position + 1) * {SHARDS} - 1) // total)::int AS shard,
  position - ((((position + 1) * {SHARDS} - 1) // total) * total) // {SHARDS} AS slot, NULL::int AS grown_shard, source
FROM p
"""
