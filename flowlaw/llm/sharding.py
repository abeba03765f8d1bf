"""Operator 9, sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; the rank as a fraction of
the source orders all rows, and equal cuts of that order are the shards, so that each of them has
the mixture of the whole. Counts of shards differ by one row at most (the law "rows").

Neither the ranks nor the order are taken in one task. Both come from even bins: the bins' counts
are summed up over a small table (one row per bin), and rows are ranked inside their bin only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, text_or_empty

#: Rows that a bin is meant to hold, and the most bins, whose counts one task sums up.
BIN, BINS = 250, 1 << 16
#: A key with more rows than this share of all is spread.
KEYS = 10_000


def _ranked(rows: DataFrame, strata: list[str], bin_: str, order: list[str | Column], name: str) -> DataFrame:
    """rows with their rank from 0 by (bin_, *order) within the strata."""
    counts = rows.groupBy(*strata, bin_).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*strata, bin_, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*strata, bin_).orderBy(*order)
    return rows.join(starts, [*strata, bin_]).withColumn(name, F.col("_start") + F.row_number().over(within) - 1).drop("_start")


def interleave(rows: DataFrame, key: Column, source: Column, shards: int = 16, seed: int = 9) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard).

    key identifies a row; rows of one key and one source lie side by side in
    the order of their columns, so repeated rows get neighbouring places. Rows without a key, and those of a key with over 250 rows and a ten-thousandth of all, are
    shuffled by a number that they get here, so any number of them is spread. A null source is a source of its own. Without rows the result has none. The added columns replace any of the same name.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    named = rows.select(F.struct(*keep).alias("_row"), F.coalesce(source.cast("string"), F.lit("")).alias("_source"), source.isNull().alias("_none"), key.cast("string").alias("_key"))
    most = max(BIN, named.count() // KEYS)
    often = named.filter("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_times")).filter(F.col("_times") > most)  # KEYS rows at most
    lone = F.concat(F.coalesce("_key", F.lit("null")), F.lit(" "), F.monotonically_increasing_id())
    own = F.when(F.col("_key").isNull() | F.col("_times").isNotNull(), lone).otherwise(F.col("_key"))
    marked = named.join(F.broadcast(often), "_key", "left").select("_row", "_source", "_none", F.md5(F.concat_ws(":", F.lit(str(seed)), own)).alias("_mark"))
    whole = cut(marked)
    sizes = cut(whole.groupBy("_source", "_none").agg(F.count("*").alias("_size")))
    n = sizes.agg(F.sum("_size")).first()[0] or 0
    bins = min(max(1, n // BIN), BINS)
    # The mark's first 12 hexadecimal digits are spread evenly over the source's bins.
    own = F.greatest(F.lit(1), F.least(F.lit(BINS), F.floor(F.col("_size") / BIN)))
    marked = whole.join(small(sizes), ["_source", "_none"]).withColumn("_bin", F.floor(F.conv(F.substring("_mark", 1, 12), 16, 10).cast("long") / F.lit(float(16**12)) * own).cast("long"))
    ranked = _ranked(marked, ["_source", "_none"], "_bin", ["_mark", "_row"], "_rank")
    part = ranked.withColumn("_part", (2 * F.col("_rank") + 1) / (2 * F.col("_size"))).drop("_bin").withColumn("_bin", F.least(F.floor(F.col("_part") * bins), F.lit(bins - 1)).cast("long"))
    placed = _ranked(cut(part.withColumn("_all", F.lit(0))), ["_all"], "_bin", ["_part", "_none", "_source"], "_place")
    shard = F.expr(f"CAST((_place * {shards}) DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(CAST(_shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    return placed.withColumn("_shard", shard).select("_row.*", F.col("_shard").alias("shard"), (F.col("_place") - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 9) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, law, shard, slot, grown_shard of each document.

    docs: doc_id, text and source; other columns are not read. A null text counts as empty, a null source is one of its own, and rows
    without a doc_id, repeated rows and texts of any length have their places like others. No rows: none.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleave(rows, F.col("doc_id"), F.col("source"), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
