"""Operator 2, mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S wants T / S copies of each of its documents: all get the whole
part, and the fraction is rounded by pairing. Two documents trade mass (fraction times words), which
way is drawn with the odds that keep both expectations, until one of them is a whole copy or none;
the other goes on to the next pair. Mass is never lost, so a source's words end within one document
of its target.

The pairing is a tree: chunks of a source's documents are folded first, what each chunk has left
over is folded with that of other chunks, until one document a source is left, which is drawn by
its own fraction. Draws come from hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, text_or_empty, unit

#: Documents that one fold is meant to take.
CHUNK = 128
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from source, source_size; one row a source.

    Weights repeat over the sources in the order of their code points, null last. share times all
    words are dealt by weight; what a source cannot take beyond most times its size is dealt anew
    among the others by weight. That is filling to a common level: sources are sorted by the level
    at which they are full, and the level follows from running sums. The windows hold one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = most * F.col("source_size")
    ranked = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double").alias("w"))
    order = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_ = F.sum("source_size").over(Window.partitionBy()) * share
    # The level if just the sources before this one were full; it is the level where the first is not.
    level = (all_ - full) / rest
    found = ranked.withColumns({"cap": cap, "level": level})
    open_ = F.col("cap") > F.col("level") * F.col("w")
    common = F.min(F.when(open_, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(Window.partitionBy())["level"]
    return found.withColumn("common", common).select("source", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"))


#: One step of the fold. acc: cur (the document in hand, or null) and out (documents decided, with up: 1 or 0).
#: With M the mass of both, the giving one of them ends as nothing unless M fills the taking one first.
FOLD = """
aggregate(
  items,
  named_struct('cur', CAST(NULL AS {item}), 'out', CAST(array() AS array<struct<item: {item}, up: int>>)),
  (acc, x) -> CASE WHEN acc.cur IS NULL THEN named_struct('cur', x, 'out', acc.out) ELSE
    element_at(transform(
      array(named_struct(
        'm', acc.cur.m + x.m,
        'up', least(acc.cur.w - acc.cur.m, x.m),
        'down', least(acc.cur.m, x.w - x.m),
        'draw', CAST(shiftrightunsigned(xxhash64(acc.cur.h, x.h, {seed}L), 11) AS DOUBLE) * {unit})),
      t -> CASE
        WHEN t.draw * (t.up + t.down) < t.down AND t.m >= acc.cur.w THEN
          named_struct('cur', {x_m}, 'out', concat(acc.out, array(named_struct('item', acc.cur, 'up', 1))))
        WHEN t.draw * (t.up + t.down) < t.down THEN
          named_struct('cur', {cur_all}, 'out', concat(acc.out, array(named_struct('item', x, 'up', 0))))
        WHEN t.m >= x.w THEN
          named_struct('cur', {cur_m}, 'out', concat(acc.out, array(named_struct('item', x, 'up', 1))))
        ELSE
          named_struct('cur', {x_all}, 'out', concat(acc.out, array(named_struct('item', acc.cur, 'up', 0))))
      END), 1) END)
"""


def _fold(item: str, seed: int) -> Column:
    made = lambda who, mass: f"named_struct('k', {who}.k, 'h', {who}.h, 'w', {who}.w, 'm', {mass})"
    return F.expr(FOLD.format(item=item, seed=seed, unit=repr(2.0**-53), x_m=made("x", "t.m - acc.cur.w"), cur_all=made("acc.cur", "t.m"), cur_m=made("acc.cur", "t.m - x.w"), x_all=made("x", "t.m")))


def copies(items: DataFrame, seed: int = 2, chunk: int = CHUNK) -> DataFrame:
    """source, k, up (1 or 0) for items of source, k (any key), w (weight, positive) and m (mass, 0 to w).

    Over each source the sum of w where up is 1 is that of m, to within one w.
    """
    items = cut(items.select("source", F.struct("k", F.xxhash64("k", F.lit(seed)).alias("h"), F.col("w").cast("double").alias("w"), F.col("m").cast("double").alias("m")).alias("item")))
    item = items.schema["item"].dataType.simpleString()
    most = items.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    left, decided, level = items, [], 0
    while True:
        last = most <= chunk
        groups = 1 if last else math.ceil(most / chunk)
        if last:
            dealt = left.withColumn("bucket", F.lit(0))
        else:  # every source has groups of its own number, so that a small one is not spread thin
            sizes = cut(left.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n")))
            bucket = F.pmod(F.xxhash64("item.h", F.lit(level)), F.ceil(F.col("n") / chunk))
            dealt = left.join(small(sizes), F.col("source").eqNullSafe(F.col("s"))).select("source", "item", bucket.alias("bucket"))
        folded = dealt.groupBy("source", "bucket").agg(F.expr("sort_array(collect_list(item))").alias("items")).select("source", _fold(item, seed + level).alias("acc"))
        folded = cut(folded)
        decided.append(folded.select("source", F.explode("acc.out").alias("x")).select("source", "x.item.k", "x.up"))
        left = folded.filter("acc.cur IS NOT NULL").select("source", F.col("acc.cur").alias("item"))
        if last:
            break
        most, level = groups, level + 1
    drawn = F.when(unit(F.col("item.h"), F.lit(seed), F.lit(-1)) * F.col("item.w") < F.col("item.m"), 1).otherwise(0)
    decided.append(left.select("source", "item.k", drawn.alias("up")))
    return reduce(DataFrame.union, decided)


#: Tasks over which the repeated rows of one key are dealt.
SALT = 64


def _mark(text: Column) -> Column:
    """Tells texts of rows with one doc_id, source and size apart."""
    return F.xxhash64(text)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 2) -> DataFrame:
    """doc_id, source, size, mark (the text's hash), source_size, target, copies, more and rows, for each (doc_id, source, size, mark).

    docs: doc_id, text, source. size is the number of words (null text: 0). Of the rows that agree in all
    four, more get a copy beyond copies; at most one row's fraction an item is drawn, so that any number of repeated rows comes near its share. Items without words get the
    whole part of their source's ratio. Null doc_ids and sources are values like others. No rows: none.
    """
    text = text_or_empty()
    sized = docs.select("doc_id", "source", words(text).alias("size"), _mark(text).alias("mark"))
    found = cut(sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("rows")))
    totals = found.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = small(cut(targets(totals, share, most, weights).withColumnRenamed("source", "s")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = lambda df: df.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("copies", F.floor(ratio).cast("int")).withColumn("part", ratio - F.floor(ratio))
    sure = F.when(F.col("size") > 0, F.floor(F.col("part") * F.col("rows"))).otherwise(0)
    found = aimed(found).withColumn("more", sure.cast("long")).withColumn("rest", F.when(F.col("size") > 0, F.col("part") * F.col("rows") - F.col("more")).otherwise(0.0))
    found = found.withColumn("k", F.struct("doc_id", "size", "mark", "rows"))
    up = copies(found.filter("rest > 0").select("source", "k", F.col("size").cast("double").alias("w"), (F.col("size") * F.col("rest")).alias("m")), seed)
    back = aimed(up.select("source", "up", "k.*")).withColumn("more", (F.floor(F.col("part") * F.col("rows")) + F.col("up")).cast("long"))
    columns = ["doc_id", "source", "size", "mark", "source_size", "target", "copies", "more", "rows"]
    return back.select(*columns).union(found.filter("NOT rest > 0").select(*columns))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; of rows that are alike the first ones get the copies that not all can have."""
    each = mix(docs).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = (F.col("copies") + F.when(F.col("_i") <= F.col("more"), 1).otherwise(0)) * F.col("size")
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs, with all columns in their order, with every row repeated as often as the mix takes it.

    Null texts count as empty, null ids and sources are values like others, long texts count whole. Rows that are alike are dealt
    over tasks and numbered there, so that exactly as many of them as the mix says get one copy more. No rows: none.
    """
    found = mix(docs, **how).filter("copies > 0 OR more > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("mark").alias("_m"), F.col("copies").alias("_n"), F.col("more").alias("_more"), F.col("rows").alias("_rows"))
    text = text_or_empty()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_a"), F.col("source").alias("_b"), words(text).alias("_c"), _mark(text).alias("_e"))
    both = rows.join(found, F.col("_a").eqNullSafe(F.col("_d")) & F.col("_b").eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_z")) & (F.col("_e") == F.col("_m")))
    # All of them, or none, get one more copy: nothing to number.
    plain = both.filter("_more = 0 OR _more >= _rows").select("_row", F.when(F.col("_more") > 0, F.col("_n") + 1).otherwise(F.col("_n")).alias("_n"))
    some = cut(both.filter("_more > 0 AND _more < _rows").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT))))
    key = ["_d", "_s", "_z", "_m"]
    counts = some.groupBy(*key, "_salt").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))  # SALT rows a key
    starts = counts.select(*[F.col(c).alias(f"_s{c}") for c in (*key, "_salt")], F.coalesce(before, F.lit(0)).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in (*key, "_salt")]
    numbered = some.withColumn("_i", F.row_number().over(Window.partitionBy(*key, "_salt").orderBy("_salt"))).join(starts, reduce(lambda a, b: a & b, same))
    dealt = numbered.select("_row", F.when(F.col("_start") + F.col("_i") <= F.col("_more"), F.col("_n") + 1).otherwise(F.col("_n")).alias("_n"))
    taken = plain.union(dealt).filter("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
