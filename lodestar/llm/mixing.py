"""Mixing sources to target weights, in DataFrame functions alone.

Capped water-filling: a source's share is its weight's part of all sizes, but at most ``epochs`` times its own size; what is cut off
goes to the others in proportion to their weights, until none is above its cap. Clamping the sources in order of cap / weight gives
that fixed point in one pass over one row per source: source k stays clamped as long as the level (what is left for
the unclamped, over their weights) is at least its cap / weight.

A source's target over its size says how often its documents come: whole repetitions for all of them, and once more for those that
come first in a seeded order, as long as their sizes stay within the rest. The cut in that order is exact to one document. It is found on
narrow rows: a histogram over ``slices`` of the order is summed per source and slice (combined before the shuffle), then the slice that
holds the cut is summed document by document. All rows are decided where they stand, by coming before their source's cut or not; only
repeated rows that all fall on a cut are numbered.

Scale: documents are never shuffled, but for those repeated rows; the largest window is one slice of the largest source, in numbers alone. Sources
are ranked and filled by range partitions with running sums, so their number has no bound; the table of sources is joined by broadcast up to
``most_broadcast`` bytes, else by Spark's own choice with skew handling.

Defined results: null text has size 0; a null source is a source of its own, last in order; a null doc_id is ordered by its text;
equal rows are interchangeable; a source of size 0 has target 0; an empty table gives no rows; columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, materialize


def words_of(column: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_of(seed: int, column: str = "doc_id", text: str = "text") -> Column:
    """A seeded place in the order, 0 to 2^48 - 1, from the md5 of seed and id (null: of the md5 of the text)."""
    own = F.coalesce(F.col(column).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 12), 16, 10).cast("long")


def _before(df: DataFrame, order: list[str], sums: dict[str, str], each: int) -> DataFrame:
    """df with, for each name in sums, the sum of that column over all rows that come before in order: by ranges of about ``each`` rows and their totals."""
    parts = max(1, -(-df.count() // each))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, *((F.col(f"_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()))


def water_filling(sources: DataFrame, epochs: float = 3.0, each: int = 100_000) -> DataFrame:
    """sources: source_size, weight, rank (and others). Adds target."""
    both = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rated = sources.withColumn("ratio", epochs * F.col("source_size") / F.col("weight"))
    filled = _before(rated, ["ratio", "rank"], {"less": "source_size", "lighter": "weight"}, each)
    level = (F.lit(float(both.size or 0)) - epochs * F.col("less")) / (F.lit(float(both.weight or 0)) - F.col("lighter"))
    # the level of the first source that isn't clamped holds for it and all after it
    at = filled.withColumn("level", level).where("ratio >= level").agg(F.min(F.struct("ratio", "rank", "level")).alias("at")).first().at
    return sources.withColumn("target", F.round(F.least(epochs * F.col("source_size"), F.col("weight") * F.lit(at.level if at else 0.0)), 6))


def mix_sources(docs: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and times of each row of docs; carry: further columns of docs, other than these. Options: see ``_mixed``."""
    found = _mixed(docs, carry=carry, **options)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", *(F.col(f"_carry_{c}").alias(c) for c in carry))


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: float = 3.0, seed: int = 42, slices: int = 4096, most_broadcast: int = 16 << 20, each: int = 100_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, times, and _carry_... for each column to carry.

    Sources in order of code points, null last, weigh weights[0], weights[1], ... and so on around. each: sources that one task ranks and fills.
    """
    width = 2**48 // slices
    none, source = F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), words_of("text").alias("size"), none.alias("_none"), source.alias("_source"), order_of(seed).alias("_order"),
        *(F.col(c).alias(f"_carry_{c}") for c in carry),
    ).withColumn("_slice", F.floor(F.col("_order") / width).cast("int"))
    key = ["_none", "_source"]
    sums = materialize(rows.groupBy(*key, "_slice").agg(F.sum("size").alias("held")), "slices")
    per_source = sums.groupBy(*key).agg(F.sum("held").alias("source_size"), F.lit(1).alias("one"))
    ranked = _before(per_source, key, {"rank": "one"}, each).drop("one")
    weighed = materialize(ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "weighed")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = water_filling(weighed, epochs, each).withColumn("whole", whole).withColumn("spare", F.col("target") - F.col("whole") * F.col("source_size"))
    # the slice in which each source's rest runs out, and what the slices before it hold
    up_to = Window.partitionBy(*key).orderBy("_slice")
    slice_of = (
        sums.withColumn("upto", F.sum("held").over(up_to)).join(filled.select(*key, "spare"), key).where(F.col("upto") > F.col("spare"))
        .groupBy(*key).agg(F.min(F.struct("_slice", "upto", "held", "spare")).alias("c"))
        .select(*key, F.col("c._slice").alias("_slice"), (F.col("c.upto") - F.col("c.held")).alias("before"), "c.spare")
    )
    slice_of = _spread(slice_of, most_broadcast)
    # in that slice, the first place whose documents don't all fit, and how many of them do
    place = F.struct("_order", "doc_id", "size")
    narrow = rows.select("doc_id", "size", *key, "_order", "_slice").join(slice_of, [*key, "_slice"])
    each = narrow.groupBy(*key, "_order", "doc_id", "size", "before", "spare").agg(F.count(F.lit(1)).alias("many"))
    in_order = Window.partitionBy(*key).orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = each.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("many")).over(in_order)).where("upto > spare")
    fits = F.floor((F.col("spare") - (F.col("upto") - F.col("size") * F.col("many"))) / F.col("size")).cast("long")
    cuts = over.groupBy(*key).agg(F.min(F.struct(place.alias("cut"), F.when(F.col("size") > 0, fits).otherwise(0).alias("fits"), "many")).alias("c")).select(*key, "c.*")
    plan = _spread(filled.select(*key, "source_size", "target", "whole", "spare").join(cuts, key, "left"), most_broadcast)
    marked = rows.join(plan, key)
    on_cut = F.coalesce(place == F.col("cut"), F.lit(False)) & (F.col("many") > 1) & (F.col("spare") > 0)
    more = (F.col("spare") > 0) & (F.col("cut").isNull() | (place < F.col("cut")) | ((place == F.col("cut")) & (F.col("fits") > 0)))
    own = ["doc_id", "size", "source_size", "target", "whole", *(f"_carry_{c}" for c in carry)]
    plain = marked.where(~on_cut).select(*own, more.alias("more"))
    numbered = marked.where(on_cut).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", *(f"_carry_{c}" for c in carry)))))
    both = plain.unionByName(numbered.select(*own, (F.col("_n") <= F.col("fits")).alias("more")))
    times = F.col("whole") + F.when(F.col("more"), 1).otherwise(0)
    return both.select("doc_id", "size", "source_size", "target", times.alias("times"), *(f"_carry_{c}" for c in carry))


def _spread(df: DataFrame, most_broadcast: int) -> DataFrame:
    """A written table of one row per source, marked for broadcast up to so many bytes."""
    written = materialize(df, "sources")
    size = written.agg(F.sum(F.octet_length("_source") + 128)).first()[0] or 0
    return F.broadcast(written) if size <= most_broadcast else written


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns, whatever these are named.

    Null text counts as size 0; a document without words is repeated like the others of its place; an empty table stays empty.
    """
    others = tuple(c for c in docs.columns if c != "doc_id")
    repeated = _mixed(docs, carry=others, **options).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return repeated.select(*(F.col("doc_id" if c == "doc_id" else f"_carry_{c}").alias(c) for c in docs.columns))
