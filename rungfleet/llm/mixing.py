"""Mix sources to target weights with exact budgets.

Each document gets a hash key, documents are range-sorted by that key within
their source, prefix sums of sizes are computed in two levels (inside a key
range, and over the ranges), and each source is cut at its budget. A budget
above the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, from 1, by ``source`` with null last. The sources are
    range-sorted into partitions; each one's place is that in its partition after
    all of the partitions before, so no task holds them all."""
    placed = materialize(sizes.sort(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    # monotonically_increasing_id() has the partition in its upper bits and counts from 0 below
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each partition of the sort
    return placed.join(offsets, "part").select("source", "source_size", (F.col("before") + F.col("place") + 1).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of each source, from ``sizes(source, source_size)``.

    Sources take ``weights`` in turn, ordered by code point with null last, and
    share the sum of all sizes in those proportions. No target exceeds ``most``
    times its source; the excess goes to the others by weight, over and over
    until none is above: each round is one sum over the sources.
    """
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    shares = ranked(sizes).withColumn("weight", F.get(wheel, ((F.col("rank") - 1) % len(weights)).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    shares = materialize(shares.withColumn("ratio", F.col("cap").cast("double") / F.col("weight")).select("source", "source_size", "weight", "cap", "ratio"))
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    # the target of a source that is not capped, by weight; it only rises
    level, before = 0.0, None
    while before != (before := shares.where(F.col("ratio") <= level).agg(F.count("*"), F.sum("cap")).first() if level else (0, None)):
        weight = shares.where(F.col("ratio") > level).agg(F.sum("weight")).first()[0]
        if not weight:
            break
        level = (total - (before[1] or 0)) / weight
    capped = F.col("ratio") <= F.lit(level)
    return shares.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``doc_id, source, size, source_size, target, taken``, one row per
    row of ``docs(doc_id, text, source)``. A document's size is its number of
    words; ``taken`` counts repeats, is a whole number of epochs plus at most
    one more, and the document at the cut gives its first words only, so that
    every source's sum is its target rounded to a whole word.

    The key is the MD5 of the id, so reruns agree. Rows are range-sorted by
    source, key, size, MD5 of the text and a salt; Spark cuts the ranges from a
    sample, so one source, one id, or even one repeated row with a third of all
    rows is spread over as many ranges as its share asks for, and no source is
    ever sorted in one task.

    Null or empty texts have size 0 and are taken 0 times. Rows with a null id
    share one key. Rows that agree in id are ordered by size and MD5 of the
    text; rows that agree in all of these are interchangeable. A null source is
    a source of its own. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.size(words(F.col("text"))).cast("long").alias("size"),
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("of"),  # never null
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
            F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("tie"),
            F.rand(7).alias("salt"),
        )
    )
    order = ("key", "size", "tie", "salt")
    placed = materialize(sized.sort("of", *order).withColumn("part", F.spark_partition_id()))
    ranges = materialize(placed.groupBy("of", "source", "part").agg(F.sum("size").alias("range_size")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    # a row for each source and range that holds some of it
    over_ranges = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = ranges.withColumn("offset", F.sum("range_size").over(over_ranges) - F.col("range_size"))
    offsets = (
        offsets.alias("o")
        .join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select("of", "part", "offset", "source_size", "target")
        .withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    inside = Window.partitionBy("of", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("offset") + F.col("within") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return (
        placed.withColumn("within", F.sum("size").over(inside))
        .join(offsets, ["of", "part"])
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))
    )
