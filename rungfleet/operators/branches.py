"""Conditions as tables of branches: a row a branch, with its literals as one array.

A condition is true if one of its branches is; a branch is true if all of its
literals ``(device, required)`` are, and one without literals always is. What a
join may multiply is counted first, so that a condition that would grow beyond a
limit is given up as too large before it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERALS = "array<struct<device:string,required:string>>"


def branch_table(cond: DataFrame, key: list[str]) -> DataFrame:
    """``key, lits`` from rows of literals ``(key, branch, device, required)``; a row
    without a device stands for a branch without literals."""
    one = F.when(F.coalesce("device", F.lit("")) != "", F.struct("device", "required"))
    return cond.groupBy(*key, "branch").agg(F.array_sort(F.collect_set(one)).cast(LITERALS).alias("lits")).where(~clashes(F.col("lits"))).select(*key, "lits").distinct()


def literal_rows(branches: DataFrame, key: list[str], most: int) -> DataFrame:
    """Rows of literals ``(key, branch, device, required)``; branches are numbered in the
    order of their literals. A key has at most ``most`` branches."""
    numbered = branches.groupBy(*key).agg(F.array_sort(F.collect_set("lits")).alias("all")).select(*key, F.posexplode("all").alias("branch", "lits"))
    return numbered.select(*key, "branch", F.explode_outer("lits").alias("l")).select(*key, "branch", F.coalesce("l.device", F.lit("")).alias("device"), F.coalesce("l.required", F.lit("")).alias("required"))


def flipped(lits: Column) -> Column:
    """The opposite of each plain literal; edges have none."""
    plain = F.filter(lits, lambda x: x["required"].isin("a", "b"))
    return F.transform(plain, lambda x: F.struct(x["device"].alias("device"), F.when(x["required"] == "a", "b").otherwise("a").alias("required")))


def clashes(lits: Column) -> Column:
    """Whether the literals ask one device to be on and off."""
    return F.coalesce(F.arrays_overlap(lits, flipped(lits)), F.lit(False))


def product(parts: Column) -> Column:
    """All ways to take one branch of each part, as an array of branches; those that
    clash are left out on the way. ``parts`` is an array of arrays of branches."""
    start = F.array(F.array().cast(LITERALS))
    step = lambda acc, part: F.filter(F.flatten(F.transform(acc, lambda x: F.transform(part, lambda y: F.array_sort(F.array_union(x, y))))), lambda z: ~clashes(z))
    return F.array_distinct(F.aggregate(parts, start.cast(f"array<{LITERALS}>"), step))


def conjoin(a: DataFrame, b: DataFrame, key: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both of two conditions: every branch of ``a`` with every one of ``b`` of the same
    key, and the keys for which that would be more than ``most`` branches."""
    sizes = a.groupBy(*key).agg(F.count("*").alias("na")).join(b.groupBy(*key).agg(F.count("*").alias("nb")), key).withColumn("large", F.col("na") * F.col("nb") > most)
    few = a.join(sizes.where("not large").select(*key), key).withColumnRenamed("lits", "la").join(b.withColumnRenamed("lits", "lb"), key)
    both = few.select(*key, F.array_sort(F.array_union("la", "lb")).alias("lits")).where(~clashes(F.col("lits"))).distinct()
    return both, sizes.where("large").select(*key)


def complement(branches: Column, most: int) -> Column:
    """The complement of an array of branches, as an array of branches: one opposite
    literal of each. Null with an edge, or where it could be more than ``most``."""
    plain = F.forall(branches, lambda b: F.forall(b, lambda x: x["required"].isin("a", "b")))
    size = F.aggregate(branches, F.lit(1.0), lambda acc, b: acc * F.size(b))
    parts = F.transform(branches, lambda b: F.transform(flipped(b), lambda x: F.array(x)))
    return F.when(plain & (size <= most), product(parts))
