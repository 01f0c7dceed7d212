"""Two versions side by side: rungs, order, comments, settings, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import logic_signature

KEY = ["project", "lddb", "guid"]


def diff_rungs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each changed rung: added, removed, layout only (the canvas size), or logic.
    Bodies are compared by digest; the texts do not travel."""
    side = lambda d, p: d.select(*KEY, F.unhex(F.sha2("data", 256)).alias(f"{p}_body"), F.unhex(logic_signature(F.col("data"))).alias(f"{p}_logic"), F.col("title").alias(f"{p}_title"))
    both = side(old, "old").join(side(new, "new"), KEY, "full")
    kind = F.when(F.col("old_body").isNull(), "added").when(F.col("new_body").isNull(), "removed").when(F.col("old_body") == F.col("new_body"), "same").when(F.col("old_logic") == F.col("new_logic"), "layout").otherwise("logic")
    return both.withColumn("change", kind).where("change <> 'same'").select(*KEY, "change", F.coalesce("new_title", "old_title").alias("title"))


def diff_programs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Programs that only one version has, and how many rungs they have there."""
    side = lambda d, p: d.groupBy("project", "lddb").agg(F.count("*").alias(p))
    both = side(old, "old_rungs").join(side(new, "new_rungs"), ["project", "lddb"], "full").where("old_rungs is null or new_rungs is null")
    return both.select("project", "lddb", F.when(F.col("old_rungs").isNull(), "new").otherwise("gone").alias("change"), F.coalesce("old_rungs", "new_rungs").alias("rungs"))


def change_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Opcodes and arguments that rungs of both versions hold more or less often than
    before: ``part`` (opcode or argument), ``value``, ``old_n``, ``new_n``.

    Both sides are ``(project, lddb, guid, op_index, opcode, argument)``, a row an
    operand; an operation without one has a null argument. Both versions are
    counted in one aggregation, so no two lists of a rung are compared.
    """

    def parts(d: DataFrame, p: str) -> DataFrame:
        ops = d.select(*KEY, "op_index", "opcode").distinct().select(*KEY, F.lit("opcode").alias("part"), F.col("opcode").alias("value"))
        args = d.where(F.col("argument").isNotNull()).select(*KEY, F.lit("argument"), F.concat_ws(" ", "opcode", "argument"))
        return ops.union(args).withColumns({"old_n": F.lit(int(p == "old")), "new_n": F.lit(int(p == "new"))})

    counts = parts(old, "old").union(parts(new, "new")).groupBy(*KEY, "part", "value").agg(F.sum("old_n").alias("old_n"), F.sum("new_n").alias("new_n")).where("old_n <> new_n")
    shared = old.select(*KEY).distinct().join(new.select(*KEY).distinct(), KEY, "left_semi")
    return counts.join(shared, KEY, "left_semi")


def reordered_rungs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rungs of both versions whose rank among these moved, and by how much."""
    both = old.select(*KEY, F.col("pos").alias("old_pos")).join(new.select(*KEY, F.col("pos").alias("new_pos")), KEY)
    rank = lambda c: F.row_number().over(Window.partitionBy("project", "lddb").orderBy(c, "guid"))
    return both.withColumn("old_rank", rank("old_pos")).withColumn("new_rank", rank("new_pos")).where("old_rank <> new_rank").select(*KEY, "old_rank", "new_rank", (F.col("new_rank") - F.col("old_rank")).alias("moved"))


def diff_comments(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select("project", "device", F.col("all_text").alias("old_text")).join(new.select("project", "device", F.col("all_text").alias("new_text")), ["project", "device"], "full")
    kind = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").when(F.col("old_text") != F.col("new_text"), "changed")
    return both.withColumn("change", kind).where("change is not null")


def diff_config(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``section, item`` values of two settings tables ``(key, settings map)``: only
    items that differ, with what is missing told apart from what is empty."""
    flat = lambda d, p: d.select(*key, F.explode("settings").alias("item", f"{p}_value"))
    both = flat(old, "old").withColumn("in_old", F.lit(True)).join(flat(new, "new").withColumn("in_new", F.lit(True)), [*key, "item"], "full")
    state = F.when(F.col("in_old").isNull(), "only new").when(F.col("in_new").isNull(), "only old").otherwise("both")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*key, "item", "old_value", "new_value", state.alias("availability"))


def diff_manifest(old: DataFrame, new: DataFrame, name: list[str], body: list[str]) -> DataFrame:
    """Names (the columns ``name``) whose row count or digest differs. A name's digest
    adds up 60 bits of each row's SHA-256 twice, so no order is needed and no
    name is gathered."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", *body), 256), at, 15), 16, 10).cast("decimal(38,0)"))
    side = lambda d, p: d.groupBy(*name).agg(F.count("*").alias(f"{p}_rows"), F.concat_ws("-", part(1), part(16)).alias(f"{p}_digest"))
    both = side(old, "old").join(side(new, "new"), name, "full")
    return both.where(~F.col("old_digest").eqNullSafe(F.col("new_digest")) | ~F.col("old_rows").eqNullSafe(F.col("new_rows"))).select(*name, "old_rows", "new_rows", F.col("old_digest").eqNullSafe(F.col("new_digest")).alias("same_digest"))
