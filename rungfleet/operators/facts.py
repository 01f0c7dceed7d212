"""Fact tables from occurrences: members of runs, value flow, rung lists, totals.

Inputs have the columns of the ``occ`` view; every key starts with ``project``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.devices import format_device

RUNG = ["project", "lddb", "pos"]


def expand_members(occ: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """One row for each device an occurrence covers. The first keeps the
    occurrence's comment; the others have their own or none. Runs of unknown
    length (0) give their first device only."""
    run = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.coalesce("range_len", F.lit(1))) - 1))
    m = occ.withColumn("run_offset", run).withColumn("member_number", F.col("number") + F.col("run_offset"))
    m = m.withColumn("member_device", F.when(F.col("run_offset") == 0, F.col("device")).otherwise(format_device(F.col("device_type"), F.col("member_number"))))
    if comments is None:
        return m
    own = comments.select(F.col("project").alias("cp"), F.col("device_type").alias("ct"), F.col("number").alias("cn"), F.coalesce("all_text", F.lit("")).alias("own_comment"))
    joined = m.join(own, (F.col("project") == F.col("cp")) & (F.col("device_type") == F.col("ct")) & (F.col("member_number") == F.col("cn")), "left")
    return joined.withColumn("member_comment", F.when(F.col("run_offset") == 0, F.coalesce("comment", F.lit(""))).otherwise(F.coalesce("own_comment", F.lit("")))).drop("cp", "ct", "cn", "own_comment")


def reads(access: Column) -> Column:
    return access.isin("read", "both")


def writes(access: Column) -> Column:
    return access.isin("write", "both")


def access_counts(members: DataFrame) -> DataFrame:
    """Reads, writes and plain references of each device; ``both`` counts in two of
    these and once in the total."""
    a = F.col("access")
    return members.groupBy("project", "member_device").agg(
        F.count_if(reads(a)).alias("reads"), F.count_if(writes(a)).alias("writes"), F.count_if(~reads(a) & ~writes(a)).alias("refs"), F.count("*").alias("total"), F.count_if(F.col("run_offset") > 0).alias("covered")
    )


def flow_edges(occ: DataFrame) -> DataFrame:
    """Source and destination operands of each operation. An operand that is both
    flows into itself as a read-modify-write."""
    key = [*RUNG, "op_index"]
    side = lambda c, p: occ.where(c).select(*key, *[F.col(x).alias(f"{p}_{x}") for x in ("occ_id", "device", "arg_index", "range_len", "parse_status")])
    edges = side(reads(F.col("access")), "source").join(side(writes(F.col("access")), "destination"), key)
    rmw = F.col("source_device") == F.col("destination_device")
    count = F.when((F.col("source_range_len") == 0) | (F.col("destination_range_len") == 0), 0).otherwise(F.greatest("source_range_len", "destination_range_len"))
    sure = F.when((F.col("source_parse_status") == "exact") & (F.col("destination_parse_status") == "exact"), "exact").otherwise("partial")
    return edges.select(*key, "source_occ_id", "source_device", "source_arg_index", "destination_occ_id", "destination_device", "destination_arg_index", "source_range_len", "destination_range_len", count.alias("range_count"), rmw.alias("read_modify_write"), sure.alias("confidence"))


def flow_unresolved(occ: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Operations whose flow is not known: a partly parsed operand, an opcode of which
    nobody knows what it writes, or a destination that is not there.

    ``known(opcode, write_args)`` says which operands an opcode writes (none: an
    empty list); without it, an operation without any write lacks its destination.
    An operation's operands (``arg_index``) are few, so their set is small.
    """
    ops = occ.groupBy(*RUNG, "op_index").agg(
        F.count_if(writes(F.col("access"))).alias("n_writes"), F.count_if(F.col("parse_status") != "exact").alias("n_partial"), F.min("opcode").alias("opcode"), F.collect_set("arg_index").alias("present")
    )
    missing, unknown = F.col("n_writes") == 0, F.lit(False)
    if known is not None:
        ops = ops.join(known.select("opcode", "write_args"), "opcode", "left")
        missing, unknown = F.size(F.array_except("write_args", "present")) > 0, F.col("write_args").isNull()
    reason = F.when(F.col("n_partial") > 0, "partial rung").when(unknown, "unknown opcode").when(missing, "missing destination")
    return ops.withColumn("reason", reason).where("reason is not null").select(*RUNG, "op_index", "reason")


def carry_titles(rungs: DataFrame, key: list[str], order: list[str], title: str = "title") -> DataFrame:
    """``section``: the last title at or before each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rungs.withColumn("section", F.coalesce(F.last(F.when(F.col(title) != "", F.col(title)), ignorenulls=True).over(w), F.lit("")))


def as_of_step(rungs: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """``step`` of the last block start at or before each rung's position."""
    both = rungs.select(*key, "pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("start_step")).union(starts.select(*key, "pos", F.lit(0), F.col("step").cast("long")))
    w = Window.partitionBy(*key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("step", F.last("start_step", ignorenulls=True).over(w)).where("kind = 1").select(*key, "pos", "step")


def rung_lists(occ: DataFrame) -> DataFrame:
    """Condition devices, driven devices and all devices of each rung, sorted."""
    bits = F.col("role").isin("a", "b")
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("device")))), ",")
    return occ.groupBy(*RUNG).agg(sets(bits).alias("conditions"), sets(writes(F.col("access"))).alias("outputs"), sets(F.lit(True)).alias("devices"), F.count("*").alias("operands"))


def device_stats(occ: DataFrame) -> DataFrame:
    """Occurrences, distinct driving rungs, condition uses, roles by frequency, and
    the first location of each device. Roles are counted before devices are."""
    drives = writes(F.col("access"))
    by_role = occ.groupBy("project", "device", "role").agg(F.count("*").alias("n"))
    roles = by_role.groupBy("project", "device").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "role"))), lambda r: F.concat(r["role"], F.lit(":"), (-r["k"]).cast("string"))), " ").alias("roles"))
    stats = occ.groupBy("project", "device").agg(
        F.count("*").alias("occurrences"), F.count_distinct(F.when(drives, F.struct("lddb", "pos"))).alias("driver_rungs"), F.count_if(F.col("role").isin("a", "b")).alias("condition_uses"), F.min(F.struct("pos", "step", "occ_id")).alias("first")
    )
    return stats.join(roles, ["project", "device"]).select("project", "device", "occurrences", "driver_rungs", "condition_uses", "roles", F.col("first.pos").alias("first_pos"), F.col("first.step").alias("first_step"))


def covered_ranges(occ: DataFrame) -> DataFrame:
    return occ.where("range_len > 1").select("project", "lddb", "pos", "device", "device_type", F.col("number").alias("start_number"), "range_len", "access")


def table_stats(occ: DataFrame) -> DataFrame:
    """Row counts and totals of a project's index."""
    return occ.groupBy("project").agg(
        F.count("*").alias("occurrences"), F.count_distinct("device").alias("devices"), F.count_distinct("lddb", "pos").alias("rungs"), F.count_if(writes(F.col("access"))).alias("writes"), F.count_if(reads(F.col("access"))).alias("reads"), F.sum("range_len").alias("covered")
    )


def first_reads(members: DataFrame) -> DataFrame:
    """The first reading position of each device in each program, and how many
    reads have no position."""
    return members.where(reads(F.col("access"))).groupBy("project", "member_device", "lddb").agg(F.min("pos").alias("first_pos"), F.count_if(F.col("pos").isNull()).alias("unknown_positions"))


def classify_access(ops: DataFrame, opcode_args: DataFrame, families: DataFrame) -> DataFrame:
    """``access`` of each operand ``(opcode, argc, arg_index)`` by its opcode's family in
    ``families(opcode, family)``: a contact or compare reads, a coil writes,
    arithmetic with at most two operands updates its last one; else by the operand
    table ``opcode_args(opcode, arg_index, access)``, else ``ref``. An index register
    is always read. Both tables are joined, so that they may be of any size."""
    table = opcode_args.select("opcode", "arg_index", F.col("access").alias("listed"))
    family, last = F.col("family"), F.col("arg_index") == F.col("argc") - 1
    access = (
        F.when(F.col("is_index"), "read")
        .when(family.isin("contact", "compare"), "read")
        .when(family == "coil", "write")
        .when((family == "arithmetic") & (F.col("argc") <= 2), F.when(last, "both").otherwise("read"))
        .otherwise(F.coalesce("listed", F.lit("ref")))
    )
    return ops.join(families.select("opcode", "family"), "opcode", "left").join(table, ["opcode", "arg_index"], "left").withColumn("access", access).drop("listed", "family")


def build_occurrences(instructions: DataFrame, opcode_args: DataFrame, families: DataFrame, comments: DataFrame) -> DataFrame:
    """One row for each device operand of ``instructions(project, program, step,
    title, opcode, operands)``: its parsed device, access, covered devices,
    constants and comment.

    ``opcode_args`` may say how many devices an operand covers: ``count_arg`` is the
    operand that holds a count, ``span_num / span_den`` scale it, rounded up,
    ``by_digits`` multiplies it by the bits of a digit-specified operand, and ``words``
    is the width where there is no count. A count that is a device, or below one,
    gives 0: the end is not known. An indexed operand covers one. An operand
    without ``count_arg`` is no run, as the source of a fill, or the count of a
    rotation."""
    from ..functions.devices import split_device
    from ..functions.operands import parse_operand

    consts = F.array_join(F.filter("operands", lambda x: x.rlike(r"^[KHE]-?[0-9A-F.]+$")), " ")
    ops = instructions.withColumn("argc", F.size("operands")).withColumn("const_args", consts).select("project", "program", "step", "title", "opcode", "argc", "const_args", "operands", F.posexplode("operands").alias("arg_index", "operand"))
    # before explode Spark may put a test of the array's size, which repeats the parse
    parsed = ops.withColumn("p", F.explode_outer(parse_operand(F.col("operand")))).where("p.kind <> 'constant'").withColumn("is_index", F.col("p.kind") == "index").withColumn("s", F.explode(F.array(split_device(F.col("p.device"))))).where("s is not null")
    # columns that the table leaves out have their neutral value
    given = {"count_arg": F.lit(None).cast("int"), "span_num": F.lit(1), "span_den": F.lit(1), "by_digits": F.lit(False), "words": F.lit(1)}
    spans = opcode_args.select("opcode", "arg_index", *[(F.coalesce(F.col(c), v) if c in opcode_args.columns else v).alias(c) for c, v in given.items()])
    count = F.regexp_extract(F.get("operands", F.col("count_arg")), r"^K(\d+)$", 1).try_cast("long")
    scaled = F.ceil(count * F.col("span_num") / F.col("span_den")) * F.when(F.col("by_digits"), F.col("p.run")).otherwise(1)
    plain = F.greatest(F.col("p.run"), F.coalesce("words", F.lit(1)))
    length = F.when(F.col("p.kind") == "index", 1).when(F.col("p.kind") == "indexed", 1).when(F.col("count_arg").isNull(), plain).when(F.coalesce(count, F.lit(0)) < 1, 0).otherwise(scaled).cast("int")
    named = classify_access(parsed, opcode_args, families).join(spans, ["opcode", "arg_index"], "left").withColumn("range_len", length)
    own = comments.select("project", F.col("device").alias("device_name"), F.coalesce("all_text", F.lit("")).alias("own"))
    return named.withColumn("device_name", F.col("p.device")).join(own, ["project", "device_name"], "left").select(
        "project", "program", "step", "title", "opcode", "arg_index", F.col("device_name").alias("device"), F.col("s.device_type").alias("device_type"), F.col("s.number").alias("number"), "access", "range_len", "const_args", F.coalesce("own", F.lit("")).alias("comment")
    )
