"""Lookups over the fact tables: where used, context, search, areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import RUNG, device_stats, expand_members, reads, writes


def first_values(df: DataFrame, key: list[str], value: str, k: int, name: str) -> DataFrame:
    """The ``k`` smallest distinct values of each key, joined by commas. Spark keeps
    ``k`` rows a key on the map side, so no key is gathered whole."""
    by = Window.partitionBy(*key).orderBy(value)
    few = df.select(*key, value).where(F.col(value).isNotNull()).distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return few.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ",").alias(name))


def where_used(members: DataFrame, devices: DataFrame) -> DataFrame:
    """Every use of the devices in ``devices(project, member_device)``, named or
    covered by a run."""
    use = F.when(F.col("run_offset") == 0, "named").otherwise("covered")
    kind = F.when(F.col("access") == "both", "read+write").otherwise(F.col("access"))
    return members.join(devices, ["project", "member_device"], "left_semi").select("project", "member_device", "occ_id", "device", "run_offset", use.alias("found_as"), kind.alias("use"), "lddb", "pos", "role")


def indexed_counts(operands: DataFrame) -> DataFrame:
    """How many operand texts of each device type carry an index register."""
    return operands.where(F.col("device").rlike(r"Z\d+$")).groupBy("project", "device_type").agg(F.count("*").alias("indexed"))


def same_row(occ: DataFrame, devices: DataFrame) -> DataFrame:
    """Outputs and conditions of the rungs that hold one of ``devices(project, device)``."""
    rungs = occ.join(devices, ["project", "device"], "left_semi").select(*RUNG).distinct()
    hit = occ.join(rungs, RUNG, "left_semi")
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("device")))), ",")
    return hit.groupBy(*RUNG).agg(sets(writes(F.col("access"))).alias("outputs"), sets(F.col("role").isin("a", "b")).alias("conditions"))


def block_context(rungs: DataFrame, hits: DataFrame, n: int, key: list[str], order: str = "pos") -> DataFrame:
    """The ``n`` rungs before and behind each hit ``(key, order)`` in its program.
    Each hit names its 2n + 1 row numbers, so the join is an equal join."""
    numbered = rungs.withColumn("row_no", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    at = numbered.join(hits.select(*key, order).distinct(), [*key, order], "left_semi").select(*key, F.col(order).alias("hit"), F.explode(F.sequence(F.col("row_no") - n, F.col("row_no") + n)).alias("row_no"), F.col("row_no").alias("hit_no"))
    return at.join(numbered, [*key, "row_no"]).select(*key, "hit", order, (F.col("row_no") - F.col("hit_no")).alias("distance"))


def search_comments(comments: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """Comments that hold one of the terms, first ``limit`` by device and project."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("all_text").contains(t.lower())
    return comments.where(hit).orderBy("device", "project").limit(limit)


def area_of(devices: DataFrame, areas: DataFrame, block: int = 64) -> DataFrame:
    """The first area (smallest ``area_no``) of its project that holds each device,
    if any.

    Areas are cut into blocks of numbers, so that the interval join is an equal
    join on type and block with a test, whatever the number of areas.
    """
    spread = areas.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_value") / block), F.floor(F.col("end_value") / block))))
    d = devices.withColumn("block", F.floor(F.col("number") / block))
    hit = d.alias("d").join(spread.alias("a"), ["project", "device_type", "block"], "left").where(F.col("a.area_no").isNull() | ((F.col("d.number") >= F.col("a.start_value")) & (F.col("d.number") <= F.col("a.end_value"))))
    best = hit.where("area_no is not null").groupBy("project", "device_type", "number").agg(F.min_by(F.struct("area_no", "kind", "unit_name"), "area_no").alias("area"))
    return devices.join(best, ["project", "device_type", "number"], "left").select(*[devices[c] for c in devices.columns], F.col("area.area_no").alias("area_no"), F.col("area.kind").alias("area_kind"), F.col("area.unit_name").alias("unit_name"))


def device_cards(occ: DataFrame, comments: DataFrame, areas: DataFrame) -> DataFrame:
    """A row for each device: uses, driving rungs, condition uses, where its value
    comes from, the rungs that drive it (first three positions), its comment, and
    how many runs of other devices cover it."""
    key = ["project", "device"]
    covering = expand_members(occ).where("run_offset > 0").groupBy("project", F.col("member_device").alias("device")).agg(F.count("*").alias("covering_runs"))
    stats = device_stats(occ).select(*key, "occurrences", "driver_rungs", "condition_uses")
    drivers = first_values(occ.where(writes(F.col("access"))), key, "pos", 3, "drivers")
    placed = area_of(occ.select(*key, "device_type", "number").distinct(), areas)
    j = stats.join(placed, key).join(comments.select(*key, "all_text"), key, "left").join(covering, key, "left").join(drivers, key, "left")
    kind = F.when(F.col("driver_rungs") > 0, "driven").when(F.col("area_no").isNotNull(), F.concat("area_kind", F.lit(" area"))).when(F.col("device_type") == "X", "input").otherwise("internal")
    none = lambda c: F.coalesce(c, F.lit(""))
    return j.select(*key, "occurrences", "driver_rungs", "condition_uses", kind.alias("source"), none("drivers").alias("drivers"), none("all_text").alias("comment"), F.coalesce("covering_runs", F.lit(0).cast("long")).alias("covering_runs"))


def external_inputs(occ: DataFrame, areas: DataFrame) -> DataFrame:
    """Condition devices that no rung of their project drives, by where their
    value comes from, with counts of ON and OFF uses."""
    driven = occ.where(writes(F.col("access"))).select("project", "device").distinct()
    used = occ.where(F.col("role").isin("a", "b")).join(driven, ["project", "device"], "left_anti")
    per = used.groupBy("project", "device", "device_type", "number").agg(F.count_if(F.col("role") == "a").alias("on_uses"), F.count_if(F.col("role") == "b").alias("off_uses"), F.count_distinct("lddb").alias("programs"))
    placed = area_of(per, areas)
    kind = F.when(F.col("area_no").isNotNull(), F.concat(F.col("area_kind"), F.lit(" area"))).when(F.col("device_type") == "X", "input").when(F.col("device_type").isin("SM", "SB"), "special").otherwise("internal")
    return placed.withColumn("source", kind).select("project", "device", "source", "on_uses", "off_uses", "programs")


def search_instructions(occ: DataFrame, opcode: str, limit: int) -> DataFrame:
    return occ.where(F.col("opcode").contains(opcode)).orderBy("pos", "step", "occ_id").limit(limit)


def impact_of_contact(occ: DataFrame, target: str) -> DataFrame:
    """Rungs of each project that use the target as a contact, and what they drive."""
    used = occ.where((F.col("device") == target) & F.col("role").isin("a", "b")).select(*RUNG).distinct()
    return occ.where(writes(F.col("access"))).join(used, RUNG, "left_semi").groupBy("project").agg(F.count_distinct("lddb", "pos").alias("rungs"), F.count_distinct("device").alias("driven"))


def conditions_with_contact(cond: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each branch of the conditions that drive a proposal's target, before and after
    the contact is added in series, and what that does to it: ``changed``, ``same``
    (the branch has the contact already) or ``never`` (it has the contrary one).

    ``cond(project, lddb, pos, out_device, branch, device, required)`` has a row a
    literal, so a branch without any is not listed; ``proposals(project,
    out_device, contact, contact_required)`` has a row for each contact to add.
    """
    literal = lambda device, required: F.concat_ws(" ", required, device)
    at = ["project", "lddb", "pos", "out_device", "branch"]
    branches = cond.groupBy(*at).agg(F.array_sort(F.collect_set(literal("device", "required"))).alias("literals"))
    both = branches.join(proposals.distinct(), ["project", "out_device"])
    added = literal("contact", "contact_required")
    contrary = literal(F.col("contact"), F.when(F.col("contact_required") == "a", "b").otherwise("a"))
    effect = F.when(F.array_contains("literals", contrary), "never").when(F.array_contains("literals", added), "same").otherwise("changed")
    after = F.array_join(F.array_sort(F.array_distinct(F.array_append("literals", added))), ", ")
    return both.select(*at, "contact", F.array_join("literals", ", ").alias("before"), after.alias("after"), effect.alias("effect"))


def access_basis(occ: DataFrame) -> DataFrame:
    """Uses of each access and role."""
    return occ.groupBy("project", "access", "role").agg(F.count("*").alias("n"), F.count_if(reads(F.col("access"))).alias("n_reads"))


def buffer_labels(offsets: DataFrame, labels: DataFrame, within: int = 16, axis: str = r"\[(\d+)\]") -> DataFrame:
    """``offsets(project, unit, offset)`` with the label of ``labels(project, unit, label_at,
    symbol)`` that names each: at the offset, else one below it, else the nearest
    lower one at most ``within`` away, which is then named with the distance.
    ``axis`` is the label's number by the pattern, counted from 1. Offsets without
    a label keep their row.

    An equal join on blocks of ``within + 1`` numbers, of which two can hold it.
    """
    block = lambda c: F.floor(F.col(c) / (within + 1))
    key = ["project", "unit"]
    spread = labels.select(*key, "label_at", "symbol", F.explode(F.array(block("label_at"), block("label_at") + 1)).alias("block"))
    at = offsets.select(*key, "offset").distinct().withColumn("block", block("offset"))
    near = at.join(spread, [*key, "block"]).where((F.col("label_at") <= F.col("offset")) & (F.col("offset") - F.col("label_at") <= within))
    best = near.groupBy(*key, "offset").agg(F.max(F.struct("label_at", "symbol")).alias("b"))
    away = F.col("offset") - F.col("b.label_at")
    named = F.when(away <= 1, F.col("b.symbol")).otherwise(F.concat_ws(" +", F.col("b.symbol"), away.cast("string")))
    number = F.regexp_extract(F.coalesce("b.symbol", F.lit("")), axis, 1)
    best = best.select(*key, "offset", F.col("b.label_at").alias("label_at"), named.alias("symbol"), F.when(number != "", number.cast("int") + 1).alias("axis"))
    return offsets.join(best, [*key, "offset"], "left")


def module_transfers(occ: DataFrame, labels: DataFrame, opcodes: tuple[str, ...] = ("FROM", "DFRO", "DFROM", "TO", "DTO")) -> DataFrame:
    """Transfers between module memory and devices, one row a rung: the unit (a device
    or the first constant), the buffer offset as a constant base and its index
    register (from ``detail``: ``base=K..+Z..``), the data device, and the label that is
    exactly at the base, of any unit of the project (``labels`` as in
    ``buffer_labels``; the smallest unit of several)."""
    f = occ.where(F.col("opcode").isin(*opcodes))
    order = F.struct("arg_index", "occ_id")
    first = lambda c, value: F.min(F.when(c, F.struct(order.alias("o"), value.alias("v"))))["v"]
    base = F.regexp_extract(F.coalesce("detail", F.lit("")), r"base=K(-?\d+)\+Z(\d+)", 1)
    index = F.regexp_extract(F.coalesce("detail", F.lit("")), r"base=K(-?\d+)\+Z(\d+)", 2)
    is_data = (F.col("access") == "write") | (F.col("opcode").isin("TO", "DTO") & (F.col("arg_index") == 2))
    g = f.groupBy(*RUNG).agg(
        first(F.lit(True), F.col("opcode")).alias("opcode"), first((F.col("arg_index") == 0) & (F.col("device_type") != "Z"), F.col("device")).alias("unit_device"), first(F.lit(True), F.split(F.coalesce("const_args", F.lit("")), ",")[0]).alias("unit_const"),
        first(base != "", base.cast("long")).alias("base"), first(base != "", index.cast("int")).alias("index_register"), first(is_data, F.col("device")).alias("data_device"),
    )
    named = labels.groupBy("project", F.col("label_at").alias("base")).agg(F.min(F.struct("unit", "symbol")).alias("l"))
    return g.join(named, ["project", "base"], "left").select(*RUNG, "opcode", F.coalesce("unit_device", F.when(F.col("unit_const") != "", F.concat(F.lit("K"), F.regexp_replace("unit_const", "^K", ""))), F.lit("?")).alias("unit"), "base", "index_register", F.coalesce("data_device", F.lit("")).alias("data_device"), F.coalesce("l.symbol", F.lit("")).alias("symbol"))


def module_settings(occ: DataFrame, role: str, value: str, names: dict[str, str]) -> DataFrame:
    """Settings of each rung side by side, one column a role."""
    return occ.groupBy(*RUNG).agg(*[F.max(F.when(F.col(role) == r, F.col(value))).alias(n) for r, n in names.items()])


def station_usage(occ: DataFrame, areas: DataFrame) -> DataFrame:
    """Devices and uses in each area, with eight examples."""
    n = occ.groupBy("project", "device_type", "number", "device").agg(F.count("*").alias("n"))
    placed = area_of(n, areas).where("area_no is not null")
    examples = first_values(placed, ["project", "area_no"], "device", 8, "examples")
    return placed.groupBy("project", "area_no").agg(F.count("*").alias("devices"), F.sum("n").alias("uses")).join(examples, ["project", "area_no"])


def network_graph(occ: DataFrame, areas: DataFrame) -> DataFrame:
    """Edges from projects to the areas they use, and from a project's areas to their
    units."""
    used = area_of(occ.select("project", "device_type", "number").distinct(), areas).where("area_no is not null")
    name = F.concat(F.lit("area "), F.col("area_no").cast("string"))
    return used.select("project", F.col("project").alias("source"), name.alias("target"), F.col("area_kind").alias("edge")).distinct().union(areas.select("project", name, "unit_name", F.lit("unit")).distinct())
