"""Inventories: device maps, dictionaries, metrics, tables of contents, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import RUNG, reads, writes
from .lookup import first_values


def merged_intervals(intervals: DataFrame, key: list[str]) -> DataFrame:
    """``key, start_at, end_at``: touching or overlapping closed intervals
    ``(key, start_at, end_at)`` as one. The window sorts a key's intervals, so
    equal ones are reduced to one first."""
    w = Window.partitionBy(*key).orderBy("start_at", "end_at")
    reach = F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    one = intervals.groupBy(*key, "start_at").agg(F.max("end_at").alias("end_at"))
    marked = one.withColumn("new", F.when(reach.isNull() | (F.col("start_at") > reach + 1), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "island").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("island")


def device_map(occ: DataFrame, min_free: int, max_gaps: int) -> DataFrame:
    """Used devices, range, span, density and the largest free gaps of each type."""
    key = ["project", "device_type"]
    spans = occ.where("range_len > 0").select(*key, F.col("number").alias("start_at"), (F.col("number") + F.col("range_len") - 1).alias("end_at"))
    merged = merged_intervals(spans, key)
    w = Window.partitionBy(*key).orderBy("start_at")
    gaps = merged.withColumn("next", F.lead("start_at").over(w)).withColumn("gap", F.col("next") - F.col("end_at") - 1)
    ranked = gaps.where(F.col("gap") >= min_free).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("gap"), "end_at"))).where(F.col("rank") <= max_gaps)
    free = ranked.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "end_at", "gap"))), lambda g: F.concat((g["end_at"] + 1).cast("string"), F.lit("("), g["gap"].cast("string"), F.lit(")"))), " ").alias("free"))
    total = merged.groupBy(*key).agg(F.sum(F.col("end_at") - F.col("start_at") + 1).alias("used"), F.min("start_at").alias("lowest"), F.max("end_at").alias("highest"))
    span = F.col("highest") - F.col("lowest") + 1
    return total.join(free, key, "left").select(*key, "used", "lowest", "highest", span.alias("span"), F.round(100.0 * F.col("used") / span, 1).alias("density_pct"), F.coalesce("free", F.lit("")).alias("free"))


def device_dictionary(comments: DataFrame, occ: DataFrame) -> DataFrame:
    """A project's comments and use side by side, whichever side a device is on."""
    use = occ.groupBy("project", "device").agg(F.count_if(reads(F.col("access"))).alias("reads"), F.count_if(writes(F.col("access"))).alias("writes"), F.array_join(F.array_sort(F.collect_set("pou")), ",").alias("pous"), F.min("step").alias("first_step"))
    tag = F.when(F.col("reads").isNull(), "comment only").when(F.col("all_text").isNull(), "use only").otherwise("both")
    return comments.select("project", "device", "all_text").join(use, ["project", "device"], "full").select("project", "device", F.coalesce("all_text", F.lit("")).alias("all_text"), F.coalesce("reads", F.lit(0).cast("long")).alias("reads"), F.coalesce("writes", F.lit(0).cast("long")).alias("writes"), F.coalesce("pous", F.lit("")).alias("pous"), "first_step", tag.alias("found"))


def program_metrics(cond: DataFrame) -> DataFrame:
    """Rungs, outputs, terms, branches, average terms and largest complexity of
    each program, from conditions as branches of literals."""
    out = cond.groupBy(*RUNG, "out_device").agg(F.count_distinct("branch").alias("branches"), F.count("*").alias("terms"))
    return out.groupBy("project", "lddb").agg(F.count_distinct("pos").alias("rungs"), F.count("*").alias("outputs"), F.sum("terms").alias("terms"), F.sum("branches").alias("branches"), F.round(F.avg("terms"), 4).alias("avg_terms"), F.max("branches").alias("max_complexity"))


def hotspots(cond: DataFrame, k: int) -> DataFrame:
    out = cond.groupBy(*RUNG).agg(F.count_distinct("out_device", "branch").alias("complexity"), F.count("*").alias("terms"))
    return out.orderBy(F.desc("complexity"), F.desc("terms"), *RUNG).limit(k)


def top_per_group(df: DataFrame, key: list[str], item: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent items of each group, joined by blanks. Counted with
    map-side combining before they are ranked."""
    n = df.groupBy(*key, item).agg(F.count("*").alias("n"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), item))).where(F.col("rank") <= k)
    return r.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]), " ").alias(name))


def ladder_toc(occ: DataFrame) -> DataFrame:
    """Per section: rungs, first and last position, partly parsed operands, top
    driven devices and conditions."""
    key = ["project", "lddb", "title"]
    base = occ.groupBy(*key).agg(F.count_distinct("pos").alias("rungs"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_if(F.col("parse_status") == "partial").alias("partial"))
    drivers = top_per_group(occ.where(writes(F.col("access"))), key, "device", 8, "drivers")
    conditions = top_per_group(occ.where(F.col("role").isin("a", "b")), key, "device", 8, "conditions")
    return base.join(drivers, key, "left").join(conditions, key, "left").select(*key, "rungs", "first_pos", "last_pos", "partial", F.coalesce("drivers", F.lit("")).alias("drivers"), F.coalesce("conditions", F.lit("")).alias("conditions"))


def device_inventory(occ: DataFrame, category: Column) -> DataFrame:
    """Devices by category of their comment: uses, programs, top titles."""
    c = occ.withColumn("category", category)
    key = ["project", "category", "device"]
    base = c.groupBy(*key).agg(F.count("*").alias("uses"), F.count_distinct("lddb").alias("programs"))
    return base.join(top_per_group(c, key, "title", 3, "titles"), key)


def missing_comments(occ: DataFrame, comments: DataFrame) -> DataFrame:
    """Used devices without a comment: no row, or a blank one."""
    use = occ.groupBy("project", "device", "device_type").agg(F.count_if(F.col("parse_status") == "exact").alias("exact"), F.count_if(F.col("parse_status") != "exact").alias("partial"))
    joined = use.join(comments.select("project", "device", "all_text"), ["project", "device"], "left").where(F.coalesce("all_text", F.lit("")) == "")
    joined = joined.join(first_values(occ, ["project", "device"], "pos", 3, "samples"), ["project", "device"])
    return joined.select("project", "device", F.when(F.col("all_text").isNull(), "row-missing").otherwise("blank").alias("status"), F.when(F.col("device_type").isin("X", "Y"), "high").otherwise("medium").alias("severity"), "exact", "partial", "samples")


def io_list(occ: DataFrame, comments: DataFrame) -> DataFrame:
    """Inputs and outputs from use or comments, with their first coil."""
    is_io = F.col("device_type").isin("X", "Y")
    use = occ.where(is_io).groupBy("project", "device", "device_type").agg(F.count("*").alias("uses"), F.min(F.when(writes(F.col("access")), F.struct("pos", "step"))).alias("coil"))
    named = comments.where(is_io & (F.coalesce("all_text", F.lit("")) != "")).select("project", "device", F.col("device_type").alias("ct"), "all_text")
    return use.join(named, ["project", "device"], "full").select("project", "device", F.coalesce("device_type", "ct").alias("device_type"), F.coalesce("all_text", F.lit("")).alias("comment"), F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), F.col("coil.pos").alias("coil_pos"))


def timer_settings(occ: DataFrame, families: DataFrame, types: list[str], seconds: Column) -> DataFrame:
    """Presets of timer coils: operations whose opcode is of the family ``timer`` in
    ``families(opcode, family)`` and whose first operand is a device of ``types``. A
    preset that is no constant is null."""
    coils = occ.join(families.where("family = 'timer'").select("opcode").distinct(), "opcode", "left_semi")
    return coils.where((F.col("arg_index") == 0) & F.col("device_type").isin(*types)).select("project", "lddb", "pos", "device", "opcode", "const_args", F.round(seconds, 4).alias("preset_s"))


def changeability(occ: DataFrame) -> DataFrame:
    """A rung's change risk: weights for its size, latches, partly parsed operands
    and data moves, with the reasons."""
    c = occ.groupBy(*RUNG).agg(F.count("*").alias("n"), F.count_if(F.col("role").isin("SET", "RST")).alias("latches"), F.count_if(F.col("parse_status") == "partial").alias("partial"), F.count_if(F.col("opcode").isin("MOV", "DMOV", "BMOV")).alias("moves"))
    rules = [("large", F.col("n") >= 6, 2), ("latch", F.col("latches") > 0, 3), ("partial", F.col("partial") > 0, 4), ("data", F.col("moves") > 0, 1)]
    score = sum((F.when(c_, w).otherwise(0) for _, c_, w in rules), F.lit(0))
    reasons = F.array_join(F.array(*[F.when(c_, F.lit(n)) for n, c_, _ in rules]), ",")
    return c.select(*RUNG, score.alias("score"), reasons.alias("reasons"))


def maintainability(occ: DataFrame, comments: DataFrame, interlocks: DataFrame | None = None, risks: DataFrame | None = None) -> DataFrame:
    """A section's score: twice its large rungs, four times its partly parsed ones,
    its devices without comment, three times its doubly driven ones, three times its
    rungs in ``interlocks(project, lddb, pos)`` and twice those in ``risks``."""
    key = ["project", "title"]
    rung = occ.groupBy("title", *RUNG).agg(F.count("*").alias("n"), F.max(F.when(F.col("parse_status") == "partial", 1).otherwise(0)).alias("p"))
    sizes = rung.groupBy(*key).agg(F.sum(F.when(F.col("n") >= 6, 1).otherwise(0)).alias("large"), F.sum("p").alias("partial"))
    dev = occ.select(*key, "device").distinct().join(comments.where("all_text <> ''").select("project", "device"), ["project", "device"], "left_anti").groupBy(*key).agg(F.count("*").alias("missing"))
    dup = occ.where(writes(F.col("access"))).groupBy(*key, "device").agg(F.count_distinct("lddb", "pos").alias("k")).where("k > 1").groupBy(*key).agg(F.count("*").alias("dup"))
    out = sizes.join(dev, key, "left").join(dup, key, "left")
    for name, found in (("interlock", interlocks), ("risk", risks)):
        if found is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(rung.join(found.select(*RUNG), RUNG).groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    out = out.na.fill(0, ["missing", "dup", "interlock", "risk"])
    return out.withColumn("score", F.col("large") * 2 + F.col("partial") * 4 + F.col("missing") + F.col("dup") * 3 + F.col("interlock") * 3 + F.col("risk") * 2)


def gap_matrix(occ: DataFrame) -> DataFrame:
    """Partly parsed operands by reason and priority, with five positions."""
    reason = F.when(F.col("role").isin("a", "b"), "condition").when(writes(F.col("access")), "destination").otherwise("operand")
    priority = F.when(F.col("device_type").isin("X", "Y"), "high").otherwise("normal")
    g = occ.where("parse_status = 'partial'").withColumn("reason", reason).withColumn("priority", priority)
    key = ["project", "reason", "priority"]
    return g.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("lddb", "pos").alias("rungs")).join(first_values(g, key, "pos", 5, "samples"), key)


def instruction_coverage(occ: DataFrame, known: DataFrame) -> DataFrame:
    """Uses of each opcode, partly parsed ones, and whether the table knows it."""
    n = occ.groupBy("project", "opcode").agg(F.count("*").alias("uses"), F.count_if(F.col("parse_status") == "partial").alias("partial"), F.min("pos").alias("sample"))
    return n.join(known, "opcode", "left").select("project", "opcode", "uses", "partial", "sample", F.when(F.col("category").isNull(), "unknown").otherwise("known").alias("status"), F.coalesce("category", F.lit("")).alias("category"))


def device_coverage(occ: DataFrame) -> DataFrame:
    return occ.groupBy("project", "device_type").agg(F.count("*").alias("uses"), F.count_distinct("device").alias("devices"), F.count_if(F.col("parse_status") == "partial").alias("partial"))


def instruction_usage(occ: DataFrame, known: DataFrame) -> DataFrame:
    return occ.groupBy("project", "opcode").agg(F.count("*").alias("n")).join(known, "opcode", "left").groupBy("project", F.coalesce("category", F.lit("other")).alias("category")).agg(F.sum("n").alias("uses"), F.count("*").alias("opcodes"))


def pou_counts(occ: DataFrame) -> DataFrame:
    return occ.groupBy("project", "pou").agg(F.count_distinct("lddb", "pos").alias("rungs"), F.count_distinct("device").alias("devices"))


def signal_traits(occ: DataFrame, marks: str | dict[str, str], pulse_ops: tuple[str, ...] = ("PLS", "PLF")) -> DataFrame:
    """Traits of each device: latched, pulse (driven by one of ``pulse_ops``),
    self-holding (a condition of a rung that drives it), what its comment says
    (``marks`` gives a pattern for each such trait, as state, completion or command;
    a single pattern is the trait ``marked``), read only, written only."""
    marks = {"marked": marks} if isinstance(marks, str) else marks
    rung = occ.groupBy("project", "device", "lddb", "pos").agg(F.max(F.col("role").isin("a", "b")).alias("c"), F.max(writes(F.col("access"))).alias("d"))
    hold = rung.groupBy("project", "device").agg(F.max(F.col("c") & F.col("d")).alias("self_hold"))
    base = occ.groupBy("project", "device").agg(F.max(F.col("role").isin("SET", "RST")).alias("latched"), F.max(writes(F.col("access")) & F.col("opcode").isin(*pulse_ops)).alias("pulse"), *[F.max(F.col("comment").rlike(p)).alias(f"mark {n}") for n, p in marks.items()], F.max(writes(F.col("access"))).alias("w"), F.max(reads(F.col("access"))).alias("r"))
    names = [("latched", "latched"), ("pulse", "pulse"), ("self-hold", "self_hold"), *[(n, f"mark {n}") for n in marks]]
    return base.join(hold, ["project", "device"]).select("project", "device", F.array_join(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in names], F.when(~F.col("w"), F.lit("read-only")), F.when(~F.col("r"), F.lit("write-only"))), ",").alias("traits"))


def alarm_map(occ: DataFrame, pattern: str, timers: tuple[str, ...] = ("T", "ST"), presets: DataFrame | None = None) -> DataFrame:
    """Driven bits whose comment looks like an alarm: how they hold (by SET, by a
    rung of their own condition, or not), what triggers them (the first five
    conditions of the rungs that drive them), the smallest timer among these,
    if any, with its preset where ``presets(project, device, preset_s)`` has one (the
    smallest of several), and their first five reset positions."""
    bits = occ.where(F.col("comment").rlike(pattern) & F.col("device_type").isin("M", "L", "Y") & writes(F.col("access")))
    per = bits.groupBy("project", "device").agg(F.count_if(F.col("role") == "SET").alias("sets"), F.count_if(F.col("role") == "RST").alias("resets"), F.count_if(F.col("role") == "c").alias("coils"))
    key = ["project", "device"]
    drives = bits.where("role <> 'RST'").select(*RUNG, "device").distinct()
    causes = occ.where(F.col("role").isin("a", "b")).select(*RUNG, F.col("device").alias("cause"), F.col("device_type").alias("cause_type")).join(drives, RUNG).where("cause <> device")
    triggers = first_values(causes, key, "cause", 5, "triggers")
    monitor = causes.where(F.col("cause_type").isin(*timers)).groupBy(*key).agg(F.min("cause").alias("timer"))
    resets = first_values(bits.where("role = 'RST'"), key, "pos", 5, "reset_at")
    traits = signal_traits(occ, pattern).select("project", "device", F.col("traits").contains("self-hold").alias("holds"))
    per = per.join(traits, key).join(triggers, key, "left").join(monitor, key, "left").join(resets, key, "left")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    if presets is None:
        per = per.withColumn("preset_s", F.lit(None).cast("double"))
    else:
        per = per.join(presets.groupBy("project", F.col("device").alias("timer")).agg(F.min("preset_s").alias("preset_s")), ["project", "timer"], "left")
    return per.select(*key, F.when(F.col("sets") > 0, "SET").when(F.col("holds"), "self-hold").otherwise("OUT").alias("hold"), "sets", "resets", none("triggers"), none("timer"), "preset_s", none("reset_at"))


# fixed values: points of a finding's severity in its priority, and off the score of its dimensions
PRIORITY = {"critical": 120, "high": 90, "medium": 55, "low": 25, "info": 12}
PENALTY = {"critical": 12, "high": 8, "medium": 4, "low": 2, "info": 1}
#: Most points that one check takes off, and the least score of each label.
MOST_PENALTY, LABELS = 35, (("GOOD", 85), ("FAIR", 70), ("POOR", 50))


def _points(table: dict[str, int], other: int) -> Column:
    severity = F.lower(F.coalesce("severity", F.lit("info")))
    out = F.lit(other)
    for name, points in table.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def top_risks(findings: DataFrame, boosts: dict[str, int], top: int) -> DataFrame:
    """The ``top`` findings of each project by priority: points of the severity, of the
    check by ``boosts``, 18 for outputs, 4 without a comment (where there is such a
    column), and one for each place up to ten. Ties go by check and device."""
    boost = F.lit(0)
    for name, points in boosts.items():
        boost = F.when(F.col("check_name") == name, points).otherwise(boost)
    bare = F.when(F.coalesce(F.trim("comment"), F.lit("")) == "", 4).otherwise(0) if "comment" in findings.columns else F.lit(0)
    priority = _points(PRIORITY, 10) + boost + F.when(F.col("device").startswith("Y"), 18).otherwise(0) + bare + F.least(F.coalesce("n", F.lit(0)), F.lit(10))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("priority"), "check_name", "device", "detail"))
    return findings.withColumn("priority", priority.cast("long")).withColumn("rank", rank).where(F.col("rank") <= top)


def health(findings: DataFrame, dimensions: DataFrame, states: DataFrame, supplemental: tuple[str, ...] = ()) -> DataFrame:
    """``project, dimension, score, findings``: 100 less penalties by severity, at most
    ``MOST_PENALTY`` a check, never below 0.

    ``dimensions(check_name, dimension)`` says what a check speaks for; a null
    dimension counts nowhere. ``states(project, check_name, state)`` has a row for each
    check of a project: where one that speaks for a dimension was not ``checked``, the
    score is null, as not looking must not read as finding nothing; checks in
    ``supplemental`` do not block.
    """
    speaks = dimensions.where("dimension is not null")
    per = findings.groupBy("project", "check_name").agg(F.least(F.sum(_points(PENALTY, 1)), F.lit(MOST_PENALTY)).alias("penalty"), F.count("*").alias("n"))
    j = states.select("project", "check_name", "state").join(per, ["project", "check_name"], "left").join(speaks, "check_name")
    blocked = F.max((F.col("state") != "checked") & ~F.col("check_name").isin(*supplemental, ""))
    out = j.groupBy("project", "dimension").agg(blocked.alias("blocked"), F.sum(F.coalesce("penalty", F.lit(0))).alias("penalty"), F.sum(F.coalesce("n", F.lit(0))).alias("findings"))
    return out.select("project", "dimension", F.when(~F.col("blocked"), F.greatest(F.lit(0).cast("long"), F.lit(100) - F.col("penalty"))).alias("score"), "findings")


def health_labels(scores: DataFrame, states: DataFrame, supplemental: tuple[str, ...] = ()) -> DataFrame:
    """``project, health, provisional``: the label of a project's lowest score, ``NOT
    ASSESSED`` without any; ``INCOMPLETE``, with the label as provisional, where a check
    that is not ``supplemental`` was not ``checked``."""
    low = F.col("low")
    label = F.lit("CRITICAL")
    for name, least in reversed(LABELS):
        label = F.when(low >= least, name).otherwise(label)
    label = F.when(low.isNull(), "NOT ASSESSED").otherwise(label)
    open_ = states.groupBy("project").agg(F.max((F.col("state") != "checked") & ~F.col("check_name").isin(*supplemental, "")).alias("open"))
    j = open_.join(scores.groupBy("project").agg(F.min("score").alias("low")), "project", "left")
    return j.select("project", F.when(F.col("open"), "INCOMPLETE").otherwise(label).alias("health"), F.when(F.col("open"), label).alias("provisional"))


def worst_state(states: DataFrame, key: list[str]) -> DataFrame:
    """The weakest of the states of each key, and the distinct constraints. A state that
    is not in the list is weaker than all that are; of several such, the last by name."""
    # fixed values: the states, best first
    order = ("checked", "no_measurement", "truncated", "partial", "unsupported", "not_evaluated")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1), "state")
    return states.groupBy(*key).agg(F.max_by("state", rank).alias("state"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))), "; ").alias("constraints"))
