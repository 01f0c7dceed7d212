"""Rule checks. Each returns ``project, check_name, severity, device, n, detail``
(``n``: how many places); ``check_states`` tells which were evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.devices import format_device
from .facts import RUNG, reads, writes
from .lookup import area_of

_REGISTRY: dict[str, Callable] = {}


def register_check(name: str, fn: Callable) -> None:
    """Adds a check ``fn(inputs) -> findings`` to ``run_checks``."""
    _REGISTRY[name] = fn


def _finding(df: DataFrame, check: str, severity: Column, device: str, n: Column, detail: Column) -> DataFrame:
    return df.select("project", F.lit(check).alias("check_name"), severity.alias("severity"), F.col(device).alias("device"), n.cast("long").alias("n"), detail.alias("detail"))


# fixed values: the roles of operands that drive a bit, timer coils included
COILS = ("c", "SET", "RST", "PLS", "PLF", "OUT__16", "OUTH__16")


def duplicate_coil(occ: DataFrame, cond: DataFrame | None = None, benign: str | None = None, high_types: tuple[str, ...] = ("Y", "M", "L")) -> DataFrame:
    """Bits that more than one operation drives, in whatever way.

    High where plain coils do so more than once on a bit of ``high_types`` or a bit
    of a word; medium else, and where a comment or title matches ``benign``, all
    plain coils are indexed (``detail`` holds ``indexed``), or all are under one
    condition of ``cond``. Conditions are compared by a digest of their branches.
    """
    note = F.col("detail") if "detail" in occ.columns else F.lit("")
    bit = F.coalesce(note.rlike(r"\bbit=K?\d+\b"), F.lit(False))
    x = occ.where(writes(F.col("access")) & F.col("role").isin(*COILS))
    x = x.select("project", "device", "device_type", "lddb", "pos", "op_index", "role", bit.alias("bit"), F.coalesce(note.contains("indexed"), F.lit(False)).alias("indexed"), F.coalesce(F.concat_ws(" ", "comment", "title").rlike(benign or "$^"), F.lit(False)).alias("benign"))
    ops = x.groupBy("project", "device", "device_type", "role", "lddb", "pos", "op_index").agg(*[F.max(c).alias(c) for c in ("bit", "indexed", "benign")])
    if cond is not None:
        branch = cond.groupBy("project", "lddb", "pos", "out_device", "branch").agg(F.array_sort(F.collect_set(F.struct("device", "required"))).alias("lits"))
        same = branch.groupBy("project", "lddb", "pos", F.col("out_device").alias("device")).agg(F.sha2(F.to_json(F.array_sort(F.collect_set("lits"))), 256).alias("under"))
        ops = ops.join(same, ["project", "lddb", "pos", "device"], "left")
    else:
        ops = ops.withColumn("under", F.lit(None).cast("string"))
    coil = F.col("role") == "c"
    by_role = ops.groupBy("project", "device", "device_type", "role").agg(F.count("*").alias("k"), F.max("bit").alias("bit"), F.max("benign").alias("benign"), F.count_if(coil & ~F.col("indexed")).alias("direct"), F.count_if(coil & F.col("under").isNull()).alias("open"), F.min(F.when(coil, F.col("under"))).alias("lo"), F.max(F.when(coil, F.col("under"))).alias("hi"))
    d = by_role.groupBy("project", "device", "device_type").agg(
        F.sum("k").alias("k"), F.max("bit").alias("bit"), F.max("benign").alias("benign"), F.sum("direct").alias("direct"), F.sum("open").alias("open"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.when(coil, F.col("k")).otherwise(0)).alias("coils"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "role"))).alias("roles")
    ).where("k > 1")
    told = F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit("="), (-r["k"]).cast("string"))), "; ")
    one = (F.col("open") == 0) & (F.col("lo") == F.col("hi"))
    high = (F.col("device_type").isin(*high_types) | F.col("bit")) & (F.col("coils") > 1) & ~F.col("benign") & (F.col("direct") > 0) & ~F.coalesce(one, F.lit(False))
    return _finding(d, "duplicate-coil", F.when(high, "high").otherwise("medium"), "device", F.col("k"), F.concat(F.lit("roles: "), told))


def multi_writer(members: DataFrame) -> DataFrame:
    """Words that several rungs write, runs included; neighbours with the same
    writers are one finding."""
    w = members.where(writes(F.col("access")) & F.col("device_type").isin("D", "W"))
    # writers are compared by their number and a digest that needs no order, so that no word's writers are gathered
    w = w.select("project", "device_type", "member_number", "lddb", "pos").distinct()
    digest = F.struct(F.sum(F.xxhash64("lddb", "pos").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("pos", "lddb")).alias("x"), F.count("*").alias("n"))
    per = w.groupBy("project", "device_type", "member_number").agg(digest.alias("writers"), F.count("*").alias("k")).where("k > 1")
    # the difference is constant along a run of neighbours with one writer set
    island = F.col("member_number") - F.row_number().over(Window.partitionBy("project", "device_type", "writers").orderBy("member_number"))
    runs = per.withColumn("island", island).groupBy("project", "device_type", "writers", "island").agg(F.min("member_number").alias("lo"), F.max("member_number").alias("hi"), F.max("k").alias("k"))
    named = runs.withColumn("device", format_device(F.col("device_type"), F.col("lo")))
    return _finding(named, "multi-writer", F.when(F.col("k") > 3, "high").otherwise("medium"), "device", F.col("k"), F.concat((F.col("hi") - F.col("lo") + 1).cast("string"), F.lit(" devices")))


def external_value_source(flow: DataFrame, members: DataFrame, areas: DataFrame) -> DataFrame:
    """Flow sources that no rung writes and that lie in no area."""
    written = members.where(writes(F.col("access"))).select("project", F.col("member_device").alias("source_device")).distinct()
    src = flow.where("not read_modify_write").groupBy("project", "source_device").agg(F.count("*").alias("k")).join(written, ["project", "source_device"], "left_anti")
    at = members.where("run_offset = 0").select("project", F.col("member_device").alias("source_device"), "device_type", "number").distinct()
    out = area_of(src.join(at, ["project", "source_device"]), areas).where("area_no is null")
    return _finding(out, "external-value-source", F.lit("medium"), "source_device", F.col("k"), F.lit("no writer and no area"))


def alarm_quality(alarms: DataFrame) -> DataFrame:
    bad = alarms.where("(hold = 'SET' and resets = 0) or hold = 'OUT'")
    return _finding(bad, "alarm-quality", F.when(F.col("hold") == "SET", "high").otherwise("low"), "device", F.col("sets") + F.col("resets"), F.when(F.col("hold") == "SET", "no reset").otherwise("not latched"))


def unused_device(occ: DataFrame, members: DataFrame, comments: DataFrame | None = None, spare: str = "(?i)spare|unused|not used", skipped_types: tuple[str, ...] = ("T", "C")) -> DataFrame:
    """Driven bits that are never a condition, and commented devices without any use.

    Devices inside a run that names another one count as used. With
    ``comments(project, device, device_type, all_text)``, those whose comment has
    the pattern ``spare`` are left out; an empty or null comment says nothing.
    """
    inside = reads(F.col("access")) | (F.col("run_offset") > 0)
    used = members.groupBy("project", F.col("member_device").alias("device")).agg(F.max(inside).alias("read"))
    driven = occ.where(F.col("role").isin("c", "SET") & (F.col("access") == "write") & ~F.col("device_type").isin(*skipped_types)).groupBy("project", "device").agg(F.count("*").alias("k"))
    driven = driven.join(used.where("read"), ["project", "device"], "left_anti")
    never = F.lit("driven, never read")
    if comments is None:
        return _finding(driven, "unused-device", F.lit("low"), "device", F.col("k"), never)
    said = comments.where((F.coalesce(F.col("all_text"), F.lit("")) != "") & ~F.col("device_type").isin(*skipped_types))
    meant = said.where(F.col("all_text").rlike(spare)).select("project", "device").distinct()
    idle = said.select("project", "device").distinct().join(used, ["project", "device"], "left_anti")
    both = driven.withColumn("detail", never).unionByName(idle.select("project", "device", F.lit(0).cast("long").alias("k"), F.lit("commented, never used").alias("detail")))
    return _finding(both.join(meant, ["project", "device"], "left_anti"), "unused-device", F.lit("low"), "device", F.col("k"), F.col("detail"))


def comment_conflict(comments: DataFrame, top: int = 1000) -> DataFrame:
    """Texts that more than one device of a project has; the ``top`` most frequent."""
    # dealt by device first: a row a text and device, before texts are counted on the map side
    named = comments.where("all_text <> ''").select("project", F.lower(F.trim("all_text")).alias("text"), "device", "device_type").repartition("project", "device")
    one = named.groupBy("project", "text", "device").agg(F.min("device_type").alias("low"), F.max("device_type").alias("high"))
    c = one.groupBy("project", "text").agg(F.count("device").alias("k"), (F.min("low") < F.max("high")).alias("mixed"), F.min("device").alias("device")).where("k > 1")
    return _finding(c.orderBy(F.desc("k"), "text", "project").limit(top), "comment-conflict", F.when(F.col("mixed"), "medium").otherwise("low"), "device", F.col("k"), F.col("text"))


def link_range(links: DataFrame, members: DataFrame) -> DataFrame:
    """Devices that a link brings in and a rung here writes all the same."""
    inbound = links.where("direction = 'A_to_B'").select(F.col("project_b").alias("project"), F.col("device_b").alias("member_device")).distinct()
    w = members.where(writes(F.col("access"))).join(inbound, ["project", "member_device"], "left_semi").groupBy("project", "member_device").agg(F.count("*").alias("k"))
    return _finding(w, "link-range", F.lit("high"), "member_device", F.col("k"), F.lit("written on the receiving side"))


def compare_type(operands: DataFrame, opcodes: DataFrame, shared_types: list[str], shared_text: str) -> DataFrame:
    """Compares of shared data, whose sign is not sure (a device of ``shared_types``, or
    whose comment has the pattern ``shared_text``), and compares of one word with
    a constant of more than 16 bits.

    ``operands(project, lddb, pos, op_index, opcode, argc, arg_index, device,
    device_type, value, comment)`` has a row for each operand, with ``value`` for
    constants; ``opcodes(opcode, family, words)`` says which ones compare.
    """
    c = operands.join(opcodes.where("family = 'compare'").select("opcode", "words"), "opcode")
    shared = c.where(F.col("device").isNotNull() & (F.col("device_type").isin(*shared_types) | F.coalesce(F.col("comment"), F.lit("")).rlike(shared_text))).groupBy("project", "device").agg(F.count("*").alias("k"))
    wide = c.where((F.col("words") == 1) & (F.col("value") > 0xFFFF)).groupBy("project", F.concat(F.lit("K"), F.col("value").cast("string")).alias("device")).agg(F.count("*").alias("k"))
    return _finding(shared, "compare-type", F.lit("info"), "device", F.col("k"), F.lit("sign of shared data")).union(_finding(wide, "compare-type", F.lit("medium"), "device", F.col("k"), F.lit("constant of more than 16 bits")))


def div_by_zero(operands: DataFrame, opcodes: DataFrame, members: DataFrame, areas: DataFrame, word_types: list[str]) -> DataFrame:
    """Divisions whose divisor, the operand before the last, is the constant 0, or a
    word that no rung writes and that lies in no area. Inputs as in
    ``compare_type``; a division without two operands has no divisor."""
    d = operands.join(opcodes.where("family = 'division'").select("opcode"), "opcode", "left_semi").where((F.col("argc") >= 2) & (F.col("arg_index") == F.col("argc") - 2))
    zero = d.where("value = 0").groupBy("project").agg(F.count("*").alias("k")).withColumn("device", F.lit("K0"))
    written = members.where(writes(F.col("access"))).select("project", F.col("member_device").alias("device")).distinct()
    bare = d.where(F.col("device_type").isin(*word_types)).groupBy("project", "device", "device_type", "number").agg(F.count("*").alias("k")).join(written, ["project", "device"], "left_anti")
    bare = area_of(bare, areas).where("area_no is null")
    return _finding(zero, "div-by-zero", F.lit("high"), "device", F.col("k"), F.lit("divisor is 0")).union(_finding(bare, "div-by-zero", F.lit("info"), "device", F.col("k"), F.lit("divisor without a writer")))


def operand_device(occ: DataFrame, allowed: DataFrame) -> DataFrame:
    """Operands whose type ``allowed(opcode, allowed_types)`` does not list; where
    ``allowed`` has ``arg_index`` too, it speaks of that operand of the opcode only."""
    o = occ.join(allowed, ["opcode", "arg_index"] if "arg_index" in allowed.columns else "opcode").where(~F.array_contains("allowed_types", F.col("device_type"))).groupBy("project", "device").agg(F.count("*").alias("k"))
    return _finding(o, "operand-device", F.lit("high"), "device", F.col("k"), F.lit("type not allowed"))


def width_mismatch(members: DataFrame) -> DataFrame:
    """Words inside the high words of a multi-word write that another rung names: how
    many rungs write them so. Three counts of a device's rungs tell it: a writing
    rung counts unless it is the only one that names the word."""
    high = writes(F.col("access")) & (F.col("run_offset") > 0)
    named = (F.col("run_offset") == 0) & F.col("device_type").isin("D", "W")
    rung = members.where(high | named).groupBy("project", F.col("member_device").alias("device"), "lddb", "pos").agg(F.max(high).cast("long").alias("w"), F.max(named).cast("long").alias("r"))
    per = rung.groupBy("project", "device").agg(F.sum("w").alias("w"), F.sum("r").alias("r"), F.sum(F.col("w") * F.col("r")).alias("both"))
    hit = per.withColumn("k", F.col("w") - F.when(F.col("r") == 1, F.col("both")).otherwise(0)).where("r > 0 and k > 0")
    return _finding(hit, "width-mismatch", F.lit("medium"), "device", F.col("k"), F.lit("inside a longer write"))


def signed_compare(occ: DataFrame, ranges: DataFrame, unsigned_types: tuple[str, ...] = ()) -> DataFrame:
    """Constants outside ``ranges(opcode, type_min, type_max)``, and devices of
    ``unsigned_types`` (module buffers) where the range has negative numbers."""
    value = F.regexp_extract("const_args", r"^K(\d+)$", 1).try_cast("long")
    c = occ.join(ranges, "opcode").where((value < F.col("type_min")) | (value > F.col("type_max"))).groupBy("project", "device").agg(F.count("*").alias("k"))
    out = _finding(c, "signed-compare", F.lit("low"), "device", F.col("k"), F.lit("constant out of range"))
    if not unsigned_types:
        return out
    data = occ.where(F.col("device_type").isin(*unsigned_types)).join(ranges.where("type_min < 0"), "opcode").groupBy("project", "device").agg(F.count("*").alias("k"))
    return out.union(_finding(data, "signed-compare", F.lit("info"), "device", F.col("k"), F.lit("unsigned data in a signed compare")))


def unwritten_contact(occ: DataFrame, members: DataFrame, areas: DataFrame) -> DataFrame:
    """Contacts of bits that nothing writes and no input or area feeds."""
    written = members.where(writes(F.col("access"))).select("project", F.col("member_device").alias("device")).distinct()
    c = occ.where(F.col("role").isin("a", "b") & (F.col("device_type") != "X")).groupBy("project", "device", "device_type", "number").agg(F.count_if(F.col("role") == "a").alias("a"), F.count("*").alias("k")).join(written, ["project", "device"], "left_anti")
    out = area_of(c, areas).where("area_no is null")
    return _finding(out, "unwritten-contact", F.when(F.col("a") > 0, "high").otherwise("medium"), "device", F.col("k"), F.when(F.col("a") > 0, "never on").otherwise("always on"))


def disabled_rung(occ: DataFrame, always_off: list[str], always_on: tuple[str, ...] = ()) -> DataFrame:
    """Rungs with a contact that never closes: a make contact of a special device that
    is always off, or a break contact of one that is always on."""
    dead = (F.col("role") == "a") & F.col("device").isin(*always_off) | (F.col("role") == "b") & F.col("device").isin(*always_on)
    d = occ.where(dead).groupBy("project", "device").agg(F.count_distinct("lddb", "pos").alias("k"))
    return _finding(d, "disabled-rung", F.lit("medium"), "device", F.col("k"), F.lit("contact never closes"))


def unread(members: DataFrame, bits: bool) -> DataFrame:
    """Written devices that nothing reads; runs that read count as reads."""
    kinds = ["M", "L", "Y"] if bits else ["D", "W"]
    m = members.where(F.col("device_type").isin(*kinds))
    d = m.groupBy("project", "member_device", "device_type").agg(F.count_if(writes(F.col("access"))).alias("k"), F.count_if(reads(F.col("access"))).alias("r")).where("k > 0 and r = 0 and device_type <> 'Y'")
    return _finding(d, "unread-coil" if bits else "unread-word", F.lit("low"), "member_device", F.col("k"), F.lit("written, never read"))


def set_without_rst(occ: DataFrame) -> DataFrame:
    d = occ.groupBy("project", "device").agg(F.count_if(F.col("role") == "SET").alias("k"), F.count_if(F.col("role") == "RST").alias("r")).where("k > 0 and r = 0")
    return _finding(d, "set-without-rst", F.lit("medium"), "device", F.col("k"), F.lit("never reset"))


def io_comment_gap(occ: DataFrame, comments: DataFrame) -> DataFrame:
    named = comments.where("all_text <> ''").select("project", "device")
    d = occ.where(F.col("device_type").isin("X", "Y")).groupBy("project", "device").agg(F.count("*").alias("k")).join(named, ["project", "device"], "left_anti")
    return _finding(d, "io-comment-gap", F.lit("high"), "device", F.col("k"), F.lit("no comment"))


# fixed values: kinds of support for an output, a bit each
SUPPORT = ("input", "safety", "position", "mode", "timer", "off-contact")
#: Bits of the classes that make support critical beside safety.
PERMISSIVE = 64


def interlock_candidates(occ: DataFrame, rules: dict[str, str], trace_types: tuple[str, ...] = ("X", "Y", "M", "L", "T", "ST"), timer_types: tuple[str, ...] = ("T", "ST")) -> DataFrame:
    """``interlock_rungs`` as findings; ``n`` is the number of contacts."""
    told = lambda c: F.array_join(F.array(*[F.when(F.col(c).bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(SUPPORT)]), ",")
    detail = F.concat("lddb", F.lit(":"), F.col("pos").cast("string"), F.lit(" own "), told("own"), F.lit(" upstream "), told("up"))
    return _finding(interlock_rungs(occ, rules, trace_types, timer_types), "interlock-candidate", F.col("severity"), "device", F.col("contacts"), detail)


def interlock_rungs(occ: DataFrame, rules: dict[str, str], trace_types: tuple[str, ...] = ("X", "Y", "M", "L", "T", "ST"), timer_types: tuple[str, ...] = ("T", "ST")) -> DataFrame:
    """Rungs whose actuator-like output has little support of its own: at most one
    contact, or fewer than two kinds of ``SUPPORT``.

    ``rules`` has patterns for comments and titles: ``actuator``, ``not_actuator``,
    ``safety``, ``position``, ``mode``, ``timer`` and ``permissive``. What the rungs up to
    three levels before show decides the severity: low with three kinds, one of them
    critical (safety or permissive), medium with any, else high. Evidence is a mask
    of bits: a rung's own, OR-ed into the devices it drives, and level by level into
    what these are contacts of; no path is listed.
    """
    text = lambda c: sum((F.when(c.rlike(rules[k]), b).otherwise(0) for k, b in (("safety", 2), ("position", 4), ("mode", 8), ("timer", 16), ("permissive", PERMISSIVE))), F.lit(0))
    contact = F.col("role").isin("a", "b")
    one = F.when(contact & (F.col("device_type") == "X"), 1).otherwise(0).bitwiseOR(F.when(contact & F.col("device_type").isin(*timer_types), 16).otherwise(0)).bitwiseOR(F.when(F.col("role") == "b", 32).otherwise(0))
    said = text(F.concat_ws(" ", "title", F.when(contact, F.col("comment"))))
    rung = occ.groupBy(*RUNG).agg(F.bit_or(one.bitwiseOR(said)).alias("own"), F.count_if(contact).alias("contacts"))
    drives = occ.where(writes(F.col("access"))).select(*RUNG, "device").distinct()
    asks = occ.where(contact & F.col("device_type").isin(*trace_types)).select(*RUNG, F.col("device").alias("source")).distinct()
    named = occ.groupBy("project", "device").agg(F.bit_or(text(F.coalesce("comment", F.lit("")))).alias("named"))
    above = drives.join(rung, RUNG).groupBy("project", "device").agg(F.bit_or("own").alias("above"))
    first = named.join(above, ["project", "device"], "left").select("project", "device", F.col("named").bitwiseOR(F.coalesce("above", F.lit(0))).alias("m"))
    edges = asks.join(drives, RUNG).select("project", "source", "device").distinct()
    mask = first
    for _ in range(2):
        more = edges.join(mask.select("project", F.col("device").alias("source"), "m"), ["project", "source"]).groupBy("project", "device").agg(F.bit_or("m").alias("more"))
        mask = first.join(more, ["project", "device"], "left").select("project", "device", F.col("m").bitwiseOR(F.coalesce("more", F.lit(0))).alias("m"))
    upstream = asks.join(mask.select("project", F.col("device").alias("source"), "m"), ["project", "source"]).groupBy(*RUNG).agg(F.bit_or("m").alias("up"))
    label = F.concat_ws(" ", "device", "comment", "title")
    coils = occ.where((F.col("role") == "c") & (F.col("device_type") == "Y") & label.rlike(rules["actuator"]) & ~label.rlike(rules["not_actuator"])).select(*RUNG, "device").distinct()
    j = coils.join(rung, RUNG).join(upstream, RUNG, "left").withColumn("up", F.coalesce("up", F.lit(0)))
    kinds = lambda c: F.bit_count(F.col(c).bitwiseAND(63))
    weak = j.where((F.col("contacts") <= 1) | (kinds("own") < 2))
    critical = F.col("up").bitwiseAND(2 | PERMISSIVE) > 0
    severity = F.when((kinds("up") >= 3) & critical, "low").when(kinds("up") >= 1, "medium").otherwise("high")
    return weak.select(*RUNG, "device", "contacts", "own", "up", severity.alias("severity"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Findings and places of each project, check and severity."""
    return findings.groupBy("project", "check_name", "severity").agg(F.count("*").alias("findings"), F.sum("n").alias("places"))


def run_checks(inputs: dict[str, DataFrame], names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all checks whose inputs are there, and a state for each check:
    an input that is missing makes it ``not_evaluated``, not clean.

    ``inputs`` may have ``occ, members, comments, areas, flow``; further checks
    come from ``register_check``.
    """
    plans: dict[str, tuple[tuple[str, ...], Callable]] = {
        "duplicate-coil": (("occ",), lambda i: duplicate_coil(i["occ"])),
        "multi-writer": (("members",), lambda i: multi_writer(i["members"])),
        "unused-device": (("occ", "members"), lambda i: unused_device(i["occ"], i["members"])),
        "comment-conflict": (("comments",), lambda i: comment_conflict(i["comments"])),
        "unwritten-contact": (("occ", "members", "areas"), lambda i: unwritten_contact(i["occ"], i["members"], i["areas"])),
        "external-value-source": (("flow", "members", "areas"), lambda i: external_value_source(i["flow"], i["members"], i["areas"])),
        "unread-word": (("members",), lambda i: unread(i["members"], False)),
        "set-without-rst": (("occ",), lambda i: set_without_rst(i["occ"])),
        "io-comment-gap": (("occ", "comments"), lambda i: io_comment_gap(i["occ"], i["comments"])),
        **{n: ((), f) for n, f in _REGISTRY.items()},
    }
    chosen = names or list(plans)
    ready = [n for n in chosen if all(x in inputs for x in plans[n][0])]
    found = None
    for n in ready:
        part = plans[n][1](inputs)
        found = part if found is None else found.unionByName(part)
    spark = next(iter(inputs.values())).sparkSession
    states = spark.createDataFrame([(n, "checked" if n in ready else "not_evaluated") for n in chosen], "check_name string, state string")
    return found, states
