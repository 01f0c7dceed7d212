"""Walks over the device graph: downstream reach, upstream trace, value sources,
and constants that spread.

Each hop is one join of the whole frontier; what was seen is taken out by an anti
join; every hop is written to the shared folder, so a lost executor costs one
hop, and the plan does not grow.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import RUNG, reads, writes


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names. A session in
    this one process, as in tests, may leave that unset."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/hop-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rung_edges(occ: DataFrame) -> DataFrame:
    """Distinct ``project, source, target``: a condition of a rung and a device the
    rung drives."""
    key = ["project", "lddb", "pos"]
    c = occ.where(F.col("role").isin("a", "b")).select(*key, F.col("device").alias("source")).distinct()
    d = occ.where(writes(F.col("access"))).select(*key, F.col("device").alias("target")).distinct()
    return c.join(d, key).where("source <> target").select("project", "source", "target").distinct()


def rung_links(members: DataFrame, **sets: Column) -> DataFrame:
    """One row for each rung, with ``writes``, the devices it drives, and ``links``, an
    array of ``source, targets``: a condition of the rung and all that the rung drives,
    and what an operation reads and what it writes, all members of runs included, so
    a walk goes on from every device that a write covers. ``sets`` names further sets
    of the rung's devices by the conditions on their rows. Members are dealt by rung
    once, and not at all if they already are."""
    w, r = writes(F.col("access")), reads(F.col("access"))
    device, step = F.col("member_device"), F.struct("op_index", F.col("member_device").alias("device"))
    of = {"writes": (w, device), "conditions": (F.col("role").isin("a", "b"), device), "op_writes": (w, step), "op_reads": (r, step)} | {n: (c, device) for n, c in sets.items()}
    rungs = members.groupBy(*RUNG).agg(*[F.collect_set(F.when(c, x)).alias(n) for n, (c, x) in of.items()])
    link = lambda source, targets: F.struct(source.alias("source"), F.array_remove(targets, source).alias("targets"))
    by_rung = F.transform("conditions", lambda c: link(c, F.col("writes")))
    # what a condition's own operation writes is among what its rung drives
    other = F.filter("op_reads", lambda x: ~F.array_contains("conditions", x["device"]))
    by_flow = F.transform(other, lambda x: link(x["device"], F.transform(F.filter("op_writes", lambda y: y["op_index"] == x["op_index"]), lambda y: y["device"])))
    return rungs.select(*RUNG, "writes", F.filter(F.concat(by_rung, by_flow), lambda x: F.size(x["targets"]) > 0).alias("links"), *sets)


def fans(links: DataFrame) -> DataFrame:
    """``project, source, targets`` of ``rung_links``, a row a rung and source."""
    return links.select("project", F.explode("links").alias("link")).select("project", "link.source", "link.targets")


def device_edges(members: DataFrame) -> DataFrame:
    """Distinct ``project, source, target`` of the ``rung_links`` of members."""
    return fans(rung_links(members)).select("project", "source", F.explode("targets").alias("target")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None, forward: bool = True) -> tuple[DataFrame, bool]:
    """``seed, project, device, depth, parent`` within ``max_depth`` hops of
    ``seeds(seed, project, device)``, and whether a limit hid anything.

    The parent is the smallest device that leads there in the least hops.
    ``max_nodes`` keeps a seed's nearest devices, smallest names first.
    """
    frm, to = ("source", "target") if forward else ("target", "source")
    edges = stored(edges)
    key = ["seed", "project", "device"]
    seen = stored(seeds.select(*key).distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit("")))
    frontier, hidden = seen, False
    for depth in range(1, max_depth + 2):
        step = frontier.join(edges, (frontier["project"] == edges["project"]) & (frontier["device"] == edges[frm])).select(frontier["seed"], frontier["project"], edges[to].alias("device"), frontier["device"].alias("via"))
        step = step.join(seen, key, "left_anti").groupBy(*key).agg(F.min("via").alias("parent")).select(*key, F.lit(depth).alias("depth"), "parent")
        if depth > max_depth:
            return _limited(seen, max_nodes, hidden or not step.isEmpty())
        frontier = stored(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return _limited(seen, max_nodes, hidden)


def _limited(seen: DataFrame, max_nodes: int | None, hidden: bool) -> tuple[DataFrame, bool]:
    if max_nodes is None:
        return seen, hidden
    ranked = stored(seen.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "parent", "device"))))
    return ranked.where(F.col("rank") <= max_nodes).drop("rank"), hidden or not ranked.where(F.col("rank") > max_nodes).isEmpty()


def _reached(edges: DataFrame, start: DataFrame, forward: bool) -> DataFrame:
    """``start(project, device)`` and all that it leads to, or with ``forward`` off all that
    leads there. A device is in one hop's frontier only."""
    frm, to = ("source", "target") if forward else ("target", "source")
    seen = front = stored(start.select("project", "device").distinct())
    while not front.isEmpty():
        step = front.withColumnRenamed("device", frm).join(edges, ["project", frm]).select("project", F.col(to).alias("device")).distinct()
        front = stored(step.join(seen, ["project", "device"], "left_anti"))
        seen = seen.unionByName(front)
    return stored(seen)


def strong_components(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``project, device, component``: devices on a cycle of ``edges(project, source,
    target)``, with the smallest device that they reach and that reaches them. With
    ``of(project, device)``, at least those of these devices and of their components,
    which lie among what these devices reach and what reaches them.

    Colouring: the largest number spreads forward; a device that kept its own number
    is the root of its colour, and what leads to it within the colour is its
    component. Devices without a way in or out leave first. Each round is one join
    and one aggregation to a row a device, over numbers that stand for project and
    name, written to the shared folder, so neither a cycle nor a colour is gathered
    in one place. The number of rounds grows with the longest shortest way, not with
    the number of devices.
    """
    edges = stored(edges.select("project", "source", "target").distinct())
    loops = edges.where("source = target").select("project", F.col("source").alias("device"))
    named = edges.where("source <> target")
    if of is not None:
        for forward in (False, True):
            near = _reached(named, of, forward)
            named = stored(named.join(near.withColumnRenamed("device", "source"), ["project", "source"], "left_semi").join(near.withColumnRenamed("device", "target"), ["project", "target"], "left_semi").select("project", "source", "target"))
        loops = loops.join(near, ["project", "device"], "left_semi")
    names = named.select("project", F.col("source").alias("device")).union(named.select("project", F.col("target").alias("device"))).distinct()
    names = stored(names.withColumn("id", F.monotonically_increasing_id()))
    number = lambda c: names.select("project", F.col("device").alias(c), F.col("id").alias(f"{c}_id"))
    rest = stored(named.join(number("source"), ["project", "source"]).join(number("target"), ["project", "target"]).select(F.col("source_id").alias("source"), F.col("target_id").alias("target")))
    done = []
    while True:
        # on a cycle a device is a source and a target
        for _ in range(3):
            ends = stored(rest.select(F.col("source").alias("device")).intersect(rest.select(F.col("target").alias("device"))))
            of_end = lambda c: ends.select(F.col("device").alias(c))  # noqa: E731, B023
            rest = stored(rest.join(of_end("source"), "source", "left_semi").join(of_end("target"), "target", "left_semi").select("source", "target"))
        if rest.isEmpty():
            break
        nodes = rest.select(F.col("source").alias("device")).distinct()
        colour = stored(nodes.withColumn("colour", F.col("device")))
        changed = colour
        while not changed.isEmpty():
            sent = changed.withColumnRenamed("device", "source").join(rest, "source").groupBy(F.col("target").alias("device")).agg(F.max("colour").alias("sent"))
            after = stored(colour.join(sent, "device", "left").select("device", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("new")))
            changed, colour = after.where("new").select("device", "colour"), after.select("device", "colour")
        inside = rest.join(colour.select(F.col("device").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("device").alias("target"), F.col("colour").alias("ct")), "target").where("cs = ct")
        inside = stored(inside.select("source", "target"))
        found = front = stored(colour.where("device = colour"))
        while not front.isEmpty():
            back = front.withColumnRenamed("device", "target").join(inside, "target").select(F.col("source").alias("device"), "colour").distinct()
            front = stored(back.join(found, "device", "left_anti"))
            found = found.unionByName(front)
        found = stored(found)
        done.append(found)
        gone = lambda c: found.select(F.col("device").alias(c))  # noqa: E731, B023
        rest = stored(rest.join(gone("source"), "source", "left_anti").join(gone("target"), "target", "left_anti").select("source", "target"))
    out = loops.select("project", "device", F.col("device").alias("component"), F.lit(2).alias("size"))
    for f in done:
        f = f.withColumnRenamed("device", "id").join(names, "id")
        sizes = f.groupBy("colour").agg(F.min("device").alias("component"), F.count("*").alias("size"))
        out = out.unionByName(f.join(sizes, "colour").select("project", "device", "component", F.col("size").cast("int").alias("size")))
    return out.where("size > 1").groupBy("project", "device").agg(F.min("component").alias("component"))


def trace_upstream(occ: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """What each seed depends on, with whether a device has no driver (terminal),
    is a condition of a rung that drives it (self_reference), lies on a cycle of
    several devices (cycle, with the smallest device of it), or is driven by
    several coils."""
    edges = stored(rung_edges(occ))
    found = stored(reach(edges, seeds, max_depth, forward=False)[0])
    rings = strong_components(edges, found)
    per = occ.groupBy("project", "device").agg(F.count_distinct(F.when(writes(F.col("access")), F.struct("lddb", "pos"))).alias("drivers"), F.count_if(F.col("role") == "c").alias("coils"), F.count_if(F.col("role").isin("SET", "RST")).alias("latches"))
    own = occ.groupBy(*RUNG, "device").agg(F.max(F.col("role").isin("a", "b")).alias("c"), F.max(writes(F.col("access"))).alias("d")).where("c and d").select("project", "device", F.lit(True).alias("own")).distinct()
    found = found.join(own, ["project", "device"], "left").join(rings, ["project", "device"], "left")
    return found.join(per, ["project", "device"], "left").select("seed", "project", "device", "depth", "parent", (F.col("drivers") == 0).alias("terminal"), F.coalesce("own", F.lit(False)).alias("self_reference"), (F.col("coils") > 1).alias("multi_coil"), ((F.col("coils") > 0) & (F.col("latches") > 0)).alias("mixed"), F.col("component").isNotNull().alias("cycle"), F.coalesce("component", F.lit("")).alias("ring"))


def top_conditions(trace: DataFrame, occ: DataFrame, top: int) -> DataFrame:
    """For each seed of an upstream trace, the devices that are contacts in most of the
    rungs that drive what the trace found: ``seed, project, device, rungs, rank``. A
    rung counts once for a device and seed, whatever it drives."""
    drivers = occ.where(writes(F.col("access"))).select(*RUNG, "device").distinct()
    rungs = trace.select("seed", "project", "device").join(drivers, ["project", "device"]).select("seed", *RUNG).distinct()
    contacts = occ.where(F.col("role").isin("a", "b")).select(*RUNG, "device").distinct()
    uses = rungs.join(contacts, RUNG).groupBy("seed", "project", "device").agg(F.count("*").alias("rungs"))
    rank = F.row_number().over(Window.partitionBy("seed", "project").orderBy(F.desc("rungs"), "device"))
    return uses.withColumn("rank", rank).where(F.col("rank") <= top)


def value_sources(flow: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Devices whose values flow into the seeds, updates in place left out; terminal
    if nothing flows into them."""
    edges = flow.where("not read_modify_write").select("project", F.col("source_device").alias("source"), F.col("destination_device").alias("target")).distinct()
    found, _ = reach(edges, seeds, max_depth, forward=False)
    fed = edges.select("project", F.col("target").alias("device")).distinct().withColumn("fed", F.lit(True))
    return found.join(fed, ["project", "device"], "left").select("seed", "project", "device", "depth", F.col("fed").isNull().alias("terminal"))


def constant_candidates(occ: DataFrame, bit_types: list[str], areas: DataFrame | None = None, uncertain: DataFrame | None = None) -> DataFrame:
    """Outputs that may be shown constant: ``project, device, lddb, pos, ordered``.

    One plain coil in a wholly read rung writes the device, and nothing else does,
    runs included; it lies in no area, its rung is not ``uncertain(project, lddb,
    pos)``, and no occurrence of its type has an unknown range or access. ``ordered``
    says that every read comes later in the same program: only then may readers
    rely on the value.
    """
    from .facts import expand_members, first_reads
    from .lookup import area_of

    member = expand_members(occ)
    unsure = (F.col("access") == "ref") | (F.coalesce("range_len", F.lit(1)) <= 0)
    loose = occ.where(unsure).groupBy("project", "device_type").agg(F.max(F.col("access") != "read").alias("loose_write"), F.max(F.col("access") != "write").alias("loose_read"))
    single = member.where(writes(F.col("access"))).groupBy("project", F.col("member_device").alias("device")).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("role", "lddb", "pos", "device_type", "number", "range_len")]).where("n = 1 and role = 'c' and range_len = 1")
    single = single.where(F.col("device_type").isin(*bit_types)).join(loose, ["project", "device_type"], "left").where("not coalesce(loose_write, false)")
    partial = occ.where("parse_status <> 'exact'").select(*RUNG).distinct()
    single = single.join(partial, RUNG, "left_anti")
    if uncertain is not None:
        single = single.join(uncertain.select(*RUNG).distinct(), RUNG, "left_anti")
    if areas is not None:
        single = area_of(single.select("project", "device", "device_type", "number", "lddb", "pos", "loose_read"), areas).where("area_no is null")
    seen = first_reads(member).groupBy("project", F.col("member_device").alias("device")).agg(F.max(F.struct("lddb")).alias("last"), F.min(F.struct("lddb")).alias("first"), F.min("first_pos").alias("first_pos"), F.max((F.col("unknown_positions") > 0) | F.col("first_pos").isNull()).alias("unknown"))
    placed = single.join(seen, ["project", "device"], "left")
    inside = (F.col("first.lddb") == F.col("lddb")) & (F.col("last.lddb") == F.col("lddb")) & ~F.col("unknown") & (F.col("first_pos") > F.col("pos"))
    ordered = ~F.coalesce("loose_read", F.lit(False)) & (F.col("first").isNull() | F.coalesce(inside, F.lit(False)))
    return placed.select("project", "device", "lddb", "pos", ordered.alias("ordered"))


def propagate_constants(cond: DataFrame, facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Devices that are always on or off: ``project, device, value, round, depth, roots,
    chain`` from ``facts(project, device, value)``.

    ``cond`` has branches of literals; ``candidates`` are outputs of
    ``constant_candidates`` (without ``ordered``, all count as ordered). A branch is
    false with one false literal and true if all are; an output is true with one
    true branch and false if all are; edges are never known. Evidence goes along: a
    false branch rests on its false literal of least depth and name, a true one on
    all its literals; a true output on its true branch of least depth and number,
    a false one on all branches. ``roots`` are the facts it goes back to, ``chain`` the
    devices in between, ``depth`` the longest way. Rounds go on until none adds one.
    """
    if "ordered" in candidates.columns:
        candidates = candidates.where("ordered")
    none = F.array().cast("array<string>")
    known = stored(facts.select("project", "device", "value", F.lit(0).alias("round"), F.lit(0).alias("depth"), F.array("device").alias("roots"), none.alias("chain")))
    waiting = stored(candidates.select("project", "device").distinct().join(known, ["project", "device"], "left_anti"))
    why = ["depth", "roots", "chain"]
    spread = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    key = ["project", "lddb", "pos", "out_device"]
    # of a literal: 0 false, 1 true, 2 never known, null not yet
    truth = F.when(F.col("value") == 2, 2).when(F.col("required") == "a", F.col("value")).when(F.col("required") == "b", 1 - F.col("value"))
    empty = F.coalesce("device", F.lit("")) == ""
    told = known.select("project", "device", "value", *why, F.lit(True).alias("told")).unionByName(waiting.withColumn("told", F.lit(True)), allowMissingColumns=True)
    t = F.when(empty, 1).when(F.col("told").isNull() | ~F.col("required").isin("a", "b"), 2).otherwise(truth)
    # a branch without literals is true and its own root
    roots = F.when(empty, F.array(F.concat_ws(":", "lddb", "pos"))).otherwise(F.col("roots"))
    asked = cond.join(waiting.withColumnRenamed("device", "out_device"), ["project", "out_device"], "left_semi").join(told, ["project", "device"], "left")
    rest = stored(asked.select(*key, "branch", "device", "required", t.cast("int").alias("t"), "depth", roots.alias("roots"), "chain"))
    number = 0
    while True:
        number += 1
        evidence = F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "device", "required", F.coalesce("roots", none).alias("roots"), F.coalesce("chain", none).alias("chain"))
        sure = lambda c: F.coalesce(F.when(F.col("t") < 2, F.col(c)), none)
        branch = rest.groupBy(*key, "branch").agg(
            F.min("t").alias("low"), F.count_if(F.col("t").isNull()).alias("open"), F.count_if(F.col("t") == 2).alias("never"), F.min(F.when(F.col("t") == 0, evidence)).alias("false"), F.max(F.coalesce("depth", F.lit(0))).alias("deep"), spread(sure("roots")).alias("roots"), spread(sure("chain")).alias("chain")
        )
        off, on = F.col("low") == 0, (F.col("open") == 0) & (F.col("never") == 0)
        pick = lambda c, d: F.when(off, F.col(f"false.{c}")).when(on, F.col(d))
        branch = branch.select(*key, "branch", "open", "never", F.when(off, 0).when(on, 1).alias("b"), pick("depth", "deep").alias("depth"), pick("roots", "roots").alias("roots"), pick("chain", "chain").alias("chain"))
        undecided = F.col("b").isNull()
        out = branch.groupBy("project", F.col("out_device").alias("device")).agg(
            F.max("b").alias("high"), F.count_if(undecided).alias("undecided"), F.count_if(undecided & (F.col("never") == 0)).alias("may_hold"), F.count_if(undecided & (F.col("open") == 0)).alias("stuck"),
            F.min(F.when(F.col("b") == 1, F.struct("depth", "branch", "roots", "chain"))).alias("true"), F.max("depth").alias("deep"), spread(F.coalesce("roots", none)).alias("roots"), spread(F.coalesce("chain", none)).alias("chain"),
        )
        yes, no = F.coalesce(F.col("high") == 1, F.lit(False)), F.col("undecided") == 0
        pick = lambda c, d: F.when(yes, F.col(f"true.{c}")).when(no, F.col(d))
        value = F.when(yes, 1).when(no, 0).when((F.col("may_hold") == 0) & (F.col("stuck") > 0), 2)
        chain = F.when(yes | no, F.array_sort(F.array_union(pick("chain", "chain"), F.array("device"))))
        judged = stored(out.select("project", "device", value.alias("value"), (pick("depth", "deep") + 1).alias("depth"), pick("roots", "roots").alias("roots"), chain.alias("chain")))
        new = judged.where("value < 2")
        if new.isEmpty():
            return known
        known = known.unionByName(new.withColumn("round", F.lit(number)))
        # outputs that are settled leave, and so do those that no later fact can decide
        live, settled = judged.where("value is null"), judged.where("value is not null")
        if number == 1:
            # a candidate without a condition is never known
            settled = settled.unionByName(waiting.join(judged, ["project", "device"], "left_anti").withColumn("value", F.lit(2)), allowMissingColumns=True)
        rest = rest.join(live.select("project", F.col("device").alias("out_device")), ["project", "out_device"], "left_semi")
        columns = [*key, "branch", "device", "required", "t", *why]
        filled = rest.where("t is null").drop("t", *why).join(settled, ["project", "device"], "left").withColumn("t", truth.cast("int"))
        rest = stored(rest.where("t is not null").select(columns).unionByName(filled.select(columns)))


def constant_findings(constants: DataFrame, occ: DataFrame, output_types: list[str]) -> DataFrame:
    """Findings from constants that were derived (``round`` above 0): constant devices
    and outputs, and each of their contacts that is thereby dead or redundant."""
    found = constants.where("round > 0")
    kinds = occ.select("project", "device", "device_type").distinct()
    state = F.when(F.col("value") == 1, "ON").otherwise("OFF")
    own = found.join(kinds, ["project", "device"], "left").select("project", F.when(F.col("device_type").isin(*output_types), "constant-output").otherwise("constant-device").alias("category"), "device", state.alias("state"), F.lit(None).cast("string").alias("lddb"), F.lit(None).cast("long").alias("pos"), "depth", "roots")
    contacts = occ.where(F.col("role").isin("a", "b")).select("project", "device", "role", "lddb", "pos").distinct().join(found, ["project", "device"])
    true = (F.col("role") == "a") == (F.col("value") == 1)
    uses = contacts.select("project", F.when(true, "redundant-contact").otherwise("dead-contact").alias("category"), "device", F.when(true, "ALWAYS_TRUE").otherwise("ALWAYS_FALSE").alias("state"), "lddb", F.col("pos").cast("long").alias("pos"), "depth", "roots")
    return own.unionByName(uses)


def _seeds_beyond(found: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """``seed, more`` (true): seeds with an edge from their last hop to a device that is
    not in ``found``."""
    key = ["seed", "project"]
    last = stored(found.where(F.col("depth") == max_depth).select(*key, F.col("device").alias("source")))
    step = last.join(_as_fans(edges), ["project", "source"]).select(*key, F.explode("targets").alias("device")).distinct()
    return stored(step.join(found, [*key, "device"], "left_anti").select("seed").distinct().withColumn("more", F.lit(True)))


def _as_fans(edges: DataFrame) -> DataFrame:
    return (edges if "targets" in edges.columns else edges.withColumn("targets", F.array("target"))).select("project", "source", F.filter("targets", lambda x: x != F.col("source")).alias("targets"))


def _glimpses(ways: DataFrame) -> DataFrame:
    """``project, source, targets``: for each source one or two of the devices that are two
    hops away, the least and the greatest target of its greatest one."""
    ends = stored(ways.groupBy("project", "source").agg(F.min(F.array_min("targets")).alias("lo"), F.max(F.array_max("targets")).alias("hi")))
    on = ends.select("project", F.col("source").alias("via"), F.array("lo", "hi").alias("targets"))
    return ends.select("project", "source", F.col("hi").alias("via")).join(on, ["project", "via"]).select("project", "source", "targets")


#: 64-bit words of the bitmap that keeps rows out of a join, at most.
BITMAP_WORDS = 1 << 21


def _may_match(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the stored table ``keys``: a
    bitmap by hash of the keys, of a fixed size at most, is joined by broadcast, so
    they are not shuffled. The join after it makes the result exact."""
    words = min(BITMAP_WORDS, max(1024, 1 << (keys.count() // 4).bit_length()))
    at = F.pmod(F.xxhash64(*key), F.lit(64 * words))
    bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    marked = rows.withColumn("at", at).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(stored(bits)), "word")
    return marked.where(F.expr("getbit(bits, cast(at % 64 as int)) = 1")).select(rows.columns)


def change_impact(changed: DataFrame, old_writes: DataFrame, new_writes: DataFrame, edges: DataFrame, max_depth: int, marked: DataFrame | None = None) -> DataFrame:
    """For each changed rung ``(change_id, project, lddb, guid)``: devices it writes in
    either version, and how many devices, at what depth, these reach. With
    ``marked(project, device, kind)``, kind ``output`` or ``alarm``, also how many of
    these are written or reached. ``state`` is ``truncated`` where the depth hid a device
    of the change, else ``checked``.

    Writes have a ``device`` or an array ``devices`` a row, edges a ``target`` or an array
    ``targets``; they may repeat, are read several times, and should be stored. Changes
    are walked under numbers. A hop deals what it finds by change, targets still in
    their arrays, and what a change reached is told apart there: no more rows than its
    project has devices. With the last hop go one or two devices that lie two hops
    from each source: a change that did not find one of these is truncated. Only the
    changes that found them all are walked one hop further.
    """
    key = [c for c in ("project", "lddb", "guid") if c in changed.columns]
    changed = stored(changed.select("change_id", *key).distinct())
    seeds = stored(changed.select("change_id").distinct().withColumn("number", F.monotonically_increasing_id()))
    rungs = changed.join(seeds, "change_id").drop("change_id")
    device = lambda d: F.explode("devices").alias("device") if "devices" in d.columns else F.col("device")
    sides = [_may_match(d, changed, key).join(rungs, key).select("number", "project", device(d)) for d in ([old_writes] if new_writes is old_writes else [old_writes, new_writes])]
    found = front = stored(reduce(DataFrame.unionByName, sides).distinct().withColumn("depth", F.lit(0)))
    ways = _as_fans(edges)
    for depth in range(1, max_depth + 1):
        hop = ways.withColumn("depth", F.lit(depth))
        if depth == max_depth:
            hop = hop.unionByName(_glimpses(ways).withColumn("depth", F.lit(depth + 1)))
        step = front.select("number", "project", F.col("device").alias("source")).join(hop, ["project", "source"]).select("number", "project", "targets", "depth")
        dealt = found.select("number", "project", F.array("device").alias("targets"), "depth").unionByName(step).repartition("number")
        found = stored(dealt.select("number", "project", F.explode("targets").alias("device"), "depth").groupBy("number", "project", "device").agg(F.min("depth").alias("depth")))
        front = found.where(F.col("depth") == depth)
        if front.isEmpty():
            break
    within = F.col("depth") <= max_depth
    counts = [F.count_if(F.col("depth") == 0).alias("written"), F.count_if((F.col("depth") > 0) & within).alias("reached"), F.max(F.when(within, F.col("depth"))).alias("deepest"), F.max(~within).alias("more")]
    out = stored(found.groupBy("number").agg(*counts))
    found = found.where(within)
    unsure = out.where(~F.col("more") & (F.col("deepest") == max_depth)).select("number")
    beyond = _seeds_beyond(found.join(unsure, "number", "left_semi").withColumnRenamed("number", "seed"), ways, max_depth)
    out = out.join(beyond.select(F.col("seed").alias("number"), F.col("more").alias("also")), "number", "left")
    names = []
    if marked is not None:
        names = ["outputs", "alarms"]
        own = ["project", "device"]
        of = stored(marked.groupBy(*own).agg(F.max(F.col("kind") == "output").alias("outputs"), F.max(F.col("kind") == "alarm").alias("alarms")))
        held = _may_match(found, of, own).join(of, own).groupBy("number").agg(*[F.count_if(F.col(c)).alias(c) for c in names])
        out = out.join(held, "number", "left")
    state = F.when(F.col("more") | F.col("also"), "truncated").otherwise("checked")
    return out.join(seeds, "number").select(F.col("change_id").alias("seed"), "written", "reached", "deepest", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], state.alias("state"))
