"""Logic over condition tables: branches of literals, one row a literal."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import branches as br
from .graph import stored, strong_components


def interlock_pairs(cond: DataFrame, pairs: DataFrame, key: list[str], most: int = 10_000) -> DataFrame:
    """Can two outputs be on together? ``exclusive`` if every pair of their branches holds
    a literal and its opposite; else ``witness`` gives literals under which both are
    on, the first such pair of branches merged, as ``device=a`` or ``device=b``.

    ``pairs`` names the outputs to compare, ``lddb, pos_a, out_a, pos_b, out_b`` with
    ``project``. Pairs of outputs with more than ``most`` pairs of branches are not
    expanded: ``exclusive`` is null for them.
    """
    table = br.branch_table(cond, key)
    sizes = table.groupBy(*key).agg(F.count("*").alias("n"))
    end = lambda p, df, x: df.select("project", "lddb", F.col("pos").alias(f"pos_{p}"), F.col("out_device").alias(f"out_{p}"), F.col(x).alias(f"{x}_{p}"))
    of = lambda p: ["project", "lddb", f"pos_{p}", f"out_{p}"]
    pair = ["project", "lddb", "pos_a", "out_a", "pos_b", "out_b"]
    asked = pairs.select(*pair).distinct().join(end("a", sizes, "n"), of("a")).join(end("b", sizes, "n"), of("b")).withColumn("pairs", F.col("n_a") * F.col("n_b"))
    few = asked.where(F.col("pairs") <= most).select(*pair)
    both = few.join(end("a", table, "lits"), of("a")).join(end("b", table, "lits"), of("b"))
    merged = both.select(*pair, F.array_sort(F.array_union("lits_a", "lits_b")).alias("lits")).where(~br.clashes(F.col("lits")))
    first = merged.groupBy(*pair).agg(F.min("lits").alias("w"))
    out = asked.join(first, pair, "left")
    witness = F.array_join(F.transform("w", lambda x: F.concat(x["device"], F.lit("="), x["required"])), ",")
    return out.select(*pair, F.when(F.col("pairs") <= most, F.col("w").isNull()).alias("exclusive"), "pairs", F.coalesce(witness, F.lit("")).alias("witness"))


#: Branches of one output beyond which a condition is given up as too large.
MOST_BRANCHES = 2000


#: What follows LD, AND or OR in a contact's opcode, and the state it asks of its device.
CONTACTS = {"": "a", "I": "b", "P": "p", "F": "f", "PI": "pi", "FI": "fi"}
#: Instructions after which the order of steps no longer tells what runs.
JUMPS = ("MC", "MCR", "CALL", "CALLP", "CJ", "SCJ", "JMP", "RET", "IRET", "FOR", "NEXT")


def _contact(opcode: str, operand: str) -> tuple[str, tuple[str, str]] | None:
    """``LD``, ``AND`` or ``OR`` and the literal, if the instruction is a contact or a
    compare. A compare is a literal on its own text."""
    op = "ANDI" if opcode == "ANI" else opcode
    for mode in ("LD", "AND", "OR"):
        rest = op.removeprefix(mode)
        if op.startswith(mode) and rest in CONTACTS:
            return mode, (operand, CONTACTS[rest])
        if op.startswith(mode) and any(c in rest for c in "=<>"):
            return mode, (f"{rest} {operand}", "a")
    return None


def _and(x: set, y: set) -> set:
    """Both: every branch with every other; branches that want a device on and off go."""
    both = {a | b for a in x for b in y}
    return {s for s in both if not any((d, "b") in s for d, r in s if r == "a")}


def _not(x: set) -> set | None:
    """The complement, by De Morgan; None if it is too large or has an edge."""
    flip, out = {"a": "b", "b": "a"}, {frozenset()}
    for branch in x:
        if any(r not in flip for _, r in branch):
            return None
        out = _and(out, {frozenset([(d, flip[r])]) for d, r in branch})
        if len(out) > MOST_BRANCHES:
            return None
    return out


def fold_program(rows: list[tuple]) -> list[tuple]:
    """Folds one program's ``(step, opcode, operand)`` rows, in order, into
    ``(step, out_device, branch, device, required, kind)``.

    The last block of a stack is the current condition. LD begins a block, AND and
    OR, compares too, go on with it, ANB and ORB join the last two; MPS keeps the
    current condition, MRD and MPP bring it back and leave the blocks below as
    they are. Other instructions are outputs and take the current condition; the
    next LD then begins a rung. What does not work out, blocks that are left over
    included, gives an ``error`` row; an output without any condition is
    ``no_condition``; after a jump rows are ``uncertain``.
    """
    out: list[tuple] = []
    stack: list[set | None] = []
    saved: list[set | None] = []
    after_output = tainted = False

    def joined(x: set | None, y: set | None, both) -> set | None:
        return None if x is None or y is None else both(x, y)

    for step, opcode, operand in rows:
        op = opcode.upper()
        contact = _contact(op, operand)
        try:
            if contact:
                mode, literal = contact
                one = {frozenset([literal])}
                if mode == "LD":
                    if after_output:
                        if len(stack) > 1:
                            raise IndexError
                        stack = []
                    stack.append(one)
                else:
                    stack[-1] = joined(stack[-1], one, _and if mode == "AND" else set.union)
                after_output = False
            elif op in ("ANB", "ORB"):
                b, a = stack.pop(), stack.pop()
                stack.append(joined(a, b, _and if op == "ANB" else set.union))
                after_output = False
            elif op == "MPS":
                saved.append(stack[-1])
                after_output = False
            elif op in ("MRD", "MPP"):
                stack[-1:] = [saved[-1] if op == "MRD" else saved.pop()]
                after_output = False
            elif op == "INV":
                stack[-1] = None if stack[-1] is None else _not(stack[-1])
                after_output = False
            elif op in ("MEP", "MEF"):
                stack[-1] = joined(stack[-1], {frozenset([(op, op[-1].lower())])}, _and)
                after_output = False
            elif op in ("END", "FEND"):
                if len(stack) > 1 or saved:
                    raise IndexError
                stack, after_output = [], False
            elif op != "NOP":
                tainted = tainted or op in JUMPS
                if len(stack) > 1 and not saved:
                    raise IndexError
                if op not in JUMPS:
                    out += _output_rows(step, operand, stack, "uncertain" if tainted else "contact")
                after_output = True
        except IndexError:
            out.append((step, operand or "", 0, "", "", "error"))
            stack, saved, after_output = [], [], False
    if len(stack) > 1 or saved:
        out.append((rows[-1][0], "", 0, "", "", "error"))
    return out


def _output_rows(step: int, operand: str, stack: list[set | None], kind: str) -> list[tuple]:
    """The rows of one output under the current condition."""
    if not stack:
        return [(step, operand, 0, "", "", "no_condition")]
    if stack[-1] is None or len(stack[-1]) > MOST_BRANCHES:
        return [(step, operand, 0, "", "", "too_large")]
    branches = sorted(tuple(sorted(b)) for b in stack[-1])
    return [x for n, b in enumerate(branches) for x in ([(step, operand, n, d, r, kind) for d, r in b] or [(step, operand, n, "", "", "true")])]


def fold_conditions(instructions: DataFrame) -> DataFrame:
    """``cond`` rows from instruction lists ``(project, program, step, opcode,
    operand)``; a compare's two operands stand in ``operand`` with a blank between.
    The stack machine needs a program's rows in order, so a program, which a
    controller's memory bounds, is one group."""
    import pandas as pd

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        rows = fold_program(list(zip(pdf["step"].tolist(), pdf["opcode"], pdf["operand"].fillna(""), strict=True)))
        return pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=["project", "program", "step", "out_device", "branch", "device", "required", "kind"])

    return instructions.select("project", "program", "step", "opcode", "operand").groupBy("project", "program").applyInPandas(fold, "project string, program string, step long, out_device string, branch long, device string, required string, kind string")


def fold_rung(cells: list[tuple], wires: set[tuple], width: int) -> list[tuple]:
    """Folds one drawn rung: ``cells`` are ``(row, col, kind, device)`` with kind a,
    b, line or out, ``wires`` are ``(row, col)`` where a vertical wire joins a row
    and the next on the cell's left. Returns ``(out_device, branch, device,
    required, kind)``."""
    at = {(r, c): (k, d) for r, c, k, d in cells}
    height = 1 + max((r for r, *_ in cells), default=0)
    power: list[set] = [{frozenset()} for _ in range(height)]
    out: list[tuple] = []
    for col in range(width + 1):
        # rows joined by vertical wires have the power of any of them
        row = 0
        while row < height:
            end = row
            while (end, col) in wires and end + 1 < height:
                end += 1
            if end > row:
                joined = set().union(*power[row : end + 1])
                for i in range(row, end + 1):
                    power[i] = joined
            row = end + 1
        if any(len(p) > MOST_BRANCHES for p in power):
            return [(d, 0, "", "", "too_large") for _, _, k, d in cells if k == "out"]
        for r in range(height):
            kind, device = at.get((r, col), ("", ""))
            if kind in ("a", "b"):
                power[r] = _and(power[r], {frozenset([(device, kind)])})
            elif kind == "out":
                for n, branch in enumerate(sorted(tuple(sorted(b)) for b in power[r])):
                    out += [(device, n, d, q, "contact") for d, q in branch] or [(device, n, "", "", "true")]
            elif kind != "line":
                power[r] = set()
    return out


@lru_cache(maxsize=10_000)
def _folded(drawn: str, width: int) -> tuple[tuple, ...]:
    """``fold_rung`` of a JSON list of cells and wires; a worker keeps what rungs that
    are drawn alike have in common."""
    cells = [(c["row"], c["col"], c["kind"], c.get("device")) for c in json.loads(drawn)]
    return tuple(fold_rung([c for c in cells if c[2] != "wire"], {c[:2] for c in cells if c[2] == "wire"}, width))


def fold_wiring(cells: DataFrame, wires: DataFrame, width: int) -> DataFrame:
    """``cond`` rows from drawn rungs: ``cells(project, lddb, pos, row, col, kind,
    device)`` and ``wires(project, lddb, pos, row, col)``. A rung's cells, which the
    drawing bounds, are one text, and rungs are folded one by one."""
    import pandas as pd

    both = cells.select("project", "lddb", "pos", "row", "col", "kind", "device").union(wires.select("project", "lddb", "pos", "row", "col", F.lit("wire"), F.lit("")))
    rungs = both.groupBy("project", "lddb", "pos").agg(F.to_json(F.array_sort(F.collect_list(F.struct("row", "col", "kind", "device")))).alias("drawn"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_folded(x, width) for x in b["drawn"]]
            rows = pd.DataFrame([r for f in found for r in f], columns=["out_device", "branch", "device", "required", "kind"])
            keys = b[["project", "lddb", "pos"]]
            yield pd.concat([keys.loc[keys.index.repeat([len(f) for f in found])].reset_index(drop=True), rows], axis=1)

    return rungs.mapInPandas(fold, "project string, lddb string, pos long, out_device string, branch long, device string, required string, kind string")


def mc_zones(marks: DataFrame) -> DataFrame:
    """Zones from ``marks(project, lddb, pos, opcode, nesting)``: MC opens one, the
    next MCR of its nesting or a lower one closes it; null if none does. Nestings
    are few (0 to 14 by the instruction), so each closing mark counts for every
    nesting from its own up, and a zone's end is the next of these in its program:
    one window, no join."""
    key = ["project", "lddb"]
    most = 14
    opening = marks.where("opcode = 'MC'").select(*key, "pos", F.col("nesting").cast("int").alias("nesting"), F.lit(True).alias("opens"))
    closing = marks.where("opcode = 'MCR'").select(*key, "pos", F.explode(F.sequence(F.col("nesting").cast("int"), F.greatest(F.lit(most), F.col("nesting").cast("int")))).alias("nesting"), F.lit(False))
    ahead = Window.partitionBy(*key, "nesting").orderBy("pos", "opens").rowsBetween(1, Window.unboundedFollowing)
    end = F.min(F.when(~F.col("opens"), F.col("pos"))).over(ahead)
    return opening.union(closing).withColumn("end_pos", end).where("opens").select(*key, F.col("pos").alias("start_pos"), "nesting", "end_pos")


def apply_zones(rungs: DataFrame, zones: DataFrame) -> DataFrame:
    """For each rung, the zones it lies strictly inside: how many, and the start of
    the innermost. Zones of one nesting do not overlap, so a rung is inside the
    last one of each nesting that began before it and has not ended: one window
    over starts and rungs for each nesting, at most 15 rows a rung."""
    key = ["project", "lddb"]
    nestings = zones.select(*key, "nesting").distinct()
    asked = rungs.select(*key, "pos").distinct().join(nestings, key).select(*key, "nesting", "pos", F.lit(1).alias("kind"), F.lit(None).cast("struct<start_pos:bigint,end_pos:bigint>").alias("zone"))
    starts = zones.select(*key, "nesting", F.col("start_pos").alias("pos"), F.lit(2), F.struct(F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos")))
    # a rung at a zone's start comes before it and is outside
    last = F.last("zone", ignorenulls=True).over(Window.partitionBy(*key, "nesting").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    inside = asked.union(starts).withColumn("z", last).where((F.col("kind") == 1) & F.col("z").isNotNull() & (F.col("z.end_pos").isNull() | (F.col("pos") < F.col("z.end_pos"))))
    return inside.groupBy(*key, "pos").agg(F.count("*").alias("zones"), F.max("z.start_pos").alias("inner_start"))


def zone_conditions(cond: DataFrame, rung_zones: DataFrame, zone_cond: DataFrame) -> DataFrame:
    """``cond`` rows whose rung lies in a master-control zone, with the zone's own
    condition added to each branch: every branch of the rung with every branch of
    the innermost zone. ``rung_zones(project, lddb, pos, inner_start)`` and
    ``zone_cond(project, lddb, start_pos, zone_branch, device, required)``. Rungs
    outside all zones pass unchanged."""
    key = ["project", "lddb", "pos", "out_device"]
    placed = cond.join(rung_zones.select("project", "lddb", "pos", "inner_start"), ["project", "lddb", "pos"], "left")
    zones = zone_cond.select("project", "lddb", F.col("start_pos").alias("inner_start"), "zone_branch").distinct()
    inside = placed.join(zones, ["project", "lddb", "inner_start"], "left").withColumn("zone_branch", F.coalesce("zone_branch", F.lit(0)))
    own = inside.select(*key, "branch", "zone_branch", "device", "required")
    heads = inside.where("inner_start is not null").select(*key, "branch", "zone_branch", "inner_start").distinct()
    added = heads.join(zone_cond.withColumnRenamed("start_pos", "inner_start"), ["project", "lddb", "inner_start", "zone_branch"]).select(*key, "branch", "zone_branch", "device", "required")
    return own.union(added).distinct()


def call_scopes(marks: DataFrame) -> DataFrame:
    """Subroutines from ``marks(project, lddb, pos, opcode, pointer)`` with opcodes P
    (pointer), RET and CALL: each pointer's range and callers, and why a scope is
    unresolved (duplicate pointer, no RET, never called, calls itself). A scope
    ends at the next RET of its program, found by one window."""
    key = ["project", "lddb"]
    ahead = Window.partitionBy(*key).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    ends = marks.where("opcode in ('P', 'RET')").withColumn("end_pos", F.min(F.when(F.col("opcode") == "RET", F.col("pos"))).over(ahead)).where("opcode = 'P'")
    first = F.min_by("end_pos", "pos")
    ends = ends.groupBy(*key, "pointer").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n"), first.alias("end_pos"))
    calls = marks.where("opcode = 'CALL'").select(*key, "pointer", F.col("pos").alias("call_pos"))
    own = (F.col("call_pos") > F.col("start_pos")) & (F.col("call_pos") < F.col("end_pos"))
    s = ends.join(calls, [*key, "pointer"], "left").groupBy(*key, "pointer", "start_pos", "n", "end_pos").agg(F.count("call_pos").alias("calls"), F.count_if(own).alias("own"))
    why = F.when(F.col("n") > 1, "duplicate pointer").when(F.col("end_pos").isNull(), "no RET").when(F.col("own") > 0, "recursion").when(F.col("calls") == 0, "no call").otherwise("")
    return s.select(*key, "pointer", "start_pos", "end_pos", "calls", why.alias("unresolved"))


def execution_context(rungs: DataFrame, scopes: DataFrame, jumps: DataFrame) -> DataFrame:
    """For each rung ``(project, lddb, pos)`` whether a jump comes before it in its
    program (``after_jump``: what runs is then not sure), and the ``pointer`` of
    the subroutine it lies in, with why its callers are not known
    (``unresolved``), from ``call_scopes`` and ``jumps(project, lddb, pos)``. One
    window over rungs, starts and jumps."""
    key = ["project", "lddb"]
    shape = "struct<pointer:bigint,end_pos:bigint,unresolved:string>"
    none = F.lit(None).cast(shape)
    at = rungs.select(*key, "pos", F.lit(1).alias("kind"), none.alias("scope"))
    starts = scopes.select(*key, F.col("start_pos").alias("pos"), F.lit(2), F.struct(F.col("pointer").cast("long").alias("pointer"), F.col("end_pos").cast("long").alias("end_pos"), "unresolved").cast(shape))
    # a rung at a start or a jump comes before it
    so_far = Window.partitionBy(*key).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = at.union(starts).union(jumps.select(*key, "pos", F.lit(3), none))
    placed = both.withColumn("s", F.last("scope", ignorenulls=True).over(so_far)).withColumn("after_jump", F.max(F.col("kind") == 3).over(so_far)).where("kind = 1")
    inside = F.col("s").isNotNull() & (F.col("s.end_pos").isNull() | (F.col("pos") < F.col("s.end_pos")))
    return placed.select(*key, "pos", "after_jump", F.when(inside, F.col("s.pointer")).alias("pointer"), F.when(inside, F.col("s.unresolved")).otherwise("").alias("unresolved"))


def inherited_conditions(scopes: DataFrame, calls: DataFrame, site_cond: DataFrame, most: int = MOST_BRANCHES) -> tuple[DataFrame, DataFrame]:
    """The condition under which each subroutine runs, from ``call_scopes``,
    ``calls(project, lddb, pointer, pos)`` and the conditions of the rungs that call,
    ``site_cond(project, lddb, pos, branch, device, required)``.

    A scope runs if one of its calls does; a call inside another scope also needs
    that scope to run. Scopes are settled in rounds, callers first. Scopes on a
    cycle of calls have no condition; a call from a scope without one is left out
    and marked, and so is a call whose rung's condition is not known.

    Returns ``project, lddb, pointer, start_pos, end_pos, unresolved, branches`` a scope
    (``branches`` null without a condition, 0 if it can never run), and the
    conditions as ``project, lddb, start_pos, zone_branch, device, required``, the form
    that ``zone_conditions`` takes. Rounds are as many as calls are nested.
    """
    key = ["project", "lddb", "pointer"]
    scopes = stored(scopes)
    whole = scopes.where("unresolved in ('', 'recursion', 'no call')").select(*key)
    sites = calls.select(*key, F.col("pos").alias("site")).distinct().join(whole, key, "left_semi")
    placed = execution_context(sites.select("project", "lddb", F.col("site").alias("pos")).distinct(), scopes, sites.select("project", "lddb", F.col("site").alias("pos")).limit(0))
    sites = stored(sites.join(placed.select("project", "lddb", F.col("pos").alias("site"), F.col("pointer").alias("parent")), ["project", "lddb", "site"]))
    own = stored(br.branch_table(site_cond, ["project", "lddb", "pos"]).withColumnRenamed("pos", "site"))
    node = lambda c: F.concat_ws("/", "lddb", F.col(c).cast("string"))
    cyclic = strong_components(sites.where("parent is not null").select("project", node("parent").alias("source"), node("pointer").alias("target")))
    named = scopes.select(*key, node("pointer").alias("device"))
    cyclic = stored(named.join(cyclic, ["project", "device"], "left_semi").select(*key))

    # settled(key, reason, has): has says that there is a condition, perhaps one that is never true
    bad = scopes.join(whole, key, "left_anti").select(*key, F.col("unresolved").alias("reason"))
    settled = stored(bad.union(cyclic.select(*key, F.lit("recursion"))).withColumn("has", F.lit(False)))
    known = stored(scopes.select(*key, F.array().cast(br.LITERALS).alias("lits")).limit(0))
    open_ = stored(scopes.select(*key).join(settled, key, "left_anti"))
    site_key = [*key, "site"]
    while not open_.isEmpty():
        waiting = sites.where("parent is not null").join(settled.select("project", "lddb", F.col("pointer").alias("parent")), ["project", "lddb", "parent"], "left_anti").select(*key).distinct()
        ready = stored(open_.join(waiting, key, "left_anti"))
        if ready.isEmpty():
            raise ValueError("calls form a cycle that was not found")
        mine = sites.join(ready, key, "left_semi").join(own.select("project", "lddb", "site", F.lit(True).alias("told")).distinct(), ["project", "lddb", "site"], "left")
        mine = mine.join(settled.select("project", "lddb", F.col("pointer").alias("parent"), F.col("has").alias("parent_has")), ["project", "lddb", "parent"], "left").withColumn("ok", F.col("told").isNotNull() & (F.col("parent").isNull() | F.coalesce("parent_has", F.lit(False))))
        mine = stored(mine)
        good = mine.where("ok").select(*site_key, "parent")
        at_site = good.join(own, ["project", "lddb", "site"]).select(*site_key, "lits")
        plain = at_site.join(good.where("parent is null").select(*site_key), site_key, "left_semi")
        above = good.where("parent is not null").join(known.select("project", "lddb", F.col("pointer").alias("parent"), "lits"), ["project", "lddb", "parent"]).select(*site_key, "lits")
        nested, large = br.conjoin(at_site.join(good.where("parent is not null").select(*site_key), site_key, "left_semi"), above, site_key, most)
        rows = stored(plain.select(*key, "lits").union(nested.select(*key, "lits")).distinct())
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*key)
        large = stored(large.select(*key).union(sizes).distinct().withColumn("large", F.lit(True)))
        state = ready.join(mine.groupBy(*key).agg(F.count_if(F.col("ok")).alias("good"), F.count_if(F.col("told").isNull()).alias("silent"), F.count_if(F.col("told").isNotNull() & ~F.col("ok")).alias("cut")), key, "left").join(large, key, "left")
        reason = F.concat_ws("; ", F.when(F.col("large"), "too large"), F.when(F.col("silent") > 0, "call condition unknown"), F.when(F.col("cut") > 0, "caller unresolved"), F.when(F.coalesce("good", F.lit(0)) == 0, "no call"))
        settled = settled.unionByName(stored(state.select(*key, reason.alias("reason"), (F.col("large").isNull() & (F.coalesce("good", F.lit(0)) > 0)).alias("has"))))
        known = known.unionByName(stored(rows.join(large, key, "left_anti")))
        open_ = stored(open_.join(ready, key, "left_anti"))
    known, settled = stored(known), stored(settled)
    counted = settled.join(known.groupBy(*key).agg(F.count("*").alias("n")), key, "left")
    state = scopes.select(*key, "start_pos", "end_pos").join(counted, key).select(*key, "start_pos", "end_pos", F.col("reason").alias("unresolved"), F.when(F.col("has"), F.coalesce("n", F.lit(0))).alias("branches"))
    told = br.literal_rows(known.join(scopes.select(*key, "start_pos"), key).select("project", "lddb", "start_pos", "lits"), ["project", "lddb", "start_pos"], most)
    return state, told.withColumnRenamed("branch", "zone_branch")


def substitute(cond: DataFrame, latched: DataFrame, key: list[str], depth: int, most: int = 64) -> DataFrame:
    """Conditions in which devices that one rung of the program drives, and that do
    not latch, are replaced by that rung's own condition, ``depth`` times; an
    off-contact by its complement.

    A level is one join of the literals with the conditions that stand for them
    and one aggregation a branch. The number of branches that a level could make
    is counted first: an output is ``too_large`` where it is above ``most`` squared,
    where more than ``most`` are left, or where a complement has an edge or could be
    above ``most`` squared.
    """
    group = [k for k in key if k not in ("pos", "out_device")]
    work = most * most
    now = stored(br.branch_table(cond, key))
    places = now.select(*key).distinct().groupBy(*group, "out_device").agg(F.count("*").alias("places"))
    inner = now.join(places.where("places = 1"), [*group, "out_device"]).join(latched.select("project", F.col("device").alias("out_device")).distinct(), ["project", "out_device"], "left_anti")
    inner = inner.groupBy(*group, F.col("out_device").alias("device")).agg(F.array_sort(F.collect_set("lits")).alias("on"))
    inner = stored(inner.select(*group, "device", F.when(F.size("on") <= work, F.col("on")).alias("a"), br.complement(F.col("on"), work).alias("b"), F.lit(True).alias("found")))
    outs = stored(now.select(*key).distinct())
    large = stored(outs.limit(0))
    for _ in range(depth):
        ids = now.withColumn("id", F.xxhash64("lits")).select(*key, "id", "lits", F.explode_outer("lits").alias("l"))
        swap = F.col("found") & (F.col("l.device") != F.col("out_device")) & F.col("l.required").isin("a", "b")
        alone = F.when(F.col("l").isNull(), F.array(F.array().cast(br.LITERALS))).otherwise(F.array(F.array("l")))
        part = F.when(swap & (F.col("l.required") == "a"), F.col("a")).when(swap, F.col("b")).otherwise(alone)
        met = ids.join(inner.withColumnRenamed("device", "d"), [*[ids[g].eqNullSafe(inner[g]) for g in group], F.col("l.device") == F.col("d")], "left").select(*[ids[k] for k in key], "lits", part.alias("part"))
        branch = met.groupBy(*key, "lits").agg(F.collect_list("part").alias("parts"), F.count_if(F.col("part").isNull()).alias("missing"), F.product(F.coalesce(F.size("part"), F.lit(1)).cast("double")).alias("ways"))
        branch = stored(branch)
        over = branch.groupBy(*key).agg(F.sum("ways").alias("ways"), F.sum("missing").alias("missing")).where((F.col("ways") > work) | (F.col("missing") > 0)).select(*key)
        grown = branch.join(over, key, "left_anti").select(*key, F.explode(br.product(F.col("parts"))).alias("lits")).distinct()
        grown = stored(grown)
        over = over.union(grown.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*key))
        large = stored(large.union(over).distinct())
        now = stored(grown.join(large, key, "left_anti"))
    rows = br.literal_rows(now, key, most).withColumn("kind", F.lit("contact"))
    given_up = large.select(*key, F.lit(0).alias("branch"), F.lit("").alias("device"), F.lit("").alias("required"), F.lit("too_large").alias("kind"))
    return rows.unionByName(given_up).withColumn("branch", F.col("branch").cast("long")).select(*key, "branch", "device", "required", "kind")
