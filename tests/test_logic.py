"""Call conditions, substitution, constants, cycles and scan order against brute force
over all assignments, or answers worked out by hand."""

from __future__ import annotations

import itertools
import random

import pytest

from rungfleet.operators import conditions, graph, order

from .test_small import COND, occ

DEVICES = [f"X{i}" for i in range(5)]
ASSIGNMENTS = [dict(zip(DEVICES, bits)) for bits in itertools.product((False, True), repeat=len(DEVICES))]


def dnf(rng, branches=2, literals=2):
    return [frozenset((rng.choice(DEVICES), rng.choice("ab")) for _ in range(rng.randint(1, literals))) for _ in range(rng.randint(1, branches))]


def true(cond, on):
    return any(all(on[d] == (r == "a") for d, r in b if d) for b in cond)


def grouped(rows, key):
    """The branches of each key, from rows of literals."""
    out = {}
    for r in rows:
        branch = out.setdefault(tuple(r[k] for k in key), {}).setdefault(r["branch"] if "branch" in r else r["zone_branch"], set())
        if r["device"]:
            branch.add((r["device"], r["required"]))
    return {k: list(v.values()) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_inherited_conditions_by_all_assignments(spark, seed):
    """Random programs of subroutines that call one another."""
    rng = random.Random(seed)
    marks, conds, sites = [], [], []
    for program in range(12):
        name, pos = f"L{program}", 0
        n = rng.randint(2, 5)
        for part in range(n + 1):  # the main part, then the subroutines
            if part:
                marks.append(("P", name, pos, "P", part))
            for _ in range(rng.randint(0 if part else 1, 2)):
                pos += 1
                target = rng.randint(1, n + 1) if rng.random() < 0.3 else min(n, part + rng.randint(1, 2))
                marks.append(("P", name, pos, "CALL", target))
                cond = dnf(rng) if rng.random() < 0.9 else None
                sites.append((name, part, target, pos, cond))
                conds += [("P", name, pos, i, d, r) for i, b in enumerate(cond or []) for d, r in b]
            pos += 1
            if part:
                marks.append(("P", name, pos, "RET", 0))
                pos += 1
    m = spark.createDataFrame(marks, "project string, lddb string, pos long, opcode string, pointer long")
    calls = m.where("opcode = 'CALL'").select("project", "lddb", "pointer", "pos")
    state, rows = conditions.inherited_conditions(conditions.call_scopes(m), calls, spark.createDataFrame(conds, "project string, lddb string, pos long, branch int, device string, required string"))
    state = {(r.lddb, r.pointer): r for r in state.collect()}
    starts = {(r.lddb, r.start_pos): (r.lddb, r.pointer) for r in state.values()}
    got = {starts[k]: v for k, v in grouped([r.asDict() for r in rows.collect()], ["lddb", "start_pos"]).items()}

    def calls_itself(name, scope):
        seen, front = set(), {scope}
        while front:
            front = {t for p, t in ((s[1], s[2]) for s in sites if s[0] == name) if p in front} - seen
            seen |= front
        return scope in seen

    def condition(name, scope):
        """Terms of a scope, or None if it has none."""
        if calls_itself(name, scope):
            return None
        terms = []
        for _, part, target, _, cond in [s for s in sites if s[0] == name]:
            above = condition(name, part) if target == scope and part else True
            if target == scope and cond and above is not None:
                terms.append((cond, above))
        return terms or None

    def runs(terms, on):
        return any(true(c, on) and (above is True or runs(above, on)) for c, above in terms)

    assert any(r.unresolved == "recursion" for r in state.values()) or seed
    for (name, scope), r in state.items():
        want = condition(name, scope)
        assert (r.branches is not None) == (want is not None), (name, scope, r)
        assert ("recursion" in r.unresolved) == calls_itself(name, scope)
        if want is not None:
            assert all(runs(want, on) == true(got.get((name, scope), []), on) for on in ASSIGNMENTS)


def test_call_reasons(spark):
    rows = [("P", "L", 1, "CALL", 1), ("P", "L", 2, "CALL", 3), ("P", "L", 10, "P", 1), ("P", "L", 11, "CALL", 2), ("P", "L", 12, "RET", 0), ("P", "L", 20, "P", 2), ("P", "L", 21, "CALL", 2), ("P", "L", 22, "CALL", 4), ("P", "L", 23, "RET", 0), ("P", "L", 30, "P", 3), ("P", "L", 31, "RET", 0), ("P", "L", 40, "P", 4), ("P", "L", 41, "RET", 0), ("P", "L", 50, "P", 5), ("P", "L", 51, "P", 5)]
    m = spark.createDataFrame(rows, "project string, lddb string, pos long, opcode string, pointer long")
    cond = spark.createDataFrame([("P", "L", p, 0, "X0", "a") for p in (1, 11, 21, 22)], "project string, lddb string, pos long, branch int, device string, required string")
    state, _ = conditions.inherited_conditions(conditions.call_scopes(m), m.where("opcode = 'CALL'"), cond)
    got = {r.pointer: (r.unresolved, r.branches) for r in state.collect()}
    # a call from a ring is left out, and so is one whose condition is not known
    assert got == {1: ("", 1), 2: ("recursion", None), 3: ("call condition unknown; no call", None), 4: ("caller unresolved; no call", None), 5: ("duplicate pointer", None)}


def test_conditions_of_rungs_in_subroutines(spark):
    rows = [("P", "L", 1, "CALL", 1), ("P", "L", 10, "P", 1), ("P", "L", 15, "RET", 0)]
    m = spark.createDataFrame(rows, "project string, lddb string, pos long, opcode string, pointer long")
    site = spark.createDataFrame([("P", "L", 1, 0, "X0", "a"), ("P", "L", 1, 1, "X1", "b")], "project string, lddb string, pos long, branch int, device string, required string")
    scopes = conditions.call_scopes(m)
    _, told = conditions.inherited_conditions(scopes, m.where("opcode = 'CALL'"), site)
    cond = spark.createDataFrame([("P", "L", 12, "Y0", 0, "X2", "a"), ("P", "L", 20, "Y1", 0, "X3", "a")], COND)
    inside = conditions.execution_context(cond.select("project", "lddb", "pos"), scopes, m.limit(0)).join(scopes.select("project", "lddb", "pointer", "start_pos"), ["project", "lddb", "pointer"]).withColumnRenamed("start_pos", "inner_start")
    got = {}
    for r in conditions.zone_conditions(cond, inside, told).collect():
        got.setdefault((r.out_device, r.zone_branch), set()).add((r.device, r.required))
    assert got == {("Y0", 0): {("X2", "a"), ("X0", "a")}, ("Y0", 1): {("X2", "a"), ("X1", "b")}, ("Y1", 0): {("X3", "a")}}


@pytest.mark.parametrize("depth", [1, 3])
def test_substitution_by_all_assignments(spark, depth):
    rng = random.Random(depth)
    rows, outs = [], {}
    for program in range(10):
        names = [f"M{i}" for i in range(6)]
        for pos, name in enumerate(names):
            cond = []
            for b in range(rng.randint(1, 2)):
                lits = {(rng.choice(DEVICES + names), rng.choice("ab")) for _ in range(rng.randint(1, 2))}
                if not any((d, "b") in lits for d, r in lits if r == "a"):
                    cond.append(lits)
            rows += [("P", f"L{program}", pos, name, b, d, r) for b, lits in enumerate(cond) for d, r in lits]
            if cond:
                outs[f"L{program}", name] = cond
    latched = spark.createDataFrame([("P", "M5")], "project string, device string")
    out = conditions.substitute(spark.createDataFrame(rows, COND), latched, ["project", "lddb", "pos", "out_device"], depth, most=4096).collect()
    got = grouped([r.asDict() for r in out if r.kind == "contact"], ["lddb", "out_device"])
    large = {(r.lddb, r.out_device) for r in out if r.kind == "too_large"}
    inner = {(p, n): c for (p, n), c in outs.items() if n != "M5"}

    def value(program, out, cond, level, on):
        def literal(d, r):
            v = value(program, out, inner[program, d], level - 1, on) if level and d != out and (program, d) in inner else on[d]
            return v == (r == "a")

        return any(all(literal(d, r) for d, r in b) for b in cond)

    checked = 0
    for (program, name), cond in outs.items():
        if (program, name) in large:
            continue
        for _ in range(60):
            on = {d: rng.random() < 0.5 for d in DEVICES + [f"M{i}" for i in range(6)]}
            assert value(program, name, cond, depth, on) == all_true(got.get((program, name), []), on)
            checked += 1
    assert checked > 1000


def all_true(cond, on):
    return any(all(on[d] == (r == "a") for d, r in b) for b in cond)


def test_too_large_and_edges(spark):
    many = [("P", "L", 1, "M1", b, f"X{b}", "a") for b in range(9)]
    edge = [("P", "L", 2, "M2", 0, "X0", "p")]
    use = [("P", "L", 3, "Y0", 0, "M1", "a"), ("P", "L", 4, "Y1", 0, "M2", "b"), ("P", "L", 5, "Y2", 0, "M2", "a"), ("P", "L", 6, "Y3", 0, "M1", "b")]
    out = conditions.substitute(spark.createDataFrame(many + edge + use, COND), spark.createDataFrame([], "project string, device string"), ["project", "lddb", "pos", "out_device"], 1, most=8).collect()
    kinds = {r.out_device: r.kind for r in out}
    assert kinds["Y0"] == kinds["Y1"] == "too_large" and kinds["Y2"] == "contact" and kinds["Y3"] == "contact"
    assert {(r.device, r.required) for r in out if r.out_device == "Y3"} == {(f"X{b}", "b") for b in range(9)}


def test_planted_rings(spark):
    rng = random.Random(5)
    edges = [("P", f"a{i}", f"a{(i + 1) % 7}") for i in range(7)] + [("P", f"b{i}", f"b{(i + 1) % 3}") for i in range(3)] + [("P", "a2", "b0"), ("P", "c", "c"), ("P", "b1", "d0"), ("P", "d0", "d1"), ("Q", "a0", "a1"), ("P", "e", "a0")]
    got = {(r.project, r.device): r.component for r in graph.strong_components(spark.createDataFrame(edges, "project string, source string, target string")).collect()}
    assert got == {("P", f"a{i}"): "a0" for i in range(7)} | {("P", f"b{i}"): "b0" for i in range(3)} | {("P", "c"): "c"}
    # random graphs against reachability
    pairs = {(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)}
    reach = {n: {n} for n in map(str, range(40))}
    for _ in range(40):
        for x, y in pairs:
            for s in reach.values():
                if x in s:
                    s.add(y)
    on = {n for n in reach if any(m != n and m in reach[n] and n in reach[m] for m in reach) or (n, n) in pairs}
    want = {n: min(m for m in reach if m in reach[n] and n in reach[m]) for n in on}
    rows = graph.strong_components(spark.createDataFrame([("P", *p) for p in pairs], "project string, source string, target string")).collect()
    assert {r.device: r.component for r in rows} == want


def test_constants_need_order_and_one_writer(spark):
    """A fact counts only where its write comes before every read in the same program."""
    base = [("SM1", "SM", 1, 1, "read", "a", 1), ("M1", "M", 1, 1, "write", "c", 1), ("M1", "M", 1, 1, "read", "a", 2), ("M2", "M", 2, 1, "write", "c", 2)]

    def found(rows, areas=None):
        o = occ(spark, *rows)
        return {(r.device, r.ordered) for r in graph.constant_candidates(o, ["M", "Y"], areas).collect()}

    assert found(base) == {("M1", True), ("M2", True)}
    # read before it is written, or in the same rung
    assert ("M1", False) in found([*base, ("M1", "M", 1, 1, "read", "a", 0)])
    assert ("M1", False) in found([*base, ("M1", "M", 1, 1, "read", "b", 1)])
    # a second writer, a latch, or a run that covers it
    assert found([*base, ("M1", "M", 1, 1, "write", "c", 9)]) == {("M2", True)}
    assert found([*base[:1], ("M1", "M", 1, 1, "write", "SET", 1)]) == set()
    assert found([*base, ("M0", "M", 0, 2, "write", "MOV", 9)]) == {("M2", True)}
    # an unknown range may be any device of its type
    assert found([*base, ("M9", "M", 9, 0, "write", "MOV", 9)]) == set()
    assert found([*base, ("M9", "M", 9, 0, "read", "MOV", 9)]) == {("M1", False), ("M2", False)}
    areas = spark.createDataFrame([("P", "M", 2, 3, 1, "a", "u")], "project string, device_type string, start_value long, end_value long, area_no int, kind string, unit_name string")
    assert found(base, areas) == {("M1", True)}
    # another program reads it
    o = occ(spark, *base)
    from pyspark.sql import functions as F

    other = o.where("device = 'M1' and access = 'read'").withColumn("lddb", F.lit("L9"))
    assert {(r.device, r.ordered) for r in graph.constant_candidates(o.union(other), ["M"]).collect()} == {("M1", False), ("M2", True)}
    late = o.where("pos = 2").select("project", "lddb", "pos")
    assert {r.device for r in graph.constant_candidates(o, ["M"], uncertain=late).collect()} == {"M1"}


def test_constants_carry_roots_and_findings(spark):
    rows = [("P", "L0", 1, "M1", 0, "SM1", "a"), ("P", "L0", 2, "M2", 0, "M1", "b"), ("P", "L0", 2, "M2", 1, "X9", "a"), ("P", "L0", 3, "Y3", 0, "M2", "b"), ("P", "L0", 3, "Y3", 0, "X9", "a"), ("P", "L0", 4, "M4", 0, "M1", "p"), ("P", "L0", 5, "M5", 0, "SM1", "b"), ("P", "L0", 5, "M5", 0, "SM2", "a"), ("P", "L0", 6, "M6", 0, "", "")]
    cond = spark.createDataFrame(rows, COND)
    given = spark.createDataFrame([("P", "SM1", 0), ("P", "SM2", 1)], "project string, device string, value int")
    outs = spark.createDataFrame([("P", d, True) for d in ("M1", "M2", "Y3", "M4", "M5", "M6")], "project string, device string, ordered boolean")
    got = {r.device: (r.value, r.depth, r.roots, r.chain) for r in graph.propagate_constants(cond, given, outs).where("round > 0").collect()}
    assert got == {"M1": (0, 1, ["SM1"], ["M1"]), "M2": (1, 2, ["SM1"], ["M1", "M2"]), "Y3": (0, 3, ["SM1"], ["M1", "M2", "Y3"]), "M5": (1, 1, ["SM1", "SM2"], ["M5"]), "M6": (1, 1, ["L0:6"], ["M6"])}
    o = occ(spark, ("M1", "M", 1, 1, "write", "c", 1), ("M1", "M", 1, 1, "read", "b", 2), ("M2", "M", 2, 1, "read", "b", 3), ("Y3", "Y", 3, 1, "write", "c", 3))
    facts = graph.propagate_constants(cond, given, outs)
    rows = {(r.category, r.device, r.state, r.pos) for r in graph.constant_findings(facts, o, ["Y"]).collect()}
    assert {("constant-output", "Y3", "OFF", None), ("constant-device", "M1", "OFF", None), ("redundant-contact", "M1", "ALWAYS_TRUE", 2), ("dead-contact", "M2", "ALWAYS_FALSE", 3)} <= rows
    # an output that is not ordered gives no fact, and nothing follows from it
    fewer = spark.createDataFrame([("P", "M1", False), ("P", "M2", True)], "project string, device string, ordered boolean")
    assert graph.propagate_constants(cond, given, fewer).where("round > 0").count() == 0


def test_scan_order_by_pairs(spark):
    """Nearest writers and counts against all pairs."""
    rng = random.Random(8)
    from pyspark.sql import functions as F

    rows, full = [], []
    for i in range(400):
        unit, pos, dev, access = rng.randrange(6), rng.randrange(12), rng.randrange(8), rng.choice(["read", "write", "both"])
        rows.append((f"M{dev}", "M", dev, 1, access, "c", pos))
        full.append((f"M{dev}", unit, pos, access))
    o = occ(spark, *rows)
    units = spark.createDataFrame([(f"o{i}", f"U{u}") for i, (_, u, _, _) in enumerate(full)], "occ_id string, unit string")
    from rungfleet.operators.facts import expand_members

    m = expand_members(o.join(units, "occ_id").withColumn("pou", F.col("unit")).withColumn("lddb", F.col("unit")).withColumn("opcode", F.when(F.col("device") == "M1", "PLS").when(F.col("device") == "M2", "MOVP").otherwise("OUT")))
    seq = {"U0": 10, "U1": 20, "U2": 20, "U3": None, "U4": 30}  # U5 is missing
    orders = spark.createDataFrame([("P", u, s) for u, s in seq.items()], "project string, pou string, seq int")
    traits = order.write_traits(m, ["M"], ["PLS"], ["MOVP"], "no such text")
    got = {(r.member_device, r.pou, r.pos): r for r in order.scan_order_readers(m, orders, traits, ["M"]).collect()}
    places = {}
    for d, u, p, a in full:
        w, r = places.get((d, f"U{u}", p), (False, False))
        places[d, f"U{u}", p] = (w or a != "read", r or a != "write")
    want = {k for k, (_, r) in places.items() if r}
    assert set(got) == want

    def seen(r, w):
        if r[1] == w[1]:
            return "fresh" if w[2] < r[2] else "stale" if w[2] > r[2] else "same_row"
        x, y = seq.get(w[1]), seq.get(r[1])
        return "unknown" if x is None or y is None or x == y else "fresh" if x < y else "stale"

    for k in want:
        writers = [w for w, (is_w, _) in places.items() if w[0] == k[0] and is_w]
        r = got[k]
        for kind in ("fresh", "stale", "same_row", "unknown"):
            assert getattr(r, kind) == sum(seen(k, w) == kind for w in writers), (k, kind)
        near = lambda w: (w[1] == k[1], seq.get(w[1]) or 0, w[2], w[1])  # noqa: E731, B023
        before = max((w for w in writers if seen(k, w) == "fresh"), key=near, default=(None,) * 3)
        far = lambda w: (w[1] != k[1], seq.get(w[1]) or 0, w[2], w[1])  # noqa: E731, B023
        after = min((w for w in writers if seen(k, w) == "stale"), key=far, default=(None,) * 3)
        assert (r.before_pou, r.before_pos, r.after_pou, r.after_pos) == (before[1], before[2], after[1], after[2])
        if r.stale:
            assert r.severity == {"M1": "HIGH", "M2": "LOW"}.get(k[0], "MEDIUM")
