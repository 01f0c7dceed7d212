"""Operators on hand-made rows with answers worked out by hand."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from rungfleet.functions import devices, operands, texts
from rungfleet.operators import checks, conditions, diff, facts, graph, logs, lookup
from rungfleet.sources import readers

OCC = "project string, occ_id string, lddb string, pos long, op_index int, arg_index int, device string, device_type string, number long, range_len int, access string, role string, opcode string, const_args string, pou string, step int, title string, comment string, parse_status string"


def occ(spark, *rows):
    """Rows of (device, type, number, range_len, access, role, pos)."""
    full = [("P", f"o{i}", "L0", r[6], 0, i, r[0], r[1], r[2], r[3], r[4], r[5], "MOV", "K1", "L0", i, "", "c", "exact") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, OCC)


def test_split_device(spark):
    cases = {"XA": ("X", 10), "x0a": ("X", 10), "ST10": ("ST", 10), "D1A": None, "SB1F": ("SB", 31), "M100": ("M", 100), "": None, "Q7": ("Q", 7), " w1f ": ("W", 31), None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", devices.split_device(F.col("t")).alias("s"), devices.canonical_device(F.col("t")).alias("c"))
    got = {r.t: (r.s.device_type, r.s.number) if r.s else None for r in df.collect()}
    assert got == cases
    assert {r.t: r.c for r in df.collect()}["x0a"] == "XA"


def test_members_and_unread_words(spark):
    o = occ(spark, ("L12800", "L", 12800, 32, "read", "a", 1), ("D64061", "D", 64061, 4, "write", "MOV", 2))
    m = facts.expand_members(o)
    names = {r.member_device for r in m.collect()}
    assert {"L12821", "L12831", "D64064"} <= names and "L12832" not in names
    assert m.count() == 36
    found = {r.device for r in checks.unread(m, False).collect()}
    assert found == {"D64061", "D64062", "D64063", "D64064"}


def test_unknown_run_length_is_not_expanded(spark):
    assert facts.expand_members(occ(spark, ("D5", "D", 5, 0, "write", "MOV", 1))).count() == 1


def test_reach_through_a_block(spark):
    edges = spark.createDataFrame([("P", f"D{300 + i}", f"D{400 + i}") for i in range(4)] + [("P", "D401", "D900")], "project string, source string, target string")
    seeds = spark.createDataFrame([("s", "P", "D301")], "seed string, project string, device string")
    found, hidden = graph.reach(edges, seeds, 5)
    assert {(r.device, r.depth, r.parent) for r in found.collect()} == {("D301", 0, ""), ("D401", 1, "D301"), ("D900", 2, "D401")}
    assert not hidden
    assert graph.reach(edges, seeds, 1)[1]


def test_log_rules(spark):
    rows = [("P", "M1", "2024-01-01 00:00:00", 1, 1.0, "bit"), ("P", "M1", "2024-01-01 00:00:00", 2, 0.0, "bit"), ("P", "M1", "2024-01-01 00:00:10", 3, 0.0, "word"), ("P", "M1", "2024-01-01 00:00:20", 4, 0.0, "word")]
    log = spark.createDataFrame(rows, "project string, device string, t string, seq long, value_num double, value_type string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    last = logs.dedupe_log(log, ["project", "device", "ts"])
    assert {(r.seq, r.replaced) for r in last.collect()} == {(2, 1), (3, 0), (4, 0)}
    assert [r.seq for r in logs.change_points(last, ["device"], "ts", "value_num", "value_type").collect()] == [3]
    # as near to both: the earlier one
    assert logs.snapshot(log, "2024-01-01 00:00:15").first().ts.second == 10


def test_parse_values(spark):
    cases = {"on": (1.0, "bool"), "0x1F": (31.0, "int"), "1.5": (1.5, "float"), "text": (None, "string"), "-3": (-3.0, "int")}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", texts.parse_value(F.col("t")).alias("v"))
    assert {r.t: (r.v.value_num, r.v.value_type) for r in df.collect()} == cases


def test_fold_program():
    rows = [(0, "LD", "X0"), (1, "OR", "M0"), (2, "ANI", "X1"), (3, "OUT", "M0")]
    got = {(n, d, r) for _, _, n, d, r, _ in conditions.fold_program(rows)}
    assert {d for _, d, _ in got} == {"X0", "M0", "X1"} and len({n for n, *_ in got}) == 2
    assert conditions.fold_program([(0, "LD", "X0"), (1, "ANB", ""), (2, "OUT", "Y0")])[0][5] == "error"
    mps = [(0, "LD", "X0"), (1, "MPS", ""), (2, "AND", "X1"), (3, "OUT", "Y0"), (4, "MPP", ""), (5, "ANI", "X2"), (6, "OUT", "Y1")]
    out = conditions.fold_program(mps)
    assert {(o, d, r) for _, o, _, d, r, _ in out} == {("Y0", "X0", "a"), ("Y0", "X1", "a"), ("Y1", "X0", "a"), ("Y1", "X2", "b")}
    inv = conditions.fold_program([(0, "LD", "X0"), (1, "AND", "X1"), (2, "INV", ""), (3, "OUT", "Y0")])
    assert {(d, r) for *_, d, r, _ in inv} == {("X0", "b"), ("X1", "b")} and len({x[2] for x in inv}) == 2


def test_fold_rung():
    cells = [(0, 0, "a", "X0"), (1, 0, "b", "M5"), (0, 1, "a", "X1"), (0, 2, "out", "Y0")]
    joined = conditions.fold_rung(cells, {(0, 1)}, 2)
    assert {(n, d) for _, n, d, *_ in joined} == {(0, "M5"), (0, "X1"), (1, "X0"), (1, "X1")}
    assert {d for _, _, d, *_ in conditions.fold_rung(cells, set(), 2)} == {"X0", "X1"}


def test_layout_is_not_logic(spark):
    s = "project string, lddb string, guid string, data string, title string"
    old = spark.createDataFrame([("P", "L", "g1", "two\nlines:cb[fg=fg[dim=3x4:X", ""), ("P", "L", "g2", ":cb[fg=fg[dim=3x4:X", ""), ("Q", "L", "g2", "same", "")], s)
    new = spark.createDataFrame([("P", "L", "g1", "two\nlines:cb[fg=fg[dim=9x9:X", ""), ("P", "L", "g2", ":cb[fg=fg[dim=3x4:Y", ""), ("P", "L", "g3", "x", ""), ("Q", "L", "g2", "same", "")], s)
    assert {(r.guid, r.change) for r in diff.diff_rungs(old, new).collect()} == {("g1", "layout"), ("g2", "logic"), ("g3", "added")}


def test_checks_say_what_they_did_not_evaluate(spark):
    o = occ(spark, ("M1", "M", 1, 1, "write", "SET", 1))
    found, states = checks.run_checks({"occ": o})
    by = {r.check_name: r.state for r in states.collect()}
    assert by["set-without-rst"] == "checked" and by["unwritten-contact"] == "not_evaluated"
    assert [r.check_name for r in found.collect()] == ["set-without-rst"]


def test_memory_blocks(spark):
    b = spark.createDataFrame([(1, 1, 1, bytearray([5, 0])), (1, 2, 7, bytearray([255, 255]))], "db int, dev_code int, dev_no long, mem_data binary")
    got = {(r.dev_code, r.number, r.unsigned, r.signed) for r in readers.read_memory_blocks(b, [1]).collect()}
    assert got == {(1, 16, 1, 1), (1, 18, 1, 1), (2, 7, 65535, -1)}


def test_instruction_files(spark, tmp_path):
    text = "Project\tX\n\nStep No.\tLine Statement\tInstruction\tI/O (Device)\n0\t\tBMOV\tD1\n\t\t\tD2\n\t\t\tK4\n\tpart two\t\t\n3\t\tLD\tX0\n"
    (tmp_path / "a.csv").write_bytes(text.encode("utf-16"))
    (tmp_path / "b.csv").write_text("step,instruction,operand\n0,LD,M1\n", encoding="utf-8-sig")
    rows = readers.read_instruction_csv(spark, f"{tmp_path}/*.csv").collect()
    got = {(r.opcode, tuple(r.operands), r.title) for r in rows}
    assert got == {("BMOV", ("D1", "D2", "K4"), ""), ("LD", ("X0",), "part two"), ("LD", ("M1",), "")}


def test_operands_and_empty_inputs(spark):
    df = spark.createDataFrame([("K2M3410",), ("D0.A",), ("D100Z2",), (r"U70\G123",), ("K5",), ("my label",), (None,)], "t string")
    got = {r.t: [(x.kind, x.device, x.run) for x in r.o] for r in df.select("t", operands.parse_operand(F.col("t")).alias("o")).collect()}
    assert got["K2M3410"] == [("digits", "M3410", 8)] and got["D100Z2"] == [("indexed", "D100", 1), ("index", "Z2", 1)] and got[None] == []
    empty = occ(spark, ("M1", "M", 1, 1, "read", "a", 1)).limit(0)
    assert facts.device_stats(empty).count() == 0 and lookup.same_row(empty, empty.select("project", "device")).count() == 0


COND = "project string, lddb string, pos long, out_device string, branch int, device string, required string"


def test_constants_spread(spark):
    cond = spark.createDataFrame([("P", "L", 1, "M1", 0, "X0", "a"), ("P", "L", 2, "M2", 0, "M1", "b"), ("P", "L", 3, "M3", 0, "M2", "a"), ("P", "L", 3, "M3", 1, "X9", "a"), ("P", "L", 4, "M4", 0, "X9", "a")], COND)
    facts_ = spark.createDataFrame([("P", "X0", 0)], "project string, device string, value int")
    single = cond.select("project", F.col("out_device").alias("device")).distinct()
    got = {(r.device, r.value, r.round) for r in graph.propagate_constants(cond, facts_, single).collect()}
    assert got == {("X0", 0, 0), ("M1", 0, 1), ("M2", 1, 2), ("M3", 1, 3)}


def test_substitute(spark):
    cond = spark.createDataFrame([("P", "L", 1, "M1", 0, "X0", "a"), ("P", "L", 1, "M1", 1, "X1", "a"), ("P", "L", 2, "Y0", 0, "M1", "b"), ("P", "L", 2, "Y0", 0, "X2", "a"), ("P", "L", 3, "Y1", 0, "M1", "a")], COND)
    none = spark.createDataFrame([], "project string, device string")
    out = conditions.substitute(cond, none, ["project", "lddb", "pos", "out_device"], 1).collect()
    y0 = {(r.device, r.required) for r in out if r.out_device == "Y0"}
    assert y0 == {("X0", "b"), ("X1", "b"), ("X2", "a")}
    assert {(r.branch, r.device) for r in out if r.out_device == "Y1"} == {(0, "X0"), (1, "X1")}
    latched = spark.createDataFrame([("P", "M1")], "project string, device string")
    kept = conditions.substitute(cond, latched, ["project", "lddb", "pos", "out_device"], 1).collect()
    assert {r.device for r in kept if r.out_device == "Y1"} == {"M1"}


def test_change_impact(spark):
    changed = spark.createDataFrame([("c1", "L", "g1"), ("c2", "L", "g2")], "change_id string, lddb string, guid string")
    old = spark.createDataFrame([("P", "L", "g1", "M1")], "project string, lddb string, guid string, device string")
    new = spark.createDataFrame([("P", "L", "g1", "M2"), ("P", "L", "g2", "M9")], "project string, lddb string, guid string, device string")
    edges = spark.createDataFrame([("P", "M1", "Y1"), ("P", "M2", "Y1"), ("P", "Y1", "Y2")], "project string, source string, target string")
    got = {r.seed: (r.written, r.reached, r.deepest) for r in graph.change_impact(changed, old, new, edges, 3).collect()}
    assert got == {"c1": (2, 2, 2), "c2": (1, 0, 0)}


def test_fold_compares_and_blocks():
    rows = [(0, "LD", "X0"), (1, "AND=", "D1 K5"), (2, "OUT", "Y0"), (3, "LD>", "D2 D3"), (4, "OUT", "Y1")]
    assert [(o, d, r) for _, o, _, d, r, _ in conditions.fold_program(rows)] == [("Y0", "= D1 K5", "a"), ("Y0", "X0", "a"), ("Y1", "> D2 D3", "a")]
    # MPP brings the saved condition back and leaves the block below as it is
    mpp = [(0, "LD", "X0"), (1, "LD", "X1"), (2, "MPS", ""), (3, "AND", "X2"), (4, "MPP", ""), (5, "ANB", ""), (6, "OUT", "Y0")]
    assert {d for _, o, _, d, _, _ in conditions.fold_program(mpp)} == {"X0", "X1"}
    left_over = [(0, "LD", "X0"), (1, "LD", "X1"), (2, "OUT", "Y0")]
    assert [x[5] for x in conditions.fold_program(left_over)] == ["error"]
    assert [x[5] for x in conditions.fold_program([(0, "OUT", "Y0")])] == ["no_condition"]
    assert {x[5] for x in conditions.fold_program([(0, "CJ", "P1"), (1, "LD", "X0"), (2, "OUT", "Y0")])} == {"uncertain"}


def test_fold_by_all_assignments():
    rng = random.Random(3)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return ("lit", rng.choice("ABCDE"), rng.choice(["a", "b"]))
        return (rng.choice(["and", "or"]), tree(depth - 1), tree(depth - 1))

    def code(t):
        if t[0] == "lit":
            return [("LD" + ("I" if t[2] == "b" else ""), t[1])]
        if t[2][0] == "lit" and rng.random() < 0.7:
            return code(t[1]) + [(t[0].upper() + ("I" if t[2][2] == "b" else ""), t[2][1])]
        return code(t[1]) + code(t[2]) + [("ANB" if t[0] == "and" else "ORB", "")]

    def value(t, on):
        if t[0] == "lit":
            return on[t[1]] == (t[2] == "a")
        x, y = value(t[1], on), value(t[2], on)
        return x and y if t[0] == "and" else x or y

    for _ in range(150):
        shared, own, inverted = tree(3), tree(2), rng.random() < 0.3
        program = code(shared) + [("MPS", "")] + code(own) + [("ANB", ""), ("OUT", "Y0"), ("MPP", "")] + ([("INV", "")] if inverted else []) + [("OUT", "Y1")]
        out = conditions.fold_program([(i, *x) for i, x in enumerate(program)])
        for bits in itertools.product([False, True], repeat=5):
            on = dict(zip("ABCDE", bits, strict=True))
            for name, want in (("Y0", value(shared, on) and value(own, on)), ("Y1", value(shared, on) != inverted)):
                branches = {}
                for _, o, n, d, r, kind in out:
                    if o == name:
                        branches.setdefault(n, []).append(kind == "true" or on[d] == (r == "a"))
                assert any(all(b) for b in branches.values()) == want


OPERANDS = "project string, lddb string, pos long, op_index int, opcode string, argc int, arg_index int, device string, device_type string, number long, value long, comment string"


def test_compare_and_division_rules(spark):
    rows = [
        ("P", "L", 1, 0, "LD<", 2, 0, "W1A", "W", 26, None, ""), ("P", "L", 1, 0, "LD<", 2, 1, None, None, None, 70000, ""),
        ("P", "L", 2, 0, "LDD<", 2, 0, "D1", "D", 1, None, "link speed"), ("P", "L", 2, 0, "LDD<", 2, 1, None, None, None, 70000, ""),
        ("P", "L", 3, 0, "/", 3, 0, "D1", "D", 1, None, ""), ("P", "L", 3, 0, "/", 3, 1, None, None, None, 0, ""), ("P", "L", 3, 0, "/", 3, 2, "D9", "D", 9, None, ""),
        ("P", "L", 4, 0, "/", 3, 0, None, None, None, 0, ""), ("P", "L", 4, 0, "/", 3, 1, "D2", "D", 2, None, ""), ("Q", "L", 4, 0, "/", 3, 1, "D2", "D", 2, None, ""),
        ("P", "L", 5, 0, "/", 3, 1, "D3", "D", 3, None, ""), ("P", "L", 6, 0, "/", 3, 1, "D4", "D", 4, None, ""), ("P", "L", 7, 0, "MOV", 2, 0, None, None, None, 0, ""),
    ]
    operands_ = spark.createDataFrame(rows, OPERANDS)
    opcodes = spark.createDataFrame([("LD<", "compare", 1), ("LDD<", "compare", 2), ("/", "division", 1), ("MOV", "transfer", 1)], "opcode string, family string, words int")
    found = checks.compare_type(operands_, opcodes, ["UG", "W"], "(?i)buffer|link")
    assert {(r.project, r.severity, r.device) for r in found.collect()} == {("P", "info", "W1A"), ("P", "info", "D1"), ("P", "medium", "K70000")}
    members = facts.expand_members(occ(spark, ("D2", "D", 2, 1, "write", "MOV", 1)))
    areas = spark.createDataFrame([("P", "D", 4, 4, 1, "a", "u"), ("Q", "D", 3, 3, 2, "a", "u")], "project string, device_type string, start_value long, end_value long, area_no int, kind string, unit_name string")
    found = checks.div_by_zero(operands_, opcodes, members, areas, ["D", "W"])
    # D2 is written in P only, D4 lies in an area of P, D3 in one of Q
    assert {(r.project, r.severity, r.device) for r in found.collect()} == {("P", "high", "K0"), ("Q", "info", "D2"), ("P", "info", "D3")}


def test_writers_of_words_by_name(spark):
    o = occ(spark, ("W1A", "W", 26, 2, "write", "MOV", 1), ("W1A", "W", 26, 2, "write", "MOV", 2), ("W1C", "W", 28, 1, "write", "MOV", 2))
    assert [(r.device, r.n, r.detail) for r in checks.multi_writer(facts.expand_members(o)).collect()] == [("W1A", 2, "2 devices")]


def test_temporal_predicates(spark):
    o = occ(spark, ("M1", "M", 1, 1, "write", "SET", 1), ("T5", "T", 5, 1, "write", "c", 2), ("M9", "M", 9, 1, "write", "PLS", 3), ("Y1", "Y", 1, 1, "write", "c", 4))
    cond = spark.createDataFrame([("P", "L0", 4, "T5", "T", "a"), ("P", "L0", 4, "X1", "X", "p"), ("P", "L0", 4, "C2", "C", "b"), ("P", "L0", 4, "X2", "X", "a")], "project string, lddb string, pos long, device string, device_type string, required string")
    got = {(r.pos, r.kind, r.device) for r in logs.temporal_predicates(o, cond, ["T", "ST"], ["C"]).collect()}
    assert got == {(1, "latch set", "M1"), (2, "timer done", "T5"), (3, "rising edge", "M9"), (4, "timer contact", "T5"), (4, "edge contact", "X1"), (4, "counter contact", "C2")}


def test_zones_guard_rungs(spark):
    m = "project string, lddb string, pos long, opcode string, nesting int"
    marks = spark.createDataFrame([("P", "L", 10, "MC", 0), ("P", "L", 20, "MC", 1), ("P", "L", 30, "MCR", 1), ("P", "L", 40, "MCR", 0), ("Q", "L", 15, "MC", 0)], m)
    zones = conditions.mc_zones(marks)
    assert {(r.project, r.start_pos, r.end_pos) for r in zones.collect()} == {("P", 10, 40), ("P", 20, 30), ("Q", 15, None)}
    rungs = spark.createDataFrame([(p, "L", n) for p in "PQ" for n in (5, 10, 15, 25, 30, 35, 50)], "project string, lddb string, pos long")
    placed = conditions.apply_zones(rungs, zones)
    assert {(r.project, r.pos, r.zones, r.inner_start) for r in placed.collect()} == {("P", 15, 1, 10), ("P", 25, 2, 20), ("P", 30, 1, 10), ("P", 35, 1, 10), ("Q", 25, 1, 15), ("Q", 30, 1, 15), ("Q", 35, 1, 15), ("Q", 50, 1, 15)}
    cond = spark.createDataFrame([("P", "L", 15, "Y0", 0, "X0", "a"), ("P", "L", 15, "Y0", 1, "X1", "a"), ("P", "L", 50, "Y1", 0, "X2", "a")], COND)
    zone_cond = spark.createDataFrame([("P", "L", 10, 0, "M5", "a"), ("P", "L", 10, 1, "M6", "b")], "project string, lddb string, start_pos long, zone_branch int, device string, required string")
    got = {}
    for r in conditions.zone_conditions(cond, placed, zone_cond).collect():
        got.setdefault((r.out_device, r.branch, r.zone_branch), set()).add((r.device, r.required))
    assert got == {("Y0", b, z): {(f"X{b}", "a"), [("M5", "a"), ("M6", "b")][z]} for b in (0, 1) for z in (0, 1)} | {("Y1", 0, 0): {("X2", "a")}}


def test_projects_with_the_same_devices_stay_apart(spark):
    o = occ(spark, ("D1", "D", 1, 2, "write", "MOV", 1)).union(occ(spark, ("D1", "D", 1, 2, "read", "MOV", 1)).withColumn("project", F.lit("Q")))
    comments = spark.createDataFrame([("P", "D2", "D", 2, "pump"), ("Q", "D2", "D", 2, "valve")], "project string, device string, device_type string, number long, all_text string")
    m = facts.expand_members(o, comments)
    assert {(r.project, r.member_device, r.member_comment) for r in m.collect()} == {("P", "D1", "c"), ("P", "D2", "pump"), ("Q", "D1", "c"), ("Q", "D2", "valve")}
    areas = spark.createDataFrame([("P", "D", 1, 5, 1, "a", "u")], "project string, device_type string, start_value long, end_value long, area_no int, kind string, unit_name string")
    placed = lookup.area_of(o.select("project", "device", "device_type", "number"), areas)
    assert {(r.project, r.area_no) for r in placed.collect()} == {("P", 1), ("Q", None)}
    log = spark.createDataFrame([("P", "D9", 1.0), ("Q", "D9", 0.0)], "project string, device string, value_num double")
    cond = spark.createDataFrame([(p, "L", 1, "Y0", 0, "D9", "a") for p in "PQ"], COND)
    assert {(r.project, r.state) for r in logs.evaluate(cond, log).collect()} == {("P", "pass"), ("Q", "block")}


def test_first_values_of_a_key(spark):
    df = spark.createDataFrame([("k", i % 7) for i in range(50)] + [("z", None)], "key string, v int")
    assert [tuple(r) for r in lookup.first_values(df, ["key"], "v", 3, "few").collect()] == [("k", "0,1,2")]


def test_labels_keep_their_devices(spark):
    cols = spark.createDataFrame([(1, 1, 1, "start"), (2, 1, 1, "start"), (2, 2, 1, "stop")], "scope int, row_id int, column_no int, text string")
    assigns = spark.createDataFrame([(1, 1, "M20"), (1, 1, "M3"), (2, 2, "X0")], "scope int, row_id int, device string")
    got = {(r.label, r.devices) for r in readers.assemble_labels(cols, assigns).collect()}
    assert got == {("start@1", "M20,M3"), ("start@2", ""), ("stop", "X0")}


def test_role_links_both_ways(spark):
    d = "project string, device string, device_type string, comment string, has_read boolean, has_write boolean"
    devices_ = spark.createDataFrame([("P", "M2", "M", "ready", True, True), ("P", "M1", "M", "ready", True, True), ("Q", "M7", "M", "Ready", True, False), ("Q", "M8", "M", "ready", True, False), ("Q", "M9", "M", "go", True, True), ("P", "M5", "M", "go", True, False)], d)
    near = spark.createDataFrame([("P", "Q"), ("Q", "P")], "project_a string, project_b string")
    from rungfleet.operators import links

    got = {(r.device_a, r.device_b, r.role) for r in links.role_links(devices_, near, F.lower("comment")).collect()}
    assert got == {("M1", "M7", "ready"), ("M1", "M8", "ready"), ("M9", "M5", "go")}


def test_walks_go_on_from_all_members(spark):
    o = occ(spark, ("X0", "X", 0, 1, "read", "a", 1), ("D10", "D", 10, 3, "write", "MOV", 1), ("D12", "D", 12, 1, "read", "MOV", 2), ("D50", "D", 50, 1, "write", "MOV", 2))
    edges = {(r.source, r.target) for r in graph.device_edges(facts.expand_members(o)).collect()}
    assert {("X0", "D10"), ("X0", "D12"), ("D12", "D50")} <= edges
