"""Rules of checks, links, logs and streams on rows worked out by hand, or by brute force."""

from __future__ import annotations

import itertools
import os
import random

from pyspark.sql import functions as F

from rungfleet.operators import checks, conditions, diff, facts, inventory, links, logs, lookup
from rungfleet.streaming import log_streams

from .test_small import COND, OCC, occ


def test_mixed_captures(spark):
    rows = [("a", "S", "F"), ("a", "S", None), ("b", "S", "F"), ("b", " S ", "F"), ("c", "S", "F"), ("c", "T", "F"), ("d", None, None), ("d", "", "")]
    log = spark.createDataFrame(rows, "capture string, source string, fingerprint string")
    got = {r.capture: (r.identities, r.sources, r.fingerprints, r.records) for r in logs.check_capture(log, ["capture"]).collect()}
    # a missing fingerprint is not taken to be the named one
    assert got == {"a": (2, 1, 2, 2), "c": (2, 2, 1, 2)}


def test_weakest_state(spark):
    order = ["checked", "no_measurement", "truncated", "partial", "unsupported", "not_evaluated", "new kind of state"]
    rows = [(f"{i}{j}", s, "why " + s) for (i, a), (j, b) in itertools.combinations(enumerate(order), 2) for s in (a, b)]
    got = {r.k: (r.state, r.constraints) for r in inventory.worst_state(spark.createDataFrame(rows, "k string, state string, reason string"), ["k"]).collect()}
    assert {k: s for k, (s, _) in got.items()} == {f"{i}{j}": order[j] for i, j in itertools.combinations(range(7), 2)}
    assert got["12"][1] == "why no_measurement; why truncated"


def test_buffer_labels(spark):
    labels = spark.createDataFrame([("P", 1, 100, "Axis[0].Start"), ("P", 1, 101, "Stop"), ("P", 1, 200, "Axis[3].Pos"), ("P", 2, 110, "other unit"), ("Q", 1, 105, "other project")], "project string, unit int, label_at long, symbol string")
    asked = [99, 100, 101, 102, 103, 117, 118, 200, 201, 216, 217]
    offsets = spark.createDataFrame([("P", 1, o) for o in asked], "project string, unit int, offset long")
    got = {r.offset: (r.symbol, r.axis) for r in lookup.buffer_labels(offsets, labels).collect()}
    assert got == {99: (None, None), 100: ("Axis[0].Start", 1), 101: ("Stop", None), 102: ("Stop", None), 103: ("Stop +2", None), 117: ("Stop +16", None), 118: (None, None), 200: ("Axis[3].Pos", 4), 201: ("Axis[3].Pos", 4), 216: ("Axis[3].Pos +16", 4), 217: (None, None)}


def operands(spark, rows):
    """Rows of (pos, op_index, arg_index, opcode, device, type, access, role, const_args, detail, title, comment)."""
    full = [("P", f"o{i}", "L0", r[0], r[1], r[2], r[4], r[5], 0, 1, r[6], r[7], r[3], r[8], "L0", i, r[10], r[11], "exact") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, OCC).join(spark.createDataFrame([(f"o{i}", r[9]) for i, r in enumerate(rows)], "occ_id string, detail string"), "occ_id")


def test_module_transfers(spark):
    rows = [
        (1, 0, 0, "FROM", "D32717", "D", "read", "FROM", "K2,K4", "", "", ""), (1, 0, 1, "FROM", "Z2", "Z", "read", "FROM", "K2,K4", "base=K2400+Z2", "", ""), (1, 0, 2, "FROM", "D9900", "D", "write", "FROM", "K2,K4", "", "", ""),
        (2, 0, 0, "TO", "Z1", "Z", "read", "TO", "K7", "", "", ""), (2, 0, 2, "TO", "D5", "D", "read", "TO", "K7", "", "", ""), (3, 0, 0, "MOV", "D1", "D", "read", "MOV", "", "", "", ""),
    ]
    labels = spark.createDataFrame([("P", 3, 2400, "Pos"), ("P", 1, 2400, "Speed")], "project string, unit int, label_at long, symbol string")
    got = {r.pos: (r.opcode, r.unit, r.base, r.index_register, r.data_device, r.symbol) for r in lookup.module_transfers(operands(spark, rows), labels).collect()}
    assert got == {1: ("FROM", "D32717", 2400, 2, "D9900", "Speed"), 2: ("TO", "K7", None, None, "D5", "")}


def test_timers_only(spark):
    rows = [(1, 0, 0, "OUT__16", "T5", "T", "write", "OUT__16", "K5", "", "", ""), (2, 0, 0, "MOV", "D5", "D", "write", "MOV", "K5", "", "", ""), (3, 0, 0, "OUTH__16", "T6", "T", "write", "OUTH__16", "K5", "", "", ""), (4, 0, 0, "OUT__16", "T7", "T", "write", "OUT__16", "D9", "", "", "")]
    from rungfleet.functions.texts import timer_seconds

    families = spark.createDataFrame([("OUT__16", "timer"), ("OUTH__16", "timer"), ("MOV", "transfer")], "opcode string, family string")
    out = inventory.timer_settings(operands(spark, rows), families, ["T", "C"], timer_seconds(F.col("opcode"), F.col("const_args")))
    assert {(r.device, r.preset_s) for r in out.collect()} == {("T5", 0.5), ("T6", 0.05), ("T7", None)}


def test_duplicate_coils(spark):
    def rows(device, kind, *uses):
        return [(pos, op, 0, "OUT", device, kind, "write", role, "", detail, title, "") for pos, op, role, detail, title in uses]

    every = (
        rows("Y1", "Y", (1, 0, "c", "", ""), (2, 0, "c", "", "")) + rows("M1", "M", (1, 0, "c", "", ""), (2, 0, "SET", "", "")) + rows("L1", "L", (1, 0, "c", "", ""), (1, 1, "c", "", ""))
        + rows("B1", "B", (1, 0, "c", "", ""), (2, 0, "c", "", "")) + rows("Y2", "Y", (3, 0, "c", "", "debug part"), (4, 0, "c", "", "")) + rows("M2", "M", (3, 0, "c", "indexed", ""), (4, 0, "c", "indexed", ""))
        + rows("M3", "M", (5, 0, "c", "", ""), (6, 0, "c", "", "")) + rows("D1.A", "D", (5, 0, "c", "bit=K10", ""), (6, 0, "c", "bit=K10", "")) + rows("M4", "M", (7, 0, "SET", "", ""), (8, 0, "RST", "", "")) + rows("M5", "M", (7, 0, "c", "", ""))
        + rows("T1", "T", (7, 0, "OUT__16", "", ""), (8, 0, "OUT__16", "", "")) + rows("M6", "M", (9, 0, "c", "", ""), (10, 0, "c", "", ""))
    )
    cond = spark.createDataFrame([("P", "L0", p, "M3", b, d, "a") for p in (5, 6) for b, d in ((p, "X1"), (p + 1, "X2"))] + [("P", "L0", 9, "M6", 0, "X1", "a"), ("P", "L0", 10, "M6", 0, "X1", "b")], COND)
    got = {r.device: (r.severity, r.n, r.detail) for r in checks.duplicate_coil(operands(spark, every), cond, "debug").collect()}
    assert got == {
        "Y1": ("high", 2, "roles: c=2"), "M1": ("medium", 2, "roles: SET=1; c=1"), "L1": ("high", 2, "roles: c=2"), "B1": ("medium", 2, "roles: c=2"), "Y2": ("medium", 2, "roles: c=2"), "M2": ("medium", 2, "roles: c=2"),
        "M3": ("medium", 2, "roles: c=2"), "D1.A": ("high", 2, "roles: c=2"), "M4": ("medium", 2, "roles: RST=1; SET=1"), "T1": ("medium", 2, "roles: OUT__16=2"), "M6": ("high", 2, "roles: c=2"),
    }


LINKS = "project_a string, device_a string, project_b string, device_b string, link_type string, direction string, role string, confidence string, evidence string"


def test_ranked_links(spark):
    role = lambda a, b, r, c="high", e="", t="role", d="A_to_B": ("P", a, "Q", b, t, d, r, c, e)
    rows = [role(f"M{100 + i}", f"M{200 + i}", f"r{i}") for i in range(3)]  # three at -100
    rows += [role("M7", "M201", "r1"), role("M102", "M202", "r2", e="longer evidence"), role("M150", "M200", "r0", "low"), role("M9", "M300", "s", e="to Q"), role("M8", "M300", "s")]
    rows += [role("W1", "W1", "x", t="exact"), role("M5", "M6", "both", d="both"), role("M5", "M7", "both", d="both"), role("M400", "M90", "back", d="B_to_A")]
    df = spark.createDataFrame(rows, LINKS)
    assert {(r.direction, r.offset, r.votes) for r in links.dominant_offsets(df).collect()} == {("A_to_B", -100, 4)}
    out = links.dedupe_links(df).collect()
    got = {(r.device_a, r.device_b, r.in_band) for r in out}
    assert got == {("M100", "M200", True), ("M101", "M201", True), ("M102", "M202", True), ("M9", "M300", False), ("W1", "W1", False), ("M5", "M6", False), ("M5", "M7", False), ("M400", "M90", False)}
    assert [r.evidence for r in out if r.device_b == "M202"] == ["longer evidence"]


def test_upstream_evidence(spark):
    rules = {"actuator": "valve", "not_actuator": "lamp", "safety": "guard", "position": "home", "mode": "auto", "timer": "timeout", "permissive": "permit"}
    rung = lambda pos, out, kind, *contacts, comment="": [(pos, 0, 9, "OUT", out, kind, "write", "c", "", "", "", comment)] + [(pos, 0, i, "LD", d, t, "read", r, "", "", "", c) for i, (d, t, r, c) in enumerate(contacts)]
    rows = (
        rung(1, "Y1", "Y", ("M1", "M", "a", ""), comment="valve one") + rung(2, "M1", "M", ("M2", "M", "a", "")) + rung(3, "M2", "M", ("M3", "M", "b", "permit")) + rung(4, "M3", "M", ("X1", "X", "a", "home"))
        + rung(5, "Y2", "Y", ("M9", "M", "a", ""), comment="valve two") + rung(6, "Y3", "Y", ("M8", "M", "a", "auto"), comment="valve three") + rung(7, "Y4", "Y", ("M8", "M", "a", ""), comment="valve lamp")
        + rung(8, "Y5", "Y", ("X5", "X", "b", ""), ("X6", "X", "a", ""), comment="valve five") + rung(9, "M10", "M", ("M11", "M", "a", "")) + rung(10, "M11", "M", ("M12", "M", "a", "")) + rung(11, "M12", "M", ("M13", "M", "a", ""))
        + rung(12, "M13", "M", ("X9", "X", "a", "guard")) + rung(13, "Y6", "Y", ("M10", "M", "a", ""), comment="valve six") + rung(14, "Y7", "Y", comment="valve seven")
    )
    got = {r.device: (r.severity, r.n, r.detail) for r in checks.interlock_candidates(operands(spark, rows), rules).collect()}
    assert got == {
        "Y1": ("low", 1, "L0:1 own  upstream input,position,off-contact"),  # the third level back still counts
        "Y2": ("high", 1, "L0:5 own  upstream "), "Y3": ("medium", 1, "L0:6 own mode upstream mode"),
        "Y6": ("high", 1, "L0:13 own  upstream "),  # the guard is four levels back
        "Y7": ("high", 0, "L0:14 own  upstream "),
    }


def test_pairs_with_witness(spark):
    rng = random.Random(4)
    names = [f"X{i}" for i in range(4)]
    conds = {k: [{(rng.choice(names), rng.choice("ab")) for _ in range(rng.randint(1, 3))} for _ in range(rng.randint(1, 3))] for k in range(30)}
    conds = {k: c for k, v in conds.items() if (c := [b for b in v if not any((d, "b") in b for d, r in b if r == "a")])}
    cond = spark.createDataFrame([("P", "L", k, f"Y{k}", i, d, r) for k, c in conds.items() for i, b in enumerate(c) for d, r in b], COND)
    pairs = spark.createDataFrame([("P", "L", i, f"Y{i}", j, f"Y{j}") for i, j in itertools.combinations(conds, 2)], "project string, lddb string, pos_a long, out_a string, pos_b long, out_b string")
    out = conditions.interlock_pairs(cond, pairs, ["project", "lddb", "pos", "out_device"], most=6).collect()
    assert len(out) == pairs.count()
    on = lambda c, x: any(all(x[d] == (r == "a") for d, r in b) for b in c)
    held = []
    for r in out:
        a, b = conds[r.pos_a], conds[r.pos_b]
        if len({frozenset(x) for x in a}) * len({frozenset(x) for x in b}) > 6:
            assert r.exclusive is None and r.witness == ""
            continue
        both = any(on(a, x) and on(b, x) for x in (dict(zip(names, bits)) for bits in itertools.product((False, True), repeat=4)))
        assert r.exclusive == (not both)
        if both:
            held.append((r, dict(w.split("=") for w in r.witness.split(","))))
    # each witness holds when the conditions are judged under it
    r, w = max(held, key=lambda x: len(x[1]))
    snap = spark.createDataFrame([("P", d, 1.0 if s == "a" else 0.0) for d, s in w.items()], "project string, device string, value_num double")
    states = {x.out_device: x.state for x in logs.evaluate(cond, snap).collect()}
    assert states[r.out_a] == states[r.out_b] == "pass" and len(held) > 20


def test_explained_outputs(spark):
    rows = [("P", "L", 1, "Y1", 0, "X1", "a"), ("P", "L", 2, "Y2", 0, "X1", "b"), ("P", "L", 3, "Y3", 0, "X9", "a"), ("P", "L", 4, "Y4", 0, "X1", "p"), ("P", "L", 5, "Y5", 0, "X1", "a"), ("P", "L", 6, "Y6", 0, "X1", "a"), ("P", "L", 7, "Y7", 0, "X1", "a"), ("P", "L", 8, "Y8", 0, "X1", "a"), ("P", "L", 8, "Y8", 1, "X9", "a")]
    snap = spark.createDataFrame([("P", "X1", 1.0)], "project string, device string, value_num double")
    flags = spark.createDataFrame([("P", "L", 5, True, False, False), ("P", "L", 6, False, True, False), ("P", "L", 7, False, False, True)], "project string, lddb string, pos long, guarded boolean, partial boolean, too_large boolean")
    held = spark.createDataFrame([("P", "L", 1, "latch set", "Y1")], "project string, lddb string, pos long, kind string, device string")
    got = {r.out_device: (r.state, r.analysis, r.constraints) for r in logs.explain_outputs(spark.createDataFrame(rows, COND), snap, flags, held).collect()}
    assert got == {
        "Y1": ("pass", "partial", "latch set"), "Y2": ("block", "checked", ""), "Y3": ("missing", "no_measurement", "no value"), "Y4": ("unknown", "unsupported", "edge contact"), "Y5": ("unknown", "partial", "may not run"),
        "Y6": ("unknown", "partial", "not wholly read"), "Y7": ("unknown", "truncated", "condition too large"), "Y8": ("pass", "no_measurement", "no value"),
    }


def test_runs_of_block_moves(spark):
    program = [("BMOV", ["D300", "D400", "K4"]), ("MOV", ["D401", "D900"]), ("FMOV", ["D1", "D500", "K3"]), ("BMOV", ["K4M0", "D600", "K2"]), ("WTOB", ["D10", "D20", "K5"]), ("DFMOV", ["D30", "D40", "K3"]), ("BMOV", ["D50", "D60", "D61"]), ("BMOV", ["D70Z1", "D80", "K2"]), ("DMOV", ["D90", "D92"]), ("ROL", ["D95", "K4"]), ("BMOV", ["D96", "D97", "K0"])]
    ins = spark.createDataFrame([("P", "L", i, "", op, args) for i, (op, args) in enumerate(program)], "project string, program string, step int, title string, opcode string, operands array<string>")
    table = [("BMOV", 0, "read", 2, 1, 1, True, 1), ("BMOV", 1, "write", 2, 1, 1, True, 1), ("FMOV", 0, "read", None, 1, 1, False, 1), ("FMOV", 1, "write", 2, 1, 1, True, 1), ("WTOB", 0, "read", 2, 1, 2, False, 1), ("WTOB", 1, "write", 2, 1, 1, False, 1), ("DFMOV", 0, "read", None, 1, 1, False, 2), ("DFMOV", 1, "write", 2, 2, 1, False, 1), ("MOV", 0, "read", None, 1, 1, False, 1), ("MOV", 1, "write", None, 1, 1, False, 1), ("DMOV", 0, "read", None, 1, 1, False, 2), ("DMOV", 1, "write", None, 1, 1, False, 2), ("ROL", 0, "both", None, 1, 1, False, 1)]
    args = spark.createDataFrame(table, "opcode string, arg_index int, access string, count_arg int, span_num int, span_den int, by_digits boolean, words int")
    families = spark.createDataFrame([("X", "other")], "opcode string, family string")
    comments = spark.createDataFrame([("P", "D300", "a")], "project string, device string, all_text string")
    got = {(r.step, r.device): (r.access, r.range_len) for r in facts.build_occurrences(ins, args, families, comments).collect()}
    want = {
        (0, "D300"): ("read", 4), (0, "D400"): ("write", 4), (1, "D401"): ("read", 1), (1, "D900"): ("write", 1), (2, "D1"): ("read", 1), (2, "D500"): ("write", 3), (3, "M0"): ("read", 32), (3, "D600"): ("write", 2),
        (4, "D10"): ("read", 3), (4, "D20"): ("write", 5), (5, "D30"): ("read", 2), (5, "D40"): ("write", 6), (6, "D50"): ("read", 0), (6, "D60"): ("write", 0), (6, "D61"): ("ref", 1), (7, "D70"): ("read", 1), (7, "Z1"): ("read", 1), (7, "D80"): ("write", 2),
        (8, "D90"): ("read", 2), (8, "D92"): ("write", 2), (9, "D95"): ("both", 1), (10, "D96"): ("read", 0), (10, "D97"): ("write", 0),
    }
    assert got == want


def files_below(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_snapshot_of_a_stream(spark, tmp_path):
    """Each micro-batch writes what changed, judges what holds it, and ends where a batch
    job over all records ends."""
    rng = random.Random(2)
    rows = [(f"P{rng.randrange(2)}", f"X{rng.randrange(6)}", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, float(rng.randrange(2)), "bit") for i in range(120)]
    rows += [("P0", "X0", "2023-12-31 00:00:00", 500, 1.0, "bit")]  # late: older than what is known
    log = spark.createDataFrame(rows, "project string, device string, t string, seq long, value_num double, value_type string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    cond = spark.createDataFrame([(p, "L", k, f"Y{k}", b, f"X{(k * (b + 1)) % 7}", "ab"[(k + b) % 2]) for p in ("P0", "P1") for k in range(8) for b in range(2)], COND)
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [rows for rows in (log.where("seq < 40"), log.where("seq >= 40 and seq < 80"), log.where("seq >= 80"), log.where("seq = 79"))]
    judged, before = [], {}
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        log_streams.stream_snapshot(stream, cond, folder, f"{tmp_path}/state", "3650 days").awaitTermination()
        now = files_below(folder)
        assert all(now[f] == t for f, t in before.items())  # nothing is written again
        before = now
        path = f"{folder}/verdicts/batch={i}"
        judged.append(spark.read.parquet(path).count() if os.path.isdir(path) else 0)
        seen = log.where("seq < 40") if i == 0 else log.where("seq < 80") if i == 1 else log
        want = {(r.project, r.device): (r.seq, r.value_num) for r in log_streams.latest(seen).collect()}
        got = {(r.project, r.device): r.value_num for r in log_streams.read_snapshot(spark, folder).collect()}
        assert got == {k: v for k, (_, v) in want.items()}
        snap = spark.createDataFrame([(*k, v) for k, (_, v) in want.items()], "project string, device string, value_num double")
        state = lambda df: {(r.project, r.out_device): r.state for r in df.collect()}
        assert state(log_streams.read_verdicts(spark, folder)) == state(logs.evaluate(cond, snap))
    assert judged[0] == cond.select("project", "pos").distinct().count() and judged[3] == 0  # the last record changed nothing


def test_silent_devices_lose_their_value(spark, tmp_path):
    rows = [("P", "X1", "2024-01-01 00:00:00", 1, 1.0, "bit"), ("P", "X2", "2024-01-01 00:00:00", 2, 1.0, "bit"), ("P", "X2", "2024-01-01 02:00:00", 3, 1.0, "bit"), ("P", "X2", "2024-01-01 02:10:00", 4, 0.0, "bit"), ("P", "X1", "2024-01-01 03:00:00", 5, 1.0, "bit")]
    log = spark.createDataFrame(rows, "project string, device string, t string, seq long, value_num double, value_type string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    cond = spark.createDataFrame([("P", "L", 1, "Y1", 0, "X1", "a"), ("P", "L", 2, "Y2", 0, "X2", "a")], COND)
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    seen = []
    for lo, hi in ((1, 2), (3, 3), (4, 4), (5, 5)):
        log.where(f"seq between {lo} and {hi}").coalesce(1).write.mode("append").parquet(source)
        log_streams.stream_snapshot(spark.readStream.schema(log.schema).parquet(source), cond, folder, f"{tmp_path}/state", "1 minute", idle="1 hour").awaitTermination()
        seen.append({r.out_device: r.state for r in log_streams.read_verdicts(spark, folder).collect()})
    assert seen[0] == {"Y1": "pass", "Y2": "pass"}
    # the watermark has passed an hour after the last record of X1
    assert {"Y1": "missing", "Y2": "block"} in seen[1:3] and seen[3] == {"Y1": "pass", "Y2": "block"}


def test_health_of_what_was_looked_at(spark):
    finding = lambda p, c, s, d="D1", n=1, comment="x": (p, c, s, d, n, "", comment)
    rows = [finding("P", "coil", "high"), finding("P", "coil", "CRITICAL", "Y1"), finding("P", "io", "info", "D9", 50, "")] + [finding("Q", "coil", "critical", f"M{i}") for i in range(9)] + [finding("P", "seen", "high", "D5")]
    found = spark.createDataFrame(rows, "project string, check_name string, severity string, device string, n int, detail string, comment string")
    dims = spark.createDataFrame([("coil", "logic"), ("coil", "change"), ("io", "documents"), ("link", "logic"), ("seen", None)], "check_name string, dimension string")
    state = {("P", "coil"): "checked", ("P", "io"): "checked", ("P", "link"): "not_evaluated", ("P", "seen"): "checked", ("Q", "coil"): "checked", ("Q", "io"): "partial", ("Q", "link"): "checked", ("R", "coil"): "checked", ("R", "io"): "checked", ("R", "link"): "checked", ("S", "coil"): "not_evaluated", ("S", "io"): "not_evaluated"}
    states = spark.createDataFrame([(*k, v) for k, v in state.items()], "project string, check_name string, state string")
    scores = inventory.health(found, dims, states, ("link",))
    got = {(r.project, r.dimension): (r.score, r.findings) for r in scores.collect()}
    assert got == {
        ("P", "logic"): (80, 2), ("P", "change"): (80, 2), ("P", "documents"): (99, 1), ("Q", "logic"): (65, 9), ("Q", "change"): (65, 9), ("Q", "documents"): (None, 0),
        ("R", "logic"): (100, 0), ("R", "change"): (100, 0), ("R", "documents"): (100, 0), ("S", "logic"): (None, 0), ("S", "change"): (None, 0), ("S", "documents"): (None, 0),
    }
    labels = {r.project: (r.health, r.provisional) for r in inventory.health_labels(scores, states, ("link",)).collect()}
    assert labels == {"P": ("FAIR", None), "Q": ("INCOMPLETE", "POOR"), "R": ("GOOD", None), "S": ("INCOMPLETE", "NOT ASSESSED")}
    top = [(r.device, r.priority) for r in inventory.top_risks(found.where("project = 'P'"), {"coil": 22}, 3).orderBy("rank").collect()]
    assert top == [("Y1", 120 + 22 + 18 + 1), ("D1", 90 + 22 + 1), ("D5", 90 + 1)]


def test_width_of_writes(spark):
    o = occ(spark, ("D1", "D", 1, 2, "write", "DMOV", 1), ("D2", "D", 2, 1, "read", "MOV", 1), ("D10", "D", 10, 2, "write", "DMOV", 2), ("D11", "D", 11, 1, "read", "MOV", 3), ("D20", "D", 20, 2, "write", "DMOV", 4), ("D21", "D", 21, 1, "read", "MOV", 4), ("D20", "D", 20, 2, "write", "DMOV", 5), ("D30", "D", 30, 2, "write", "DMOV", 6))
    # the only rung that names D2 is the one that writes it; D21 is also written by another
    assert {(r.device, r.n) for r in checks.width_mismatch(facts.expand_members(o)).collect()} == {("D11", 1), ("D21", 1)}


def test_impact_says_what_it_did_not_follow(spark):
    from rungfleet.operators import graph

    changed = spark.createDataFrame([("c1", "P", "L", "g1"), ("c2", "P", "L", "g2"), ("c3", "P", "L", "g3")], "change_id string, project string, lddb string, guid string")
    w = spark.createDataFrame([("P", "L", "g1", "M1"), ("P", "L", "g2", "M9"), ("P", "L", "g3", "A")], "project string, lddb string, guid string, device string")
    edges = spark.createDataFrame([("P", "M1", "M2"), ("P", "M2", "M3"), ("P", "A", "B"), ("P", "B", "A")], "project string, source string, target string")
    got = {r.seed: (r.reached, r.state) for r in graph.change_impact(changed, w, w, edges, 1).collect()}
    assert got == {"c1": (1, "truncated"), "c2": (0, "checked"), "c3": (1, "checked")}


def test_positions_and_totals_of_memory(spark):
    from rungfleet.sources import readers

    pairs = readers.dword_pairs(spark.createDataFrame([("P", 1, 10, 1), ("P", 1, 11, 1), ("Q", 1, 12, 5), ("P", 1, 14, 65535), ("P", 1, 15, 65535)], "project string, db int, number long, unsigned int"))
    axes = spark.createDataFrame([("P", 1, 1, 10, 4), ("Q", 1, 1, 10, 4)], "project string, db int, axis int, base long, stride int")
    got = {(r.project, r.position): (r.number, r.value) for r in readers.position_table(pairs, axes, 2).collect()}
    assert got == {("P", 0): (10, 65537), ("P", 1): (14, -1), ("Q", 0): (10, None), ("Q", 1): (14, None)}
    words = spark.createDataFrame([(1, 2, n, n + 1) for n in range(20, 0, -1)], "db int, dev_code int, number long, unsigned int")
    (r,) = readers.memory_totals(words, 3).collect()
    assert (r.words, r.first, r.last, r.sample) == (20, 1, 20, "1=2 2=3 3=4")


def test_written_findings_are_read_again(spark, tmp_path):
    from rungfleet.sources import readers

    rows = [("P", "a", "high", "Ä1", 1, "x"), ("P", "b", "low", "D2", 2, "")]
    found = spark.createDataFrame(rows, "project string, check_name string, severity string, device string, n long, detail string")
    readers.write_findings(found, f"{tmp_path}/findings")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/findings/check_name=a").collect()} == {("P", "high", "Ä1", 1, "x")}
    readers.export_csv(found, f"{tmp_path}/csv", "UTF-16", "\t")
    texts = [p.read_bytes().decode("utf-16") for p in tmp_path.glob("csv/*.csv")]
    assert sum("Ä1" in t for t in texts) == 1 and all(t.startswith("project\tcheck_name") for t in texts if t)


def test_projects_do_not_share_labels(spark):
    from rungfleet.sources import readers

    cols = spark.createDataFrame([("P", 1, 1, 1, "start"), ("P", 2, 1, 1, "start"), ("Q", 1, 1, 1, "start")], "project string, scope int, row_id int, column_no int, text string")
    dev = spark.createDataFrame([("P", 1, 1, "M1"), ("Q", 1, 1, "M9")], "project string, scope int, row_id int, device string")
    labels = readers.assemble_labels(cols, dev)
    assert {(r.project, r.label, r.devices) for r in labels.collect()} == {("P", "start@1", "M1"), ("P", "start@2", ""), ("Q", "start", "M9")}
    assert {(r.project, r.scope, r.labels, r.assigned) for r in readers.label_summary(labels).collect()} == {("P", 1, 1, 1), ("P", 2, 1, 0), ("Q", 1, 1, 1)}


def test_unused_commented_and_dead_contacts(spark):
    rows = [
        ("P", "L", 1, "M1", "M", "write", "c", 0, 1), ("P", "L", 1, "M2", "M", "read", "a", 0, 1), ("P", "L", 2, "T3", "T", "write", "c", 0, 1), ("P", "L", 2, "M4", "M", "write", "c", 0, 1),
        ("P", "L", 3, "M5", "M", "write", "c", 0, 1), ("P", "L", 3, "M9", "M", "read", "b", 0, 1), ("P", "L", 4, "M9", "M", "read", "a", 0, 1), ("P", "L", 5, "M8", "M", "read", "a", 0, 1), ("P", "L", 6, "M8", "M", "read", "b", 0, 1),
    ]
    use = spark.createDataFrame(rows, "project string, lddb string, pos long, device string, device_type string, access string, role string, run_offset int, n int")
    # M4 lies inside a run that names M3
    members = use.withColumn("member_device", F.col("device")).unionByName(use.limit(1).withColumns({"member_device": F.lit("M4"), "run_offset": F.lit(1)}))
    said = spark.createDataFrame([("P", "M1", "M", "lamp"), ("P", "M5", "M", "Spare coil"), ("P", "M6", "M", "gate"), ("P", "M7", "M", "not used"), ("P", "M4", "M", "in a run"), ("P", "C1", "C", "count"), ("P", "M10", "M", None), ("P", "M11", "M", "")], "project string, device string, device_type string, all_text string")
    got = {(r.device, r.n, r.detail) for r in checks.unused_device(use, members, said).collect()}
    assert got == {("M1", 1, "driven, never read"), ("M6", 0, "commented, never used")}
    assert {r.device for r in checks.unused_device(use, members).collect()} == {"M1", "M5"}
    assert {(r.device, r.n) for r in checks.disabled_rung(use, ["M8"], ("M9",)).collect()} == {("M8", 1), ("M9", 1)}


def test_unknown_opcodes_and_missing_destinations(spark):
    rows = [
        (1, 0, "MOV", 0, "read", "exact"), (1, 0, "MOV", 1, "write", "exact"), (2, 0, "MOV", 0, "read", "exact"), (3, 0, "NEW", 0, "read", "exact"), (4, 0, "MOV", 0, "read", "partial"),
        (5, 0, "LD", 0, "read", "exact"), (6, 0, "SWAP2", 1, "both", "exact"), (6, 1, None, 0, "read", "exact"),
    ]
    use = spark.createDataFrame([("P", "L", *r) for r in rows], "project string, lddb string, pos long, op_index int, opcode string, arg_index int, access string, parse_status string")
    known = spark.createDataFrame([("MOV", [1]), ("LD", []), ("SWAP2", [0, 1])], "opcode string, write_args array<int>")
    got = {(r.pos, r.op_index): r.reason for r in facts.flow_unresolved(use, known).collect()}
    assert got == {(2, 0): "missing destination", (3, 0): "unknown opcode", (4, 0): "partial rung", (6, 0): "missing destination", (6, 1): "unknown opcode"}
    assert {(r.pos, r.reason) for r in facts.flow_unresolved(use).collect()} == {(2, "missing destination"), (3, "missing destination"), (4, "partial rung"), (5, "missing destination"), (6, "missing destination")}


def test_change_summary_and_programs(spark):
    kind = "project string, lddb string, guid string, op_index int, opcode string, argument string"
    old = spark.createDataFrame([("P", "A", "g1", 0, "LD", "M1"), ("P", "A", "g1", 1, "MOV", "K1"), ("P", "A", "g1", 1, "MOV", "D1"), ("P", "A", "g1", 2, "MOV", "K1"), ("P", "A", "g2", 0, "OUT", "Y1"), ("P", "A", "g3", 0, "END", None), ("P", "B", "g9", 0, "OUT", "Y2")], kind)
    new = spark.createDataFrame([("P", "A", "g1", 0, "LDI", "M1"), ("P", "A", "g1", 1, "MOV", "K2"), ("P", "A", "g1", 1, "MOV", "D1"), ("P", "A", "g1", 2, "MOV", "K1"), ("P", "A", "g3", 0, "END", None), ("P", "A", "g3", 1, "END", None), ("P", "C", "g9", 0, "OUT", "Y2"), ("P", "C", "g8", 0, "OUT", "Y3")], kind)
    got = {(r.guid, r.part, r.value, r.old_n, r.new_n) for r in diff.change_summary(old, new).collect()}
    assert got == {
        ("g1", "opcode", "LD", 1, 0), ("g1", "opcode", "LDI", 0, 1), ("g1", "argument", "LD M1", 1, 0), ("g1", "argument", "LDI M1", 0, 1), ("g1", "argument", "MOV K1", 2, 1),
        ("g1", "argument", "MOV K2", 0, 1), ("g3", "opcode", "END", 1, 2),
    }
    rungs = lambda d: d.select("project", "lddb", "guid").distinct()
    assert {tuple(r) for r in diff.diff_programs(rungs(old), rungs(new)).collect()} == {("P", "B", "gone", 1), ("P", "C", "new", 2)}
    assert diff.change_summary(old, old).count() == 0 and diff.diff_programs(old, old).count() == 0


def test_types_by_place_of_operand(spark):
    use = spark.createDataFrame([("P", "MOV", 0, "D1", "D"), ("P", "MOV", 1, "X1", "X"), ("P", "MOV", 0, "X2", "X"), ("P", "OUT", 0, "X3", "X")], "project string, opcode string, arg_index int, device string, device_type string")
    by_place = spark.createDataFrame([("MOV", 0, ["D", "X"]), ("MOV", 1, ["D"])], "opcode string, arg_index int, allowed_types array<string>")
    assert [r.device for r in checks.operand_device(use, by_place).collect()] == ["X1"]
    assert sorted(r.device for r in checks.operand_device(use, by_place.where("arg_index = 1").drop("arg_index")).collect()) == ["X1", "X2"]


def test_conditions_with_an_added_contact(spark):
    rows = [(0, "M1", "a"), (0, "M2", "b"), (1, "M9", "b"), (2, "M9", "a"), (2, "M3", "a")]
    cond = spark.createDataFrame([("P", "L", 1, "Y1", *r) for r in rows] + [("P", "L", 2, "Y2", 0, "M1", "a"), ("Q", "L", 1, "Y1", 0, "M1", "a")], "project string, lddb string, pos long, out_device string, branch int, device string, required string")
    proposals = spark.createDataFrame([("P", "Y1", "M9", "b")] * 2, "project string, out_device string, contact string, contact_required string")
    got = {r.branch: (r.before, r.after, r.effect) for r in lookup.conditions_with_contact(cond, proposals).collect()}
    assert got == {0: ("a M1, b M2", "a M1, b M2, b M9", "changed"), 1: ("b M9", "b M9", "same"), 2: ("a M3, a M9", "a M3, a M9, b M9", "never")}
