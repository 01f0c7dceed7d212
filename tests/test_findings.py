"""Queries on tables made for one finding of a review each, against their SQL."""

from __future__ import annotations

import os
import random

import duckdb

from rungfleet.jobs import registry

SF = "/root/testdata/sf0.001"


def compare(spark, folder, name, **tables):
    """Rows of a query over ``tables`` (SELECTs of a table of the smallest size, which
    stands for the others) and whether its SQL gives the same."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        t = f.removesuffix(".parquet")
        con.sql(f"create view base_{t} as select * from '{SF}/{f}'")
        con.sql(f"copy ({tables.get(t, f'select * from base_{t}')}) to '{folder}/{f}' (format parquet)")
        con.sql(f"create view {t} as select * from '{folder}/{f}'")
    df = registry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    want = sorted(map(repr, con.sql("select " + ",".join(f'"{c}"' for c in cols) + f" from ({registry.oracle_sql()[name]}) q").fetchall()))
    return got, want


def test_comments_of_high_numbers(spark, tmp_path):
    got, want = compare(spark, tmp_path, "a4_assemble_comments", part="select * replace (p_partkey + 1048500 as p_partkey) from base_part")
    assert len(want) > 400
    assert got == want


def full_comments(where: str) -> str:
    """Numbers of ``part`` in each of the four projects, none left out."""
    return f"select 'P' || k project, p_partkey number from '{SF}/part.parquet', range(4) t(k) where {where}"


def test_io_list_of_every_comment(spark):
    got = {(r.project, r.device) for r in registry.queries()["e8_io_list"](spark, SF).collect()}
    want = duckdb.sql(f"select project, case number % 8 when 0 then 'X' else 'Y' end || hex(number) from ({full_comments('p_partkey % 8 < 2 and (p_partkey + k) % 5 > 0')})").fetchall()
    assert set(want) <= got


def test_comment_changes_of_every_device(spark):
    got = [(r.project, r.device) for r in registry.queries()["g5_diff_comments"](spark, SF).collect() if r.change == "removed"]
    want = duckdb.sql(f"select count(*) from ({full_comments('p_partkey % 14 = 0')})").fetchall()[0][0]
    assert len(got) == len(set(got)) == want


def test_comments_of_every_device(spark):
    got = [(r.project, r.number) for r in registry.queries()["a4_assemble_comments"](spark, SF).collect()]
    assert sorted(got) == sorted(duckdb.sql(full_comments("p_partkey % 13 > 0")).fetchall())


def test_seeds_that_lead_beyond(spark):
    from rungfleet.operators import graph

    rng = random.Random(3)
    edges = {("P", f"{c}{a}", f"{c}{b}") for c, n in (("A", 4), ("B", 9), ("C", 30)) for a in range(n) for b in rng.sample(range(n), 3) if a != b}
    changed = [(f"g{c}{i}", "P", "L", f"g{c}{i}") for c in "ABC" for i in range(4)]
    writes = [("P", "L", g, f"{g[1]}{i}") for _, _, _, g in changed for i in (int(g[2]), int(g[2]) // 2)]
    w = spark.createDataFrame(writes, "project string, lddb string, guid string, device string")
    made = spark.createDataFrame(changed, "change_id string, project string, lddb string, guid string")
    e = spark.createDataFrame(sorted(edges), "project string, source string, target string")
    got = {r.seed: (r.written, r.reached, r.state) for r in graph.change_impact(made, w, w, e, 1).collect()}
    for seed, *_ in changed:
        own = {d for _, _, g, d in writes if g == seed}
        near = {t for _, s, t in edges if s in own} - own
        far = {t for _, s, t in edges if s in near} - near - own
        assert got[seed] == (len(own), len(near), "truncated" if far else "checked")
    assert {s for _, _, s in got.values()} == {"truncated", "checked"}
    # which seeds lead beyond is settled without a walk over their edges
    found = spark.createDataFrame([("s", "P", "A0", 1)], "seed string, project string, device string, depth int")
    assert [tuple(r) for r in graph._seeds_beyond(found, e, 1).collect()] == [("s", True)]


def test_conflicts_are_counted_without_copies_of_rows(spark):
    from rungfleet.operators import checks

    rows = [("P", "a ", "X1", "X"), ("P", "A", "Y1", "Y"), ("P", "A", "Y1", "Y"), ("P", "b", "X1", "X"), ("P", "b", "X2", "X"), ("P", "c", "X3", "X"), ("Q", "a", "X1", "X"), ("P", "", "X4", "X"), ("P", "", "X5", "X")]
    found = checks.comment_conflict(spark.createDataFrame(rows, "project string, all_text string, device string, device_type string"))
    assert sorted((r.project, r.detail, r.device, r.n, r.severity) for r in found.collect()) == [("P", "a", "X1", 2, "medium"), ("P", "b", "X1", 2, "low")]
    # two distinct counts in one aggregation would give each row three times
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_memory_blocks_are_dealt_before_they_grow(spark):
    from rungfleet.sources import readers

    blocks = spark.createDataFrame([(1, 2, 10 * i, bytes([i, 0, 0, 1])) for i in range(1, 30)], "db int, dev_code int, dev_no long, mem_data binary").coalesce(1)
    words = readers.read_memory_blocks(blocks, [1])
    assert sorted((r.number, r.unsigned) for r in words.collect()) == sorted(x for i in range(1, 30) for x in ((10 * i, i), (10 * i + 1, 256)))
    assert "REPARTITION_BY_COL" in words._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark, monkeypatch):
    from rungfleet.sources import views

    held = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(views, "ROWS_A_PARTITION", 100)
    many = registry.queries()["e18_signal_traits"](spark, SF)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 60
    rows = many.count()
    monkeypatch.undo()
    assert registry.queries()["e18_signal_traits"](spark, SF).count() == rows
    assert spark.conf.get("spark.sql.shuffle.partitions") == held


def test_operand_is_parsed_once(spark):
    df = registry.queries()["c1_build_occurrences"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the longest alternative of the decimal types stands once for the operand's text and once for its device
    assert plan.count("LSTS|LSTC|LSTN") == 2


def test_instruction_lists_share_files(spark, monkeypatch):
    from rungfleet.sources import readers

    seen = []
    read = readers.read_instruction_csv
    monkeypatch.setattr(readers, "read_instruction_csv", lambda s, path: seen.append(path) or read(s, path))
    got = registry.queries()["a1_read_instruction_csv"](spark, SF)
    files = spark.read.format("binaryFile").load(seen[0]).count()
    assert files <= int(spark.conf.get("spark.sql.shuffle.partitions")) < got.select("program").distinct().count()


def test_rungs_that_are_drawn_alike_are_folded_once(spark):
    from rungfleet.operators import conditions

    cells = [("P", f"L{i % 3}", i, 0, 0, "a", "X1") for i in range(40)] + [("P", f"L{i % 3}", i, 0, 1, "out", "Y1") for i in range(40)]
    c = spark.createDataFrame(cells, "project string, lddb string, pos long, row int, col int, kind string, device string")
    w = c.where("false").select("project", "lddb", "pos", "row", "col")
    got = sorted(map(tuple, conditions.fold_wiring(c, w, 1).collect()))
    assert got == sorted(("P", f"L{i % 3}", i, "Y1", 0, "X1", "a", "contact") for i in range(40))
    drawn = '[{"row":0,"col":0,"kind":"a","device":"X1"},{"row":0,"col":1,"kind":"out","device":"Y1"}]'
    assert conditions._folded(drawn, 1) is conditions._folded(drawn, 1)


def test_a_device_without_changes_gives_no_frame(spark, monkeypatch):
    import pandas as pd

    from rungfleet.streaming import log_streams

    stream = spark.readStream.format("rate").load().selectExpr("'P' project", "'M1' device", "timestamp ts", "value seq", "1d value_num", "'x' value_type")
    caught = []
    monkeypatch.setattr(type(stream.groupBy("device")), "applyInPandasWithState", lambda self, f, *a: caught.append(f))
    log_streams.stream_changes(stream, "1 hour")

    class State:
        hasTimedOut = exists = False
        update = setTimeoutTimestamp = lambda self, x: None
        getCurrentWatermarkMs = lambda self: 0

    def rows(*values):
        return pd.DataFrame([("P", "M1", pd.Timestamp(k, unit="s"), k, float(v), "x") for k, v in values], columns=["project", "device", "ts", "seq", "value_num", "value_type"])

    changes = caught[0]
    assert list(changes(("P", "M1"), iter([rows((2, 5)), rows((1, 5))]), State())) == []
    (found,) = changes(("P", "M1"), iter([rows((3, 7), (2, 5)), rows((1, 5))]), State())
    assert found.values.tolist() == [["P", "M1", pd.Timestamp(3, unit="s"), 7.0, "x", 5.0, "x"]]


def test_snapshot_without_python_a_device(spark, tmp_path, monkeypatch):
    """A device costs no call of Python, and one that keeps its value is not written."""
    from pyspark.sql import functions as F

    from rungfleet.streaming import log_streams as st

    monkeypatch.setattr(st, "LatestRecord", None)
    shape = "project string, device string, ts timestamp, seq long, value_num double, value_type string"
    cond = spark.createDataFrame([("P", "L", 1, "Y1", 0, "X1", "a"), ("P", "L", 2, "Y2", 0, "X2", "a"), ("P", "L", 3, "Y3", 0, "X3", "a")], "project string, lddb string, pos int, out_device string, branch int, device string, required string")
    for i, rows in enumerate(([("X1", 1, 1.0), ("X2", 2, 1.0), ("X2", 3, None)], [("X1", 4, 1.0), ("X2", 5, 0.0), ("X3", 6, float("nan"))], [("X1", 7, 0.0), ("X1", 8, 1.0), ("X2", 1, 1.0)])):
        spark.createDataFrame([("P", d, s, v) for d, s, v in rows], "project string, device string, seq long, value_num double").select("project", "device", F.timestamp_seconds("seq").alias("ts"), "seq", "value_num", F.lit("bit").alias("value_type")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.stream_snapshot(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), cond, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    changes = {(r.batch, r.device): (r.seq, r.value_num) for r in spark.read.parquet(f"{tmp_path}/out/changes").collect()}
    assert changes == {(0, "X1"): (1, 1.0), (0, "X2"): (3, None), (1, "X2"): (5, 0.0), (1, "X3"): (6, None)}
    assert {r.out_device: r.state for r in st.read_verdicts(spark, f"{tmp_path}/out").collect()} == {"Y1": "pass", "Y2": "block", "Y3": "missing"}


def test_constants_keep_only_what_may_be_decided(spark, monkeypatch):
    """A chain of outputs, a ring, and outputs that no fact can decide: conditions of no
    candidate are not stored, and those of settled outputs not again."""
    from rungfleet.operators import graph as gr

    rows = [(f"Y{i}", 0, f"Y{i - 1}" if i else "SM", "a") for i in range(6)] + [("R1", 0, "R2", "a"), ("R2", 0, "R1", "a"), ("R1", 1, "SM", "b"), ("R3", 0, "R1", "b"), ("R3", 0, "SM", "a")]
    rows += [(f"N{i}", 0, "X1", "a") for i in range(9)] + [("N9", 0, "SM", "b"), ("N9", 1, "X1", "a"), ("N9", 1, "SM", "b"), ("E", 0, "", ""), ("F", 0, "Q", "a"), ("U", 0, "SM", "p")] + [(f"Z{i}", 0, "SM", "a") for i in range(40)]
    cond = spark.createDataFrame([("P", "L", k, *r) for k, r in enumerate(rows)], "project string, lddb string, pos int, out_device string, branch int, device string, required string")
    facts = spark.createDataFrame([("P", "SM", 1)], "project string, device string, value int")
    free = [f"Y{i}" for i in range(6)] + ["R1", "R2", "R3", "E", "F", "U", "Q"] + [f"N{i}" for i in range(10)]
    stored, written = gr.stored, []

    def counting(df):
        out = stored(df)
        if "branch" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(gr, "stored", counting)
    got = {r.device: (r.value, r["round"], r.depth, r.roots, r.chain) for r in gr.propagate_constants(cond.withColumn("pos", cond["pos"] % 1), facts, spark.createDataFrame([("P", d) for d in free], "project string, device string")).collect()}
    assert got["Y5"] == (1, 6, 6, ["SM"], [f"Y{i}" for i in range(6)]) and got["E"] == (1, 1, 1, ["L:0"], ["E"]) and got["N9"] == (0, 1, 1, ["SM"], ["N9"])
    assert set(got) == {"SM", "E", "N9", *(f"Y{i}" for i in range(6))}
    assert written[0] == len(rows) - 40 and written[1:3] == [11, 9] and sum(written[1:]) <= 50


def test_components_of_some_devices(spark, monkeypatch):
    """Components of some devices are those of the whole graph; what these devices
    neither reach nor are reached by is not coloured."""
    from rungfleet.operators import graph as gr

    rng = random.Random(5)
    edges = sorted({(p, f"{g}{rng.randrange(30)}", f"{g}{rng.randrange(30)}") for p in "PQ" for g in "ABC" for _ in range(45)})
    df = spark.createDataFrame(edges, "project string, source string, target string")
    asked = [("P", f"A{i}") for i in range(0, 30, 2)] + [("Q", "B1")]
    stored, most = gr.stored, []

    def counting(df):
        out = stored(df)
        if "colour" in out.columns:
            most.append(out.count())
        return out

    monkeypatch.setattr(gr, "stored", counting)
    get = lambda d: {(r.project, r.device): r.component for r in d.collect()}
    whole = get(gr.strong_components(df))
    far, most[:] = max(most), []
    some = get(gr.strong_components(df, spark.createDataFrame(asked, "project string, device string")))
    assert some.items() <= whole.items() and any(d in whole for d in asked)
    assert {d: some.get(d) for d in asked} == {d: whole.get(d) for d in asked}
    assert 0 < 2 * max(most) <= far


def test_scan_order_moves_rows_once(spark, monkeypatch):
    """Rows of g2 are dealt once for all windows; devices with many rows take windows
    of their own, with the same result."""
    from rungfleet.operators import order

    run = lambda: registry.queries()["g2_scan_order_pairs"](spark, SF)
    df = run()
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = sorted(map(str, df.collect()))
    for most in (0, 10):
        monkeypatch.setattr(order, "PART_ROWS", most)
        monkeypatch.setattr(order, "PART_TIMES", 0)
        assert sorted(map(str, run().collect())) == rows


def test_impact_is_walked_once(spark, monkeypatch):
    """What changes reach is written once, and only changes that no device two hops from
    what they write has settled are walked on."""
    from rungfleet.operators import graph as gr

    stored, seen = gr.stored, []

    def counting(df):
        out = stored(df)
        seen.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(gr, "stored", counting)
    rows = registry.queries()["g8_change_impact"](spark, SF).collect()
    reached = sum(r.written + r.reached for r in rows)
    assert {r.state for r in rows} == {"truncated", "checked"}
    whole = [n for c, n in seen if {"project", "device", "depth"} <= c and n > reached / 2]
    assert len(whole) == 1
    walked_on = [n for c, n in seen if c == {"seed", "project", "source"}]
    assert 10 * sum(walked_on) < reached
    # a rung's rows are dealt once
    occ = spark.createDataFrame([("P", "L", 1, 0, "X1", "read", "a"), ("P", "L", 1, 0, "M1", "both", "c"), ("P", "L", 1, 1, "M2", "write", "c"), ("P", "L", 2, 0, "M1", "read", "b")], "project string, lddb string, pos long, op_index int, member_device string, access string, role string")
    links = gr.rung_links(occ, mine=gr.F.col("member_device") == "M2")
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.pos: (sorted(r.writes), sorted((x.source, sorted(x.targets)) for x in r.links), r.mine) for r in links.collect()}
    assert got == {1: (["M1", "M2"], [("X1", ["M1", "M2"])], ["M2"]), 2: ([], [], [])}
