"""Queries for captured logs and version diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as df_
from ..operators import logs as lg
from .q_checks import COND, cond
from .registry import query

_LAST = "l as (select project, device, ts, arg_max(value_num, seq) value_num, arg_max(value_type, seq) value_type, max(seq) seq, count(*) - 1 replaced from device_log group by 1, 2, 3)"


@query("j1_check_capture", """with i as (select project, capture, trim(coalesce(source, '')) s, trim(coalesce(fingerprint, '')) f from device_log)
select project, capture, count(distinct {'s': s, 'f': f}) identities, count(distinct s) sources, count(distinct f) fingerprints, count(*) records from i group by 1, 2 having count(distinct {'s': s, 'f': f}) > 1""", ("device_log",))
def _(v):
    return lg.check_capture(v("device_log"), ["project", "capture"])


@query("j2_dedupe_log", f"with {_LAST} select * from l", ("device_log",))
def _(v):
    return lg.dedupe_log(v("device_log").select("project", "device", "ts", "seq", "value_num", "value_type"), ["project", "device", "ts"])


@query("j3_device_series", "select project, device, ts, seq, value_num from device_log", ("device_log",))
def _(v):
    return lg.device_series(v("device_log")).select("project", "device", "ts", "seq", "value_num")


@query("j4_change_points", f"""with {_LAST}, w as (select *, lag(value_num) over (partition by project, device order by ts) previous, lag(value_type) over (partition by project, device order by ts) previous_type, row_number() over (partition by project, device order by ts) rn from l)
select project, device, ts, value_num, value_type, previous, previous_type from w where rn > 1 and (value_num is distinct from previous or value_type is distinct from previous_type)""", ("device_log",))
def _(v):
    log = lg.dedupe_log(v("device_log").select("project", "device", "ts", "seq", "value_num", "value_type"), ["project", "device", "ts"])
    return lg.change_points(log, ["project", "device"], "ts", "value_num", "value_type").select("project", "device", "ts", "value_num", "value_type", "previous", "previous_type")


_AT = "2024-01-10 12:00:00"
_SNAP = f"""s as (select *, row_number() over (partition by project, device order by abs(epoch_us(ts) - epoch_us(timestamp '{_AT}')), ts, seq desc) rn from device_log),
snap as (select project, device, ts, value_num, value_type, abs(epoch_us(ts) - epoch_us(timestamp '{_AT}')) / 1000000.0 distance_s from s where rn = 1)"""


@query("j5_snapshot", f"with {_SNAP} select * from snap", ("device_log",))
def _(v):
    return lg.snapshot(v("device_log"), _AT)


@query("j6_evaluate", f"""with {COND}, {_SNAP}, lit as (select c.*, case when value_num is null then 'missing' when (value_num > 60) = (required = 'a') then 'pass' else 'block' end state from cond c left join snap using (project, device)),
b as (select project, lddb, pos, out_device, branch, case when bool_or(state = 'block') then 'block' when bool_and(state = 'pass') then 'pass' else 'missing' end state from lit group by 1, 2, 3, 4, 5)
select project, lddb, pos, out_device, case when bool_or(state = 'pass') then 'pass' when bool_and(state = 'block') then 'block' else 'missing' end state, count(*) branches from b group by 1, 2, 3, 4""", ("occ", "device_log"))
def _(v):
    snap = lg.snapshot(v("device_log"), _AT).withColumn("value_num", F.when(F.col("value_num") > 60, 1.0).otherwise(F.when(F.col("value_num").isNotNull(), 0.0)))
    return lg.evaluate(cond(v), snap)


# edges by number; rungs that are guarded, partly read or given up by position
_EXPLAINED = f"""{COND}, {_SNAP}, c7 as (select project, lddb, pos, out_device, branch, device, case when device like '%7' then 'p' else required end as required from cond),
lit as (select c.*, case when c.required = 'p' then 'unknown' when value_num is null then 'missing' when (value_num > 60) = (c.required = 'a') then 'pass' else 'block' end state from c7 c left join snap using (project, device)),
b as (select project, lddb, pos, out_device, branch, case when bool_or(state = 'block') then 'block' when bool_and(state = 'pass') then 'pass' when bool_or(state = 'unknown') then 'unknown' else 'missing' end state from lit group by 1, 2, 3, 4, 5),
o as (select project, lddb, pos, out_device, case when bool_or(state = 'pass') then 'pass' when bool_and(state = 'block') then 'block' when bool_or(state = 'unknown') then 'unknown' else 'missing' end state, count(*) branches from b group by 1, 2, 3, 4),
n as (select project, lddb, pos, out_device, count(*) filter (where state = 'pass') n_pass, count(*) filter (where state = 'block') n_block, count(*) filter (where state = 'missing') n_missing, count(*) filter (where state = 'unknown') n_unknown from lit group by 1, 2, 3, 4),
ki as (select project, lddb, pos, list(distinct kind) kinds from (select project, lddb, pos, case role when 'SET' then 'latch set' when 'RST' then 'latch reset' end kind from occ where access in ('write', 'both')) x where kind is not null group by 1, 2, 3),
z as (select o.*, n_pass, n_block, n_missing, n_unknown, o.pos % 13 = 0 g, o.pos % 17 = 0 p, o.pos % 19 = 0 t, kinds from o join n using (project, lddb, pos, out_device) left join ki using (project, lddb, pos)),
e as (select project, lddb, pos, out_device, case when g or p or t then 'unknown' else state end state, branches, n_pass, n_block, n_missing, n_unknown, case when n_unknown > 0 then 'unsupported' when g or p or kinds is not null then 'partial' when t then 'truncated' when n_missing > 0 then 'no_measurement' else 'checked' end analysis,
  array_to_string(list_sort(list_distinct(list_concat(list_filter([case when n_unknown > 0 then 'edge contact' end, case when n_missing > 0 then 'no value' end, case when g then 'may not run' end, case when p then 'not wholly read' end, case when t then 'condition too large' end], lambda x: x is not null), coalesce(kinds, cast([] as varchar[]))))), '; ') constraints from z)"""


def _explained(v):
    c = cond(v).withColumn("required", F.when(F.col("device").endswith("7"), "p").otherwise(F.col("required")))
    snap = lg.snapshot(v("device_log"), _AT).withColumn("value_num", F.when(F.col("value_num").isNotNull(), (F.col("value_num") > 60).cast("double")))
    rungs = c.select("project", "lddb", "pos").distinct()
    flags = rungs.select("*", (F.col("pos") % 13 == 0).alias("guarded"), (F.col("pos") % 17 == 0).alias("partial"), (F.col("pos") % 19 == 0).alias("too_large"))
    none = v("occ").limit(0).select("project", "lddb", "pos", "device", "device_type", F.col("role").alias("required"))
    return lg.explain_outputs(c, snap, flags, lg.temporal_predicates(v("occ"), none, ["T"], ["C"]))


@query("j6_explain_outputs", f"with {_EXPLAINED} select * from e", ("occ", "device_log"))
def _(v):
    return _explained(v)


@query("j6_state_counts", f"with {_EXPLAINED} select project, state, analysis, count(*) outputs from e group by 1, 2, 3", ("occ", "device_log"))
def _(v):
    return lg.count_states(_explained(v))


@query("j7_temporal_predicates", """select distinct project, lddb, pos, kind, device from (
  select project, lddb, pos, device, case when role = 'SET' then 'latch set' when role = 'RST' then 'latch reset' when role = 'c' and device_type = 'L' then 'timer done' when role = 'c' and device_type = 'M' then 'counter done' end kind from occ where access in ('write', 'both')
  union all select project, lddb, pos, device, case when number % 9 = 0 then 'edge contact' when device_type = 'L' then 'timer contact' when device_type = 'M' then 'counter contact' end from occ where role in ('a', 'b')) x where kind is not null""", ("occ",))
def _(v):
    o = v("occ")
    literals = o.where("role in ('a', 'b')").select("project", "lddb", "pos", "device", "device_type", F.when(F.col("number") % 9 == 0, "p").otherwise(F.col("role")).alias("required"))
    return lg.temporal_predicates(o, literals, ["L"], ["M"])


@query("g3_reordered_rungs", """with b as (select o.project, o.lddb, o.guid, o.pos op, n.pos np from rungs_old o join rungs_new n on o.project = n.project and o.lddb = n.lddb and o.guid = n.guid),
r as (select *, row_number() over (partition by project, lddb order by op, guid) old_rank, row_number() over (partition by project, lddb order by np, guid) new_rank from b)
select project, lddb, guid, old_rank, new_rank, new_rank - old_rank moved from r where old_rank <> new_rank""", ("rungs_new",))
def _(v):
    return df_.reordered_rungs(v("rungs_old"), v("rungs_new"))


_SIG = "regexp_replace({0}.data, '(:cb[{{\\[]fg=fg[{{\\[]dim=)[0-9]+x[0-9]+:', '\\1(any size):')"
_G4 = f"""select coalesce(o.project, n.project) project, coalesce(o.lddb, n.lddb) lddb, coalesce(o.guid, n.guid) guid, case when o.guid is null then 'added' when n.guid is null then 'removed' when {_SIG.format('o')} = {_SIG.format('n')} then 'layout' else 'logic' end change, coalesce(n.title, o.title) title
from rungs_old o full join rungs_new n on o.project = n.project and o.lddb = n.lddb and o.guid = n.guid where o.guid is null or n.guid is null or o.data <> n.data"""


@query("g4_diff_rungs", _G4, ("rungs_new",))
def _(v):
    return df_.diff_rungs(v("rungs_old"), v("rungs_new"))


@query("g4_change_summary", """with k as (select distinct o.project, o.lddb, o.guid from steps_old o join steps_new n on o.project = n.project and o.lddb = n.lddb and o.guid = n.guid),
p as (select 'opcode' part, project, lddb, guid, opcode as "value", 1 o, 0 n from (select distinct project, lddb, guid, op_index, opcode from steps_old) x union all select 'opcode', project, lddb, guid, opcode, 0, 1 from (select distinct project, lddb, guid, op_index, opcode from steps_new) x
  union all select 'argument', project, lddb, guid, concat(opcode, ' ', argument), 1, 0 from steps_old where argument is not null union all select 'argument', project, lddb, guid, concat(opcode, ' ', argument), 0, 1 from steps_new where argument is not null)
select project, lddb, guid, part, "value", cast(sum(o) as bigint) old_n, cast(sum(n) as bigint) new_n from p where exists (select 1 from k where k.project = p.project and k.lddb = p.lddb and k.guid = p.guid) group by 1, 2, 3, 4, 5 having sum(o) <> sum(n)""", ("steps_old", "steps_new"))
def _(v):
    return df_.change_summary(v("steps_old"), v("steps_new"))


@query("g4_diff_programs", """select coalesce(o.project, n.project) project, coalesce(o.lddb, n.lddb) lddb, case when o.lddb is null then 'new' else 'gone' end change, coalesce(o.k, n.k) rungs from (select project, lddb, count(*) k from steps_old group by 1, 2) o
full join (select project, lddb, count(*) k from steps_new group by 1, 2) n on o.project = n.project and o.lddb = n.lddb where o.lddb is null or n.lddb is null""", ("steps_old", "steps_new"))
def _(v):
    return df_.diff_programs(v("steps_old"), v("steps_new"))


@query("g5_diff_comments", """select coalesce(o.project, n.project) project, coalesce(o.device, n.device) device, o.all_text old_text, n.all_text new_text, case when o.device is null then 'added' when n.device is null then 'removed' else 'changed' end change
from whole_comments o full join whole_comments_new n on o.project = n.project and o.device = n.device where o.device is null or n.device is null or o.all_text <> n.all_text""", ("whole_comments_new",))
def _(v):
    return df_.diff_comments(v("whole_comments"), v("whole_comments_new"))


@query("g6_diff_config", """with o as (select o_orderkey k, unnest(['status', 'priority']) item, unnest([o_orderstatus, o_orderpriority]) v from orders where o_orderkey % 3 > 0),
n as (select o_orderkey k, unnest(['status', 'customer']) item, unnest([case when o_orderkey % 5 = 0 then 'Z' else o_orderstatus end, cast(o_custkey as string)]) v from orders where o_orderkey % 3 < 2)
select coalesce(o.k, n.k) k, coalesce(o.item, n.item) item, o.v old_value, n.v new_value, case when o.k is null then 'only new' when n.k is null then 'only old' else 'both' end availability
from o full join n on o.k = n.k and o.item = n.item where o.v is distinct from n.v""")
def _(v):
    o = v("orders").withColumnRenamed("o_orderkey", "k")
    old = o.where("k % 3 > 0").select("k", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("settings"))
    status = F.when(F.col("k") % 5 == 0, F.lit("Z")).otherwise(F.col("o_orderstatus"))
    new = o.where("k % 3 < 2").select("k", F.create_map(F.lit("status"), status, F.lit("customer"), F.col("o_custkey").cast("string")).alias("settings"))
    return df_.diff_config(old, new, ["k"])


@query("g7_diff_manifest", """select coalesce(o.project, n.project) project, coalesce(o.lddb, n.lddb) lddb, o.r old_rows, n.r new_rows, o.r is not distinct from n.r and o.h = n.h same_digest from (select project, lddb, count(*) r, string_agg(concat(guid, '|', data), ';' order by guid) h from rungs_old group by 1, 2) o
full join (select project, lddb, count(*) r, string_agg(concat(guid, '|', data), ';' order by guid) h from rungs_new group by 1, 2) n on o.project = n.project and o.lddb = n.lddb where o.h is distinct from n.h""", ("rungs_new",))
def _(v):
    return df_.diff_manifest(v("rungs_old"), v("rungs_new"), ["project", "lddb"], ["guid", "data"])
