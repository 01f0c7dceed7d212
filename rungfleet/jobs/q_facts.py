"""Queries for device names, texts, fact tables and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import devices as dv
from ..functions import texts as tx
from ..operators import facts as fa
from ..operators import lookup as lo
from .registry import query

#: The pieces of the member CTE that several checks share.
MEMBERS = """m as (select o.*, k run_offset, number + k member_number,
  case when k = 0 then device else concat(device_type, case when device_type in ('X', 'Y', 'W') then hex(number + k) else cast(number + k as string) end) end member_device
  from (select *, unnest(range(0, range_len)) k from occ) o)"""


@query("b1_split_device", "select project, device, device_type, number, count(*) n from occ group by 1, 2, 3, 4", ("occ",))
def _(v):
    d = v("occ").select("project", "device", dv.split_device(F.col("device")).alias("s"))
    return d.groupBy("project", "device", F.col("s.device_type").alias("device_type"), F.col("s.number").alias("number")).agg(F.count("*").alias("n"))


@query("b2_canonical_device", "select device, count(*) n from occ group by 1", ("occ",))
def _(v):
    padded = F.concat(F.lower("device_type"), F.lit("0"), F.lower(F.substring("device", 2, 20)))
    return v("occ").select(dv.canonical_device(padded).alias("device")).groupBy("device").agg(F.count("*").alias("n"))


@query("b3_base_opcode", "select opcode, case when step % 2 = 0 then 1 else 0 end pulse, count(*) n from occ group by 1, 2", ("occ",))
def _(v):
    o = v("occ").withColumn("pulse", F.when(F.col("step") % 2 == 0, 1).otherwise(0)).withColumn("code", F.when(F.col("pulse") == 1, F.concat("opcode", F.lit("P"))).otherwise(F.col("opcode")))
    return o.select(tx.base_opcode(F.col("code"), ("MOV", "DMOV", "BMOV", "LD", "OUT", "SET", "RST")).alias("opcode"), "pulse").groupBy("opcode", "pulse").agg(F.count("*").alias("n"))


RULES = (("round", "ring|washer"), ("metal", "bolt|gear|screw"), ("tool", "widget|gadget"))


@query("b6_first_class", """select case when regexp_matches(p_name, 'ring|washer') then 'round' when regexp_matches(p_name, 'bolt|gear|screw') then 'metal'
  when regexp_matches(p_name, 'widget|gadget') then 'tool' else 'other' end class, count(*) n from part group by 1""")
def _(v):
    return v("part").groupBy(tx.first_class(F.col("p_name"), RULES, "other").alias("class")).agg(F.count("*").alias("n"))


@query("b7_label_classes", """select p_partkey, (case when regexp_matches(p_name, 'red|blue') then 1 else 0 end) + (case when regexp_matches(p_name, 'ring|bolt') then 1 else 0 end) n_labels,
  greatest(case when regexp_matches(p_name, 'red|blue') then 2 else 0 end, case when regexp_matches(p_name, 'ring|bolt') then 5 else 0 end) top from part""")
def _(v):
    c = tx.label_classes(F.col("p_name"), (("colour", "red|blue", 2), ("shape", "ring|bolt", 5)))
    return v("part").select("p_partkey", F.size(c).alias("n_labels"), tx.max_weight(c).alias("top"))


@query("b8_canonical_role", "select p_partkey, replace(lower(p_name), 'small', 'little') role from part")
def _(v):
    text = F.concat(F.lit("to => "), F.upper("p_name"), F.lit(" (x) send"))
    return v("part").select("p_partkey", tx.canonical_role(text, ("send", "recv"), {"small": "little"}).alias("role"))


@query("b9_normalize_log", """select event_id, cast(value as double) value_num, case when value = floor(value) and false then 'int' else 'float' end value_type, upper(concat('m', cast(user_id as string))) device from events""")
def _(v):
    e = v("events").select("event_id", tx.parse_value(F.col("value").cast("string")).alias("p"), F.upper(F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("device"))
    return e.select("event_id", F.col("p.value_num").alias("value_num"), F.col("p.value_type").alias("value_type"), "device")


@query("b10_logic_signature", """select project, lddb, count(distinct regexp_replace(data, '(:cb[{\\[]fg=fg[{\\[]dim=)[0-9]+x[0-9]+:', '\\1<canvas>:')) signatures, count(distinct data) bodies from rungs_old group by 1, 2""", ("rungs_old",))
def _(v):
    return v("rungs_old").groupBy("project", "lddb").agg(F.count_distinct(tx.logic_signature(F.col("data"))).alias("signatures"), F.count_distinct("data").alias("bodies"))


@query("b11_timer_seconds", "select occ_id, round(cast(substr(const_args, 2) as double) * case when opcode like '%H%' then 0.01 else 0.1 end, 6) as seconds from occ", ("occ",))
def _(v):
    return v("occ").select("occ_id", F.round(tx.timer_seconds(F.col("opcode"), F.col("const_args")), 6).alias("seconds"))


@query("c2_members", f"with {MEMBERS} select m.project, member_device, run_offset, count(*) n, max(case when run_offset = 0 then comment else coalesce(c.all_text, '') end) comment from m left join comments c on m.project = c.project and m.device_type = c.device_type and member_number = c.number group by 1, 2, 3", ("occ", "comments"))
def _(v):
    return fa.expand_members(v("occ"), v("comments")).groupBy("project", "member_device", "run_offset").agg(F.count("*").alias("n"), F.max("member_comment").alias("comment"))


@query("c3_flow_edges", """select s.project, s.lddb, s.pos, s.op_index, s.occ_id source_occ_id, s.device source_device, s.arg_index source_arg_index, d.occ_id destination_occ_id, d.device destination_device, d.arg_index destination_arg_index,
  s.range_len source_range_len, d.range_len destination_range_len, greatest(s.range_len, d.range_len) range_count, s.device = d.device read_modify_write,
  case when s.parse_status = 'exact' and d.parse_status = 'exact' then 'exact' else 'partial' end confidence
from occ s join occ d on s.project = d.project and s.lddb = d.lddb and s.pos = d.pos and s.op_index = d.op_index where s.access in ('read', 'both') and d.access in ('write', 'both')""", ("occ",))
def _(v):
    return fa.flow_edges(v("occ"))


@query("c4_flow_unresolved", """select project, lddb, pos, op_index, case when sum(case when parse_status <> 'exact' then 1 else 0 end) > 0 then 'partial rung' else 'missing destination' end reason
from occ group by 1, 2, 3, 4 having sum(case when parse_status <> 'exact' then 1 else 0 end) > 0 or sum(case when access in ('write', 'both') then 1 else 0 end) = 0""", ("occ",))
def _(v):
    return fa.flow_unresolved(v("occ"))


@query("c4_unknown_opcodes", """with op as (select project, lddb, pos, op_index, min(opcode) opcode, sum(case when parse_status <> 'exact' then 1 else 0 end) part, max(case when arg_index = 1 then 1 else 0 end) has1, max(case when arg_index = 2 then 1 else 0 end) has2 from occ group by 1, 2, 3, 4)
select project, lddb, pos, op_index, case when part > 0 then 'partial rung' when opcode in ('BMOV', 'RST') then 'unknown opcode' else 'missing destination' end reason
from op where part > 0 or opcode in ('BMOV', 'RST') or (opcode in ('MOV', 'DMOV') and has1 = 0) or (opcode = 'DMOV' and has2 = 0)""", ("occ",))
def _(v):
    args = F.when(F.col("opcode") == "DMOV", F.array(F.lit(1), F.lit(2))).when(F.col("opcode") == "MOV", F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    known = v("occ").select("opcode").distinct().where("opcode not in ('BMOV', 'RST')").select("opcode", args.alias("write_args"))
    return fa.flow_unresolved(v("occ"), known)


@query("c5_carry_titles", """select project, lddb, pos, coalesce(last_value(t ignore nulls) over (partition by project, lddb order by pos rows unbounded preceding), '') section
from (select *, case when pos % 6 = 0 then title end t from rungs_old) x""", ("rungs_old",))
def _(v):
    r = v("rungs_old").withColumn("t", F.when(F.col("pos") % 6 == 0, F.col("title")))
    return fa.carry_titles(r, ["project", "lddb"], ["pos"], "t").select("project", "lddb", "pos", "section")


@query("c6_as_of_step", """select r.project, r.lddb, r.pos, s.pos step from rungs_old r asof left join (select * from rungs_old where pos % 9 = 0) s on r.project = s.project and r.lddb = s.lddb and r.pos >= s.pos""", ("rungs_old",))
def _(v):
    r = v("rungs_old")
    return fa.as_of_step(r, r.where("pos % 9 = 0").select("project", "lddb", "pos", F.col("pos").alias("step")), ["project", "lddb"])


@query("c7_rung_lists", """select project, lddb, pos, coalesce(string_agg(distinct device, ',' order by device) filter (where role in ('a', 'b')), '') conditions,
  coalesce(string_agg(distinct device, ',' order by device) filter (where access in ('write', 'both')), '') outputs, string_agg(distinct device, ',' order by device) devices, count(*) operands from occ group by 1, 2, 3""", ("occ",))
def _(v):
    return fa.rung_lists(v("occ"))


@query("c8_device_stats", """with r as (select project, device, role, count(*) n from occ group by 1, 2, 3), rr as (select project, device, string_agg(concat(role, ':', cast(n as string)), ' ' order by n desc, role) roles from r group by 1, 2),
s as (select project, device, count(*) occurrences, count(distinct case when access in ('write', 'both') then concat(lddb, '/', cast(pos as string)) end) driver_rungs, count(*) filter (where role in ('a', 'b')) condition_uses, min(pos) first_pos from occ group by 1, 2)
select project, device, occurrences, driver_rungs, condition_uses, roles, first_pos, (select min(step) from occ o where o.project = s.project and o.device = s.device and o.pos = s.first_pos) first_step from s join rr using (project, device)""", ("occ",))
def _(v):
    return fa.device_stats(v("occ"))


@query("c9_covered_ranges", "select project, lddb, pos, device, device_type, number start_number, range_len, access from occ where range_len > 1", ("occ",))
def _(v):
    return fa.covered_ranges(v("occ"))


@query("c14_table_stats", """select project, count(*) occurrences, count(distinct device) devices, count(distinct concat(lddb, '/', cast(pos as string))) rungs, count(*) filter (where access in ('write', 'both')) writes,
  count(*) filter (where access in ('read', 'both')) reads, cast(sum(range_len) as bigint) covered from occ group by 1""", ("occ",))
def _(v):
    return fa.table_stats(v("occ"))


@query("d1_where_used", f"with {MEMBERS} select project, member_device, occ_id, device, run_offset, case when run_offset = 0 then 'named' else 'covered' end found_as, case when access = 'both' then 'read+write' else access end use, lddb, pos, role from m where member_number % 50 = 7 and device_type in ('D', 'W')", ("occ",))
def _(v):
    m = fa.expand_members(v("occ"))
    wanted = m.where("member_number % 50 = 7 and device_type in ('D', 'W')").select("project", "member_device").distinct()
    return lo.where_used(m, wanted)


@query("d2_access_counts", f"with {MEMBERS} select project, member_device, count(*) filter (where access in ('read', 'both')) reads, count(*) filter (where access in ('write', 'both')) writes, count(*) filter (where access not in ('read', 'write', 'both')) refs, count(*) total, count(*) filter (where run_offset > 0) covered from m group by 1, 2", ("occ",))
def _(v):
    return fa.access_counts(fa.expand_members(v("occ")))


@query("d3_indexed_counts", "select project, device_type, count(*) filter (where number % 3 = 0) indexed from occ group by 1, 2", ("occ",))
def _(v):
    return lo.indexed_counts(v("occ").withColumn("device", F.when(F.col("number") % 3 == 0, F.concat("device", F.lit("Z2"))).otherwise(F.col("device"))))


@query("d4_device_cards", """with s as (select project, device, any_value(device_type) device_type, any_value(number) number, count(*) occurrences, count(distinct case when access in ('write', 'both') then concat(lddb, '/', cast(pos as string)) end) driver_rungs, count(*) filter (where role in ('a', 'b')) condition_uses, list_sort(list(distinct pos) filter (where access in ('write', 'both')))[1:3] d from occ group by 1, 2),
h as (select s.project, device, min_by(kind, area_no) kind from s join areas a on s.project = a.project and s.device_type = a.device_type and number between start_value and end_value group by 1, 2)
select s.project, s.device, occurrences, driver_rungs, condition_uses, case when driver_rungs > 0 then 'driven' when kind is not null then concat(kind, ' area') when s.device_type = 'X' then 'input' else 'internal' end source, coalesce(array_to_string(d, ','), '') drivers,
  coalesce(c.all_text, '') comment, (select count(*) from occ r where r.project = s.project and r.range_len > 1 and r.device <> s.device and r.device_type = s.device_type and r.number < s.number and s.number < r.number + r.range_len) covering_runs
from s left join h on h.project = s.project and h.device = s.device left join comments c on c.project = s.project and c.device = s.device""", ("occ", "comments", "areas"))
def _(v):
    return lo.device_cards(v("occ"), v("comments"), v("areas"))


@query("d5_search_comments", "select project, device, device_type, number, all_text, english from comments where lower(all_text) like '%ring%' or lower(all_text) like '%washer%' order by device, project limit 100", ("comments",))
def _(v):
    return lo.search_comments(v("comments"), tx.expand_terms("ring", (("ring", "washer"),)), 100)


@query("d5_search_instructions", "select occ_id, opcode, pos, step from occ where opcode like '%BMOV%' order by pos, step, occ_id limit 200", ("occ",))
def _(v):
    return lo.search_instructions(v("occ"), "BMOV", 200).select("occ_id", "opcode", "pos", "step")


@query("d6_same_row", """with h as (select distinct project, lddb, pos from occ where number % 40 = 3)
select project, lddb, pos, coalesce(string_agg(distinct device, ',' order by device) filter (where access in ('write', 'both')), '') outputs, coalesce(string_agg(distinct device, ',' order by device) filter (where role in ('a', 'b')), '') conditions
from occ join h using (project, lddb, pos) group by 1, 2, 3""", ("occ",))
def _(v):
    o = v("occ")
    return lo.same_row(o, o.where("number % 40 = 3").select("project", "device").distinct())


@query("d7_block_context", """with n as (select *, row_number() over (partition by project, lddb order by pos) rn from rungs_old)
select a.project, a.lddb, a.pos hit, b.pos, b.rn - a.rn distance from n a join n b on a.project = b.project and a.lddb = b.lddb and abs(b.rn - a.rn) <= 2 where a.pos % 30 = 0""", ("rungs_old",))
def _(v):
    r = v("rungs_old")
    return lo.block_context(r, r.where("pos % 30 = 0"), 2, ["project", "lddb"])


@query("d12_area_of", """with d as (select distinct project, device, device_type, number from occ), h as (select d.project, device, min(area_no) area_no from d join areas a on d.project = a.project and d.device_type = a.device_type and number between start_value and end_value group by 1, 2)
select d.*, a.area_no, a.kind area_kind, a.unit_name from d left join h using (project, device) left join areas a on a.area_no = h.area_no""", ("occ", "areas"))
def _(v):
    return lo.area_of(v("occ").select("project", "device", "device_type", "number").distinct(), v("areas"))


@query("d13_external_inputs", """with dr as (select distinct project, device from occ where access in ('write', 'both')),
p as (select project, device, device_type, number, count(*) filter (where role = 'a') on_uses, count(*) filter (where role = 'b') off_uses, count(distinct lddb) programs from occ o where role in ('a', 'b') and not exists (select 1 from dr where dr.project = o.project and dr.device = o.device) group by 1, 2, 3, 4),
h as (select p.project, p.device, min_by(kind, area_no) kind from p join areas a on p.project = a.project and p.device_type = a.device_type and number between start_value and end_value group by 1, 2)
select project, device, case when kind is not null then concat(kind, ' area') when device_type = 'X' then 'input' else 'internal' end source, on_uses, off_uses, programs from p left join h using (project, device)""", ("occ", "areas"))
def _(v):
    return lo.external_inputs(v("occ"), v("areas"))


@query("d15_impact_add_contact", """with u as (select distinct project, lddb, pos from occ where device = 'M10' and role in ('a', 'b'))
select project, count(distinct concat(lddb, '/', cast(pos as string))) rungs, count(distinct device) driven from occ join u using (project, lddb, pos) where access in ('write', 'both') group by 1""", ("occ",))
def _(v):
    return lo.impact_of_contact(v("occ"), "M10")


@query("d15_conditions_with_contact", """with l as (select distinct project, lddb, pos, out_device, branch, concat(required, ' ', device) lit from chain_cond), w as (select * from l union select distinct project, lddb, pos, out_device, branch, 'b SM0' from l),
b as (select project, lddb, pos, out_device, branch, string_agg(lit, ', ' order by lit) "before", max(case when lit = 'a SM0' then 2 when lit = 'b SM0' then 1 else 0 end) e from l group by 1, 2, 3, 4, 5), a as (select project, lddb, pos, out_device, branch, string_agg(lit, ', ' order by lit) "after" from w group by 1, 2, 3, 4, 5)
select project, lddb, pos, out_device, branch, 'SM0' contact, "before", "after", case e when 2 then 'never' when 1 then 'same' else 'changed' end effect from b join a using (project, lddb, pos, out_device, branch)""", ("chain_cond",))
def _(v):
    proposals = v("chain_cond").select("project", "out_device").distinct().withColumns({"contact": F.lit("SM0"), "contact_required": F.lit("b")})
    return lo.conditions_with_contact(v("chain_cond"), proposals)


@query("d16_first_reads", f"with {MEMBERS} select project, member_device, lddb, min(pos) first_pos, cast(0 as bigint) unknown_positions from m where access in ('read', 'both') group by 1, 2, 3", ("occ",))
def _(v):
    return fa.first_reads(fa.expand_members(v("occ")))


@query("b4_access_basis", "select project, access, role, count(*) n, count(*) filter (where access in ('read', 'both')) n_reads from occ group by 1, 2, 3", ("occ",))
def _(v):
    return lo.access_basis(v("occ"))
