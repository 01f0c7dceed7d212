"""Queries for inventories and rule checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts as tx
from ..operators import checks as ch
from ..operators import facts as fa
from ..operators import inventory as iv
from .q_facts import MEMBERS, RULES
from .registry import query

_W = "access in ('write', 'both')"
_R = "access in ('read', 'both')"
M1 = MEMBERS


def known(v) -> DataFrame:
    """Opcodes with a category, from the opcodes in use."""
    o = v("occ").select("opcode").distinct()
    return o.select("opcode", F.when(F.col("opcode").endswith("MOV"), "transfer").when(F.col("opcode") == "LD", "contact").when(F.col("opcode") == "OUT", "coil").alias("category")).where("category is not null")


def cond(v) -> DataFrame:
    """Conditions as branches of literals: contacts of a rung by line."""
    o = v("occ")
    lit = o.where("role in ('a', 'b')").select("project", "lddb", "pos", F.col("step").alias("branch"), "device", F.col("role").alias("required"))
    out = o.where("access in ('write', 'both') and role in ('c', 'SET', 'RST')").select("project", "lddb", "pos", F.col("device").alias("out_device")).distinct()
    return out.join(lit, ["project", "lddb", "pos"]).distinct()


COND = f"""cond as (select distinct o.project, o.lddb, o.pos, o.device out_device, l.step branch, l.device, l.role required from occ o join occ l
  on o.project = l.project and o.lddb = l.lddb and o.pos = l.pos where o.{_W} and o.role in ('c', 'SET', 'RST') and l.role in ('a', 'b'))"""
_KNOWN = "known as (select distinct opcode, case when opcode like '%MOV' then 'transfer' when opcode = 'LD' then 'contact' when opcode = 'OUT' then 'coil' end category from occ where opcode like '%MOV' or opcode in ('LD', 'OUT'))"


@query("e1_device_map", """with x as (select project, device_type, number start_at, max(number + range_len - 1) end_at from occ group by 1, 2, 3),
y as (select *, max(end_at) over (partition by project, device_type order by start_at rows between unbounded preceding and 1 preceding) reach from x),
z as (select *, sum(case when reach is null or start_at > reach + 1 then 1 else 0 end) over (partition by project, device_type order by start_at) island from y),
m as (select project, device_type, min(start_at) start_at, max(end_at) end_at from z group by project, device_type, island),
g as (select *, lead(start_at) over (partition by project, device_type order by start_at) - end_at - 1 gap from m),
k as (select *, row_number() over (partition by project, device_type order by gap desc, end_at) rk from g where gap >= 3),
f as (select project, device_type, string_agg(concat(cast(end_at + 1 as string), '(', cast(gap as string), ')'), ' ' order by rk) free from k where rk <= 4 group by 1, 2),
t as (select project, device_type, cast(sum(end_at - start_at + 1) as bigint) used, min(start_at) lowest, max(end_at) highest from m group by 1, 2)
select t.*, highest - lowest + 1 span, round(100.0 * used / (highest - lowest + 1), 1) density_pct, coalesce(free, '') free from t left join f using (project, device_type)""", ("occ",))
def _(v):
    return iv.device_map(v("occ"), 3, 4)


@query("e2_device_dictionary", f"""with u as (select project, device, count(*) filter (where {_R}) reads, count(*) filter (where {_W}) writes, string_agg(distinct pou, ',' order by pou) pous, min(step) first_step from occ group by 1, 2)
select project, device, coalesce(all_text, '') all_text, coalesce(reads, 0) reads, coalesce(writes, 0) writes, coalesce(pous, '') pous, first_step, case when reads is null then 'comment only' when all_text is null then 'use only' else 'both' end found
from (select project, device, all_text from comments) c full join u using (project, device)""", ("occ", "comments"))
def _(v):
    return iv.device_dictionary(v("comments"), v("occ"))


@query("e3_program_metrics", f"""with {COND}, o as (select project, lddb, pos, out_device, count(distinct branch) branches, count(*) terms from cond group by 1, 2, 3, 4)
select project, lddb, count(distinct pos) rungs, count(*) outputs, cast(sum(terms) as bigint) terms, cast(sum(branches) as bigint) branches, round(avg(terms), 4) avg_terms, max(branches) max_complexity from o group by 1, 2""", ("occ",))
def _(v):
    return iv.program_metrics(cond(v))


@query("e4_hotspots", f"with {COND} select project, lddb, pos, count(distinct concat(out_device, '/', cast(branch as string))) complexity, count(*) terms from cond group by 1, 2, 3 order by 4 desc, 5 desc, 1, 2, 3 limit 50", ("occ",))
def _(v):
    return iv.hotspots(cond(v), 50)


@query("e5_ladder_toc", f"""with b as (select project, lddb, title, count(distinct pos) rungs, min(pos) first_pos, max(pos) last_pos, count(*) filter (where parse_status = 'partial') partial from occ group by 1, 2, 3),
n as (select project, lddb, title, device, 'd' kind, count(*) n from occ where {_W} group by 1, 2, 3, 4 union all select project, lddb, title, device, 'c', count(*) from occ where role in ('a', 'b') group by 1, 2, 3, 4),
r as (select *, row_number() over (partition by project, lddb, title, kind order by n desc, device) rk from n),
t as (select project, lddb, title, coalesce(string_agg(device, ' ' order by rk) filter (where kind = 'd'), '') drivers, coalesce(string_agg(device, ' ' order by rk) filter (where kind = 'c'), '') conditions from r where rk <= 8 group by 1, 2, 3)
select b.*, coalesce(drivers, '') drivers, coalesce(conditions, '') conditions from b left join t using (project, lddb, title)""", ("occ",))
def _(v):
    return iv.ladder_toc(v("occ"))


@query("e6_device_inventory", """with c as (select *, case when regexp_matches(comment, 'ring|washer') then 'round' when regexp_matches(comment, 'bolt|gear|screw') then 'metal' when regexp_matches(comment, 'widget|gadget') then 'tool' else 'other' end category from occ),
n as (select project, category, device, title, count(*) n from c group by 1, 2, 3, 4), r as (select *, row_number() over (partition by project, category, device order by n desc, title) rk from n)
select project, category, device, uses, programs, titles from (select project, category, device, count(*) uses, count(distinct lddb) programs from c group by 1, 2, 3) b join (select project, category, device, string_agg(title, ' ' order by rk) titles from r where rk <= 3 group by 1, 2, 3) t using (project, category, device)""", ("occ",))
def _(v):
    return iv.device_inventory(v("occ"), tx.first_class(F.col("comment"), RULES, "other"))


@query("e7_missing_comments", """with u as (select project, device, device_type, count(*) filter (where parse_status = 'exact') exact, count(*) filter (where parse_status <> 'exact') partial, list_sort(list(distinct pos))[1:3] s from occ group by 1, 2, 3)
select project, device, case when all_text is null then 'row-missing' else 'blank' end status, case when device_type in ('X', 'Y') then 'high' else 'medium' end severity, exact, partial, array_to_string(s, ',') samples from u left join (select project, device, all_text from comments) c using (project, device) where coalesce(all_text, '') = ''""", ("occ", "comments"))
def _(v):
    return iv.missing_comments(v("occ"), v("comments"))


@query("e8_io_list", f"""with u as (select project, device, device_type, count(*) uses, min(case when {_W} then pos end) coil_pos from occ where device_type in ('X', 'Y') group by 1, 2, 3)
select project, device, coalesce(u.device_type, c.device_type) device_type, coalesce(all_text, '') as comment, coalesce(uses, 0) uses, coil_pos from u full join (select project, device, device_type, all_text from whole_comments where device_type in ('X', 'Y') and all_text <> '') c using (project, device)""", ("occ", "whole_comments"))
def _(v):
    return iv.io_list(v("occ"), v("whole_comments"))


@query("e9_timer_settings", "select project, lddb, pos, device, opcode, const_args, round(cast(substr(const_args, 2) as double) * 0.1, 4) preset_s from occ where opcode = 'MOV' and device_type = 'D' and arg_index = 0", ("occ",))
def _(v):
    o = v("occ")
    families = o.select("opcode").distinct().select("opcode", F.when(F.col("opcode") == "MOV", "timer").otherwise("other").alias("family"))
    return iv.timer_settings(o, families, ["D"], tx.timer_seconds(F.col("opcode"), F.col("const_args")))


@query("e10_changeability", """with c as (select project, lddb, pos, count(*) n, count(*) filter (where role in ('SET', 'RST')) l, count(*) filter (where parse_status = 'partial') p, count(*) filter (where opcode in ('MOV', 'DMOV', 'BMOV')) m from occ group by 1, 2, 3)
select project, lddb, pos, case when n >= 6 then 2 else 0 end + case when l > 0 then 3 else 0 end + case when p > 0 then 4 else 0 end + case when m > 0 then 1 else 0 end score,
  concat_ws(',', case when n >= 6 then 'large' end, case when l > 0 then 'latch' end, case when p > 0 then 'partial' end, case when m > 0 then 'data' end) reasons from c""", ("occ",))
def _(v):
    return iv.changeability(v("occ"))


@query("e12_gap_matrix", f"""select project, case when role in ('a', 'b') then 'condition' when {_W} then 'destination' else 'operand' end reason, case when device_type in ('X', 'Y') then 'high' else 'normal' end priority, count(*) n, count(distinct concat(lddb, '/', cast(pos as string))) rungs,
  array_to_string(list_sort(list(distinct pos))[1:5], ',') samples from occ where parse_status = 'partial' group by 1, 2, 3""", ("occ",))
def _(v):
    return iv.gap_matrix(v("occ"))


@query("e13_instruction_coverage", f"with {_KNOWN} select project, opcode, count(*) uses, count(*) filter (where parse_status = 'partial') partial, min(pos) sample, case when any_value(category) is null then 'unknown' else 'known' end status, coalesce(any_value(category), '') category from occ left join known using (opcode) group by 1, 2", ("occ",))
def _(v):
    return iv.instruction_coverage(v("occ"), known(v))


@query("e13_device_coverage", "select project, device_type, count(*) uses, count(distinct device) devices, count(*) filter (where parse_status = 'partial') partial from occ group by 1, 2", ("occ",))
def _(v):
    return iv.device_coverage(v("occ"))


@query("e14_instruction_usage", f"with {_KNOWN} select project, coalesce(category, 'other') category, count(*) uses, count(distinct opcode) opcodes from occ left join known using (opcode) group by 1, 2", ("occ",))
def _(v):
    return iv.instruction_usage(v("occ"), known(v))


@query("e15_pou_counts", "select project, pou, count(distinct pos) rungs, count(distinct device) devices from occ group by 1, 2", ("occ",))
def _(v):
    return iv.pou_counts(v("occ"))


_TRAITS = f"""h as (select project, device, max(case when c and d then 1 else 0 end) hold from (select project, device, lddb, pos, bool_or(role in ('a', 'b')) c, bool_or({_W}) d from occ group by 1, 2, 3, 4) x group by 1, 2),
tr as (select project, device, concat_ws(',', case when bool_or(role in ('SET', 'RST')) then 'latched' end, case when bool_or({_W} and opcode = 'RST') then 'pulse' end, case when any_value(hold) = 1 then 'self-hold' end, case when bool_or(regexp_matches(comment, 'ring|bolt')) then 'command' end, case when bool_or(regexp_matches(comment, 'plate')) then 'completion' end, case when bool_or(regexp_matches(comment, 'rod')) then 'state' end,
  case when not bool_or({_W}) then 'read-only' end, case when not bool_or({_R}) then 'write-only' end) traits from occ join h using (project, device) group by 1, 2)"""


@query("e18_signal_traits", f"with {_TRAITS} select * from tr", ("occ",))
def _(v):
    return iv.signal_traits(v("occ"), {"command": "ring|bolt", "completion": "plate", "state": "rod"}, ("RST",))


_ALARM = f"""{_TRAITS}, b as (select * from occ where regexp_matches(comment, 'red') and device_type in ('M', 'L', 'Y') and {_W}),
al as (select project, device, case when count(*) filter (where role = 'SET') > 0 then 'SET' when any_value(traits) like '%self-hold%' then 'self-hold' else 'OUT' end hold, count(*) filter (where role = 'SET') sets, count(*) filter (where role = 'RST') resets,
  coalesce(array_to_string(list_sort(list(distinct pos) filter (where role = 'RST'))[1:5], ','), '') reset_at from b join tr using (project, device) group by 1, 2),
ca as (select d.project, d.device, c.device cause, c.device_type from (select distinct project, lddb, pos, device from b where role <> 'RST') d join occ c on c.project = d.project and c.lddb = d.lddb and c.pos = d.pos where c.role in ('a', 'b') and c.device <> d.device),
am as (select al.*, coalesce(triggers, '') triggers, coalesce(timer, '') timer, preset_s from al left join (select project, device, array_to_string(list_sort(list(distinct cause))[1:5], ',') triggers, min(cause) filter (where device_type = 'L') timer from ca group by 1, 2) t using (project, device)
  left join (select project, device timer, round(min(cast(substr(const_args, 2) as double)) * 0.1, 4) preset_s from occ where device_type = 'L' and opcode = 'OUT' and arg_index = 0 group by 1, 2) ps using (project, timer))"""


@query("e16_alarm_map", f"with {_ALARM} select * from am", ("occ",))
def _(v):
    o = v("occ")
    families = o.select("opcode").distinct().withColumn("family", F.when(F.col("opcode") == "OUT", "timer"))
    return iv.alarm_map(o, "red", ("L",), iv.timer_settings(o, families, ["L"], tx.timer_seconds(F.col("opcode"), F.col("const_args"))))


_F1 = f"""select project, check_name, severity, device, n, detail from (with {COND}, x as (select distinct project, device, device_type, lddb, pos, op_index, role from occ where {_W} and role in ('c', 'SET', 'RST')),
rc as (select project, device, role, count(*) k from x group by 1, 2, 3), rt as (select project, device, string_agg(concat(role, '=', cast(k as string)), '; ' order by k desc, role) roles from rc group by 1, 2),
cb as (select project, lddb, pos, out_device, branch, string_agg(distinct concat(device, ' ', required), ',' order by concat(device, ' ', required)) b from cond group by 1, 2, 3, 4, 5), ck as (select project, lddb, pos, out_device, string_agg(distinct b, ';' order by b) ck from cb group by 1, 2, 3, 4),
sk as (select x.project, x.device, count(*) filter (where ck is null) no, count(distinct ck) k from x left join ck on ck.project = x.project and ck.lddb = x.lddb and ck.pos = x.pos and ck.out_device = x.device where x.role = 'c' group by 1, 2),
bn as (select project, device, bool_or(regexp_matches(concat_ws(' ', comment, title), 'gizmo')) benign from occ where {_W} and role in ('c', 'SET', 'RST') group by 1, 2),
y as (select project, device, device_type, count(*) n, count(*) filter (where role = 'c') c from x group by 1, 2, 3 having count(*) > 1)
select y.project, 'duplicate-coil' check_name, case when device_type in ('Y', 'M', 'L') and c > 1 and not benign and not (coalesce(no, 0) = 0 and k = 1) then 'high' else 'medium' end severity, y.device, n, concat('roles: ', roles) detail
from y join rt using (project, device) join bn using (project, device) left join sk using (project, device)) f1"""
_F16 = "select project, 'set-without-rst' check_name, 'medium' severity, device, count(*) filter (where role = 'SET') n, 'never reset' detail from {0} group by project, device having count(*) filter (where role = 'SET') > 0 and count(*) filter (where role = 'RST') = 0"


@query("f1_duplicate_coil", _F1, ("occ",))
def _(v):
    return ch.duplicate_coil(v("occ"), cond(v), "gizmo")


@query("f2_multi_writer", f"""with {MEMBERS}, p as (select project, device_type, any_value(case when device_type = 'W' then hex(member_number) else cast(member_number as string) end) written, member_number, string_agg(distinct concat(lddb, '/', cast(pos as string)), ',' order by concat(lddb, '/', cast(pos as string))) w, count(distinct concat(lddb, '/', cast(pos as string))) k from m where {_W} and device_type in ('D', 'W') group by 1, 2, 4),
q as (select *, member_number - row_number() over (partition by project, device_type, w order by member_number) isl from p where k > 1)
select project, 'multi-writer' check_name, case when max(k) > 3 then 'high' else 'medium' end severity, concat(device_type, min_by(written, member_number)) device, max(k) n, concat(cast(max(member_number) - min(member_number) + 1 as string), ' devices') detail from q group by project, device_type, w, isl""", ("occ",))
def _(v):
    return ch.multi_writer(fa.expand_members(v("occ")))


_AREA = "not exists (select 1 from areas a where a.project = x.project and a.device_type = x.device_type and x.number between a.start_value and a.end_value)"


@query("f3_external_value_source", f"""with {M1}, f as (select s.project, s.device source_device, s.device_type, s.number from occ s join occ d using (project, lddb, pos, op_index) where s.{_R} and d.{_W} and s.device <> d.device),
x as (select project, source_device, device_type, number, count(*) k from f where not exists (select 1 from m where m.project = f.project and m.member_device = f.source_device and m.{_W}) group by 1, 2, 3, 4)
select project, 'external-value-source' check_name, 'medium' severity, source_device device, k n, 'no writer and no area' detail from x where {_AREA}""", ("occ", "areas"))
def _(v):
    o = v("occ")
    return ch.external_value_source(fa.flow_edges(o), fa.expand_members(o), v("areas"))


@query("f4_alarm_quality", f"with {_ALARM} select project, 'alarm-quality' check_name, case when hold = 'SET' then 'high' else 'low' end severity, device, sets + resets n, case when hold = 'SET' then 'no reset' else 'not latched' end detail from al where (hold = 'SET' and resets = 0) or hold = 'OUT'", ("occ",))
def _(v):
    return ch.alarm_quality(iv.alarm_map(v("occ"), "red"))


@query("f5_unused_device", f"with {M1} select project, 'unused-device' check_name, 'low' severity, device, count(*) n, 'driven, never read' detail from occ o where role in ('c', 'SET') and access = 'write' and not exists (select 1 from m where m.project = o.project and m.member_device = o.device and m.{_R}) group by project, device", ("occ",))
def _(v):
    return ch.unused_device(v("occ"), fa.expand_members(v("occ")))


@query("f5_unused_commented", f"""with {M1}, sp as (select distinct project, device from comments_new where regexp_matches(all_text, 'red|RED')), dr as (select project, device, count(*) n from occ o where role in ('c', 'SET') and access = 'write' and device_type <> 'L'
  and not exists (select 1 from m where m.project = o.project and m.member_device = o.device and (m.{_R} or m.run_offset > 0)) group by project, device),
un as (select project, device, n, 'driven, never read' detail from dr union all select distinct project, device, 0, 'commented, never used' from comments_new c where all_text <> '' and device_type <> 'L' and not exists (select 1 from m where m.project = c.project and m.member_device = c.device))
select project, 'unused-device' check_name, 'low' severity, device, n, detail from un where not exists (select 1 from sp where sp.project = un.project and sp.device = un.device)""", ("occ", "comments_new"))
def _(v):
    return ch.unused_device(v("occ"), fa.expand_members(v("occ")), v("comments_new"), "red|RED", ("L",))


@query("f6_comment_conflict", "select project, 'comment-conflict' check_name, case when count(distinct device_type) > 1 then 'medium' else 'low' end severity, min(device) device, count(distinct device) n, lower(trim(all_text)) detail from comments where all_text <> '' group by project, lower(trim(all_text)) having count(distinct device) > 1 order by 5 desc, 6, 1 limit 1000", ("comments",))
def _(v):
    return ch.comment_conflict(v("comments"))


@query("f8_compare_type", """select project, 'compare-type' check_name, 'info' severity, device, count(*) n, 'sign of shared data' detail from operand_rows where opcode in ('LD<', 'LDD>') and device is not null and (device_type = 'W' or regexp_matches(comment, 'ring')) group by project, device
union all select project, 'compare-type', 'medium', concat('K', cast(value as string)), count(*), 'constant of more than 16 bits' from operand_rows where opcode = 'LD<' and value > 65535 group by project, value""", ("operand_rows",))
def _(v):
    o = v("operand_rows")
    return ch.compare_type(o, families(o), ["W"], "ring")


def families(operands: DataFrame) -> DataFrame:
    """Opcodes in use with their family and width."""
    op = F.col("opcode")
    return operands.select("opcode").distinct().select("opcode", F.when(op.isin("LD<", "LDD>"), "compare").when(op == "D/", "division").otherwise("other").alias("family"), F.when(op.startswith("LDD"), 2).otherwise(1).alias("words"))


@query("f9_div_by_zero", f"""with {MEMBERS} select project, 'div-by-zero' check_name, 'high' severity, 'K0' device, count(*) n, 'divisor is 0' detail from operand_rows where opcode = 'D/' and arg_index = 1 and value = 0 group by project
union all select project, 'div-by-zero', 'info', device, count(*), 'divisor without a writer' from operand_rows x where opcode = 'D/' and arg_index = 1 and device_type in ('D', 'W') and not exists (select 1 from m where m.project = x.project and m.member_device = x.device and {_W}) and {_AREA} group by project, device""", ("operand_rows", "areas"))
def _(v):
    o = v("operand_rows")
    return ch.div_by_zero(o, families(o), fa.expand_members(v("occ")), v("areas"), ["D", "W"])


@query("f10_operand_device", "select project, 'operand-device' check_name, 'high' severity, device, count(*) n, 'type not allowed' detail from occ where (opcode = 'BMOV' and device_type <> 'D') or (opcode = 'OUT' and device_type not in ('Y', 'M', 'L')) group by project, device", ("occ",))
def _(v):
    o = v("occ")
    allowed = o.select("opcode").distinct().where("opcode in ('BMOV', 'OUT')").select("opcode", F.when(F.col("opcode") == "BMOV", F.array(F.lit("D"))).otherwise(F.array(F.lit("Y"), F.lit("M"), F.lit("L"))).alias("allowed_types"))
    return ch.operand_device(o, allowed)


@query("f10_operand_place", "select project, 'operand-device' check_name, 'high' severity, device, count(*) n, 'type not allowed' detail from occ where (opcode = 'BMOV' and arg_index = 0 and device_type <> 'D') or (opcode = 'BMOV' and arg_index = 2 and device_type <> 'W') or (opcode = 'OUT' and arg_index = 1 and device_type not in ('Y', 'M')) group by project, device", ("occ",))
def _(v):
    o = v("occ")
    place = F.concat_ws(" ", "opcode", "arg_index")
    types = F.when(place == "BMOV 0", F.array(F.lit("D"))).when(place == "BMOV 2", F.array(F.lit("W"))).when(place == "OUT 1", F.array(F.lit("Y"), F.lit("M")))
    return ch.operand_device(o, o.select("opcode", "arg_index").distinct().withColumn("allowed_types", types).where("allowed_types is not null"))


@query("f11_width_mismatch", f"""with {MEMBERS} select h.project, 'width-mismatch' check_name, 'medium' severity, h.member_device device, count(distinct concat(h.lddb, '/', cast(h.pos as string))) n, 'inside a longer write' detail
from m h join m r on h.project = r.project and h.member_device = r.device and r.run_offset = 0 and r.device_type in ('D', 'W') where h.{_W} and h.run_offset > 0 and (h.lddb <> r.lddb or h.pos <> r.pos) group by h.project, h.member_device""", ("occ",))
def _(v):
    return ch.width_mismatch(fa.expand_members(v("occ")))


@query("f12_signed_compare", "select project, 'signed-compare' check_name, 'low' severity, device, count(*) n, 'constant out of range' detail from occ where opcode = 'DMOV' and (cast(substr(const_args, 2) as bigint) < 5 or cast(substr(const_args, 2) as bigint) > 45) group by project, device", ("occ",))
def _(v):
    o = v("occ")
    return ch.signed_compare(o, o.select("opcode").distinct().where("opcode = 'DMOV'").select("opcode", F.lit(5).alias("type_min"), F.lit(45).alias("type_max")))


@query("f12_unsigned_data", """select project, 'signed-compare' check_name, 'low' severity, device, count(*) n, 'constant out of range' detail from occ where opcode = 'MOV' and cast(substr(const_args, 2) as bigint) > 40 group by project, device
union all select project, 'signed-compare', 'info', device, count(*), 'unsigned data in a signed compare' from occ where opcode = 'MOV' and device_type = 'W' group by project, device""", ("occ",))
def _(v):
    o = v("occ")
    return ch.signed_compare(o, o.select("opcode").distinct().where("opcode in ('MOV', 'DMOV')").select("opcode", F.when(F.col("opcode") == "MOV", -41).otherwise(0).alias("type_min"), F.when(F.col("opcode") == "MOV", 40).otherwise(99).alias("type_max")), ("W",))


@query("f13_unwritten_contact", f"""with {M1}, x as (select project, device, device_type, number, count(*) filter (where role = 'a') a, count(*) k from occ o where role in ('a', 'b') and device_type <> 'X' and not exists (select 1 from m where m.project = o.project and m.member_device = o.device and m.{_W}) group by 1, 2, 3, 4)
select project, 'unwritten-contact' check_name, case when a > 0 then 'high' else 'medium' end severity, device, k n, case when a > 0 then 'never on' else 'always on' end detail from x where {_AREA}""", ("occ", "areas"))
def _(v):
    return ch.unwritten_contact(v("occ"), fa.expand_members(v("occ")), v("areas"))


@query("f14_disabled_rung", "select project, 'disabled-rung' check_name, 'medium' severity, device, count(distinct concat(lddb, '/', cast(pos as string))) n, 'contact never closes' detail from occ where role = 'a' and device in ('M10', 'M11', 'L12') group by project, device", ("occ",))
def _(v):
    return ch.disabled_rung(v("occ"), ["M10", "M11", "L12"])


@query("f14_always_on", "select project, 'disabled-rung' check_name, 'medium' severity, device, count(distinct concat(lddb, '/', cast(pos as string))) n, 'contact never closes' detail from occ where (role = 'a' and device in ('M10', 'L12')) or (role = 'b' and device in ('M18', 'L20')) group by project, device", ("occ",))
def _(v):
    return ch.disabled_rung(v("occ"), ["M10", "L12"], ("M18", "L20"))


def _f15(name: str, kinds: str) -> str:
    return f"with {M1} select project, '{name}' check_name, 'low' severity, member_device device, count(*) filter (where {_W}) n, 'written, never read' detail from m where device_type in ({kinds}) group by project, member_device having count(*) filter (where {_W}) > 0 and count(*) filter (where {_R}) = 0"


@query("f15_unread_coil", _f15("unread-coil", "'M', 'L'"), ("occ",))
def _(v):
    return ch.unread(fa.expand_members(v("occ")), True)


@query("f15_unread_word", _f15("unread-word", "'D', 'W'"), ("occ",))
def _(v):
    return ch.unread(fa.expand_members(v("occ")), False)


@query("f16_set_without_rst", _F16.format("occ"), ("occ",))
def _(v):
    return ch.set_without_rst(v("occ"))


_F18 = "select project, 'io-comment-gap' check_name, 'high' severity, device, count(*) n, 'no comment' detail from occ o where device_type in ('X', 'Y') and not exists (select 1 from comments c where c.project = o.project and c.device = o.device and all_text <> '') group by project, device"


@query("f18_io_comment_gap", _F18, ("occ", "comments"))
def _(v):
    return ch.io_comment_gap(v("occ"), v("comments"))


_RULES19 = {"actuator": "red|blue", "not_actuator": "gizmo", "safety": "old anvil", "position": "cold rod", "mode": "new bolt", "timer": "hot gear", "permissive": "old red"}


def _said(text: str) -> str:
    """The bits of ``text`` by the rules."""
    return " | ".join(f"(case when regexp_matches({text}, '{_RULES19[k]}') then {b} else 0 end)" for k, b in (("safety", 2), ("position", 4), ("mode", 8), ("timer", 16), ("permissive", 64)))


_TOLD = "array_to_string(list_filter([" + ", ".join(f"case when ({{0}} & {1 << i}) > 0 then '{k}' end" for i, k in enumerate(ch.SUPPORT)) + "], lambda x: x is not null), ',')"


_WEAK = f"""rg as (select project, lddb, pos, bit_or((case when role in ('a', 'b') and device_type = 'X' then 1 else 0 end) | (case when role = 'b' then 32 else 0 end) | {_said("concat_ws(' ', title, case when role in ('a', 'b') then comment end)")}) own, count(*) filter (where role in ('a', 'b')) contacts from occ group by 1, 2, 3),
dr as (select distinct project, lddb, pos, device from occ where {_W}), ak as (select distinct project, lddb, pos, device source from occ where role in ('a', 'b') and device_type in ('X', 'Y', 'M', 'L')),
nm as (select project, device, bit_or({_said("coalesce(comment, '')")}) nm from occ group by 1, 2), ab as (select project, device, bit_or(own) ab from dr join rg using (project, lddb, pos) group by 1, 2), m1 as (select project, device, nm | coalesce(ab, 0) m from nm left join ab using (project, device)),
eg as (select distinct ak.project, source, dr.device from ak join dr using (project, lddb, pos)),
x2 as (select eg.project, eg.device, bit_or(m) x from eg join m1 on m1.project = eg.project and m1.device = source group by 1, 2), m2 as (select m1.project, m1.device, m | coalesce(x, 0) m from m1 left join x2 using (project, device)),
x3 as (select eg.project, eg.device, bit_or(m) x from eg join m2 on m2.project = eg.project and m2.device = source group by 1, 2), m3 as (select m1.project, m1.device, m | coalesce(x, 0) m from m1 left join x3 using (project, device)),
up as (select ak.project, lddb, pos, bit_or(m) up from ak join m3 on m3.project = ak.project and m3.device = source group by 1, 2, 3),
co as (select distinct project, lddb, pos, device from occ where role = 'c' and device_type = 'Y' and regexp_matches(concat_ws(' ', device, comment, title), 'red|blue') and not regexp_matches(concat_ws(' ', device, comment, title), 'gizmo')),
j as (select co.*, own, contacts, coalesce(up, 0) up from co join rg using (project, lddb, pos) left join up using (project, lddb, pos)),
wk as (select * from j where contacts <= 1 or bit_count(own & 63) < 2)"""


@query("f19_interlock_candidates", f"""with {_WEAK}
select project, 'interlock-candidate' check_name, case when bit_count(up & 63) >= 3 and (up & 66) > 0 then 'low' when bit_count(up & 63) >= 1 then 'medium' else 'high' end severity, device, contacts n, concat(lddb, ':', cast(pos as string), ' own ', {_TOLD.format('own')}, ' upstream ', {_TOLD.format('up')}) detail from wk""", ("occ",))
def _(v):
    return ch.interlock_candidates(v("occ"), _RULES19)


@query("e11_maintainability", f"""with {_WEAK}, r as (select title, project, lddb, pos, count(*) n, max(case when parse_status = 'partial' then 1 else 0 end) p from occ group by 1, 2, 3, 4),
s as (select project, title, cast(sum(case when n >= 6 then 1 else 0 end) as bigint) large, cast(sum(p) as bigint) partial from r group by 1, 2),
d as (select project, title, count(*) missing from (select distinct project, title, device from occ) o where not exists (select 1 from comments c where c.project = o.project and c.device = o.device and all_text <> '') group by 1, 2),
k as (select project, title, count(*) dup from (select title, project, device from occ where {_W} group by 1, 2, 3 having count(distinct concat(lddb, '/', cast(pos as string))) > 1) x group by 1, 2),
ik as (select project, title, count(*) interlock from r join (select distinct project, lddb, pos from wk) w using (project, lddb, pos) group by 1, 2),
rk as (select project, title, count(*) risk from r join (select project, lddb, pos from occ group by 1, 2, 3 having count(*) >= 6 or bool_or(role in ('SET', 'RST')) or bool_or(parse_status = 'partial') or bool_or(opcode in ('MOV', 'DMOV', 'BMOV'))) w using (project, lddb, pos) group by 1, 2)
select *, large * 2 + partial * 4 + missing + dup * 3 + interlock * 3 + risk * 2 score from (select project, title, large, partial, coalesce(missing, 0) missing, coalesce(dup, 0) dup, coalesce(interlock, 0) interlock, coalesce(risk, 0) risk from s left join d using (project, title) left join k using (project, title) left join ik using (project, title) left join rk using (project, title)) x""", ("occ", "comments"))
def _(v):
    o = v("occ")
    return iv.maintainability(o, v("comments"), ch.interlock_rungs(o, _RULES19).select("project", "lddb", "pos").distinct(), iv.changeability(o).where("score > 0"))


_ALL = f"({_F1}) union all ({_F16.format('occ')}) union all ({_F18})"


def _all(v):
    return ch.duplicate_coil(v("occ"), cond(v), "gizmo").union(ch.set_without_rst(v("occ"))).union(ch.io_comment_gap(v("occ"), v("comments")))


@query("a7_findings_summary", f"select project, check_name, severity, count(*) findings, cast(sum(n) as bigint) places from ({_ALL}) x group by 1, 2, 3", ("occ", "comments"))
def _(v):
    return ch.findings_summary(_all(v))


# one check could not run in one project, and one that no score needs ran nowhere
_STATES = "st as (select project, check_name, case when check_name = 'link-range' or (check_name = 'io-comment-gap' and project = 'P3') then 'not_evaluated' else 'checked' end state from projects join (select unnest(['duplicate-coil', 'set-without-rst', 'io-comment-gap', 'link-range']) check_name) c on true)"
_SCORES = f"""f as ({_ALL}), {_STATES}, p as (select project, check_name, least(cast(sum(case severity when 'critical' then 12 when 'high' then 8 when 'medium' then 4 when 'low' then 2 else 1 end) as bigint), 35) pen, count(*) n from f group by 1, 2),
d as (select 'duplicate-coil' check_name, 'logic' dimension union all select 'set-without-rst', 'logic' union all select 'io-comment-gap', 'documentation' union all select 'link-range', 'logic'),
sc as (select project, dimension, case when not bool_or(state <> 'checked' and check_name <> 'link-range') then greatest(0, 100 - cast(sum(coalesce(pen, 0)) as bigint)) end score, cast(sum(coalesce(n, 0)) as bigint) findings from st join d using (check_name) left join p using (project, check_name) group by 1, 2)"""


def _health(v):
    f, checks = _all(v), ["duplicate-coil", "set-without-rst", "io-comment-gap", "link-range"]
    names = v("projects").select("project", F.explode(F.array(*map(F.lit, checks))).alias("check_name"))
    states = names.withColumn("state", F.when((F.col("check_name") == "link-range") | ((F.col("check_name") == "io-comment-gap") & (F.col("project") == "P3")), "not_evaluated").otherwise("checked"))
    dims = names.select("check_name").distinct().select("check_name", F.when(F.col("check_name") == "io-comment-gap", "documentation").otherwise("logic").alias("dimension"))
    return iv.health(f, dims, states, ("link-range",)), states


@query("e17_health", f"with {_SCORES} select * from sc", ("occ", "comments", "projects"))
def _(v):
    return _health(v)[0]


@query("e17_health_labels", f"""with {_SCORES}, l as (select project, min(score) low from sc group by 1), o as (select project, bool_or(state <> 'checked' and check_name <> 'link-range') open_ from st group by 1),
m as (select project, open_, case when low is null then 'NOT ASSESSED' when low >= 85 then 'GOOD' when low >= 70 then 'FAIR' when low >= 50 then 'POOR' else 'CRITICAL' end label from o left join l using (project))
select project, case when open_ then 'INCOMPLETE' else label end health, case when open_ then label end provisional from m""", ("occ", "comments", "projects"))
def _(v):
    scores, states = _health(v)
    return iv.health_labels(scores, states, ("link-range",))


@query("e17_top_risks", f"""with f as ({_ALL}), p as (select *, cast(case severity when 'critical' then 120 when 'high' then 90 when 'medium' then 55 when 'low' then 25 else 12 end + case check_name when 'duplicate-coil' then 22 else 0 end + case when device like 'Y%' then 18 else 0 end + least(n, 10) as bigint) priority from f)
select * from (select *, row_number() over (partition by project order by priority desc, check_name, device, detail) rank from p) x where rank <= 25""", ("occ", "comments"))
def _(v):
    return iv.top_risks(_all(v), {"duplicate-coil": 22}, 25)


# the list of states from the weakest up
_K3 = "case when number % 97 = 0 then 'not_evaluated' when number % 89 = 0 then 'unsupported' when parse_status = 'partial' and range_len > 3 then 'truncated' when parse_status = 'partial' then 'partial' when number % 83 = 0 then 'no_measurement' else 'checked' end"


@query("k3_worst_state", f"""with s as (select project, lddb, {_K3} state, opcode, parse_status from occ)
select project, lddb, case when bool_or(state = 'not_evaluated') then 'not_evaluated' when bool_or(state = 'unsupported') then 'unsupported' when bool_or(state = 'partial') then 'partial' when bool_or(state = 'truncated') then 'truncated' when bool_or(state = 'no_measurement') then 'no_measurement' else 'checked' end state,
  coalesce(string_agg(distinct case when parse_status = 'partial' then opcode end, '; ' order by case when parse_status = 'partial' then opcode end), '') constraints from s group by 1, 2""", ("occ",))
def _(v):
    s = v("occ").select("project", "lddb", F.expr(_K3).alias("state"), F.when(F.col("parse_status") == "partial", F.col("opcode")).otherwise("").alias("reason"))
    return iv.worst_state(s, ["project", "lddb"])
