"""Queries for program order, links between projects, and walks over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ch
from ..operators import facts as fa
from ..operators import graph as gr
from ..operators import inventory as iv
from ..operators import links as li
from ..operators import order as od
from .q_checks import COND, M1, cond
from .q_facts import MEMBERS
from .q_logs import _G4
from ..sources.views import with_views
from .registry import query

# in the SQL a branch is a sorted list of literals as "device state"
_CLASH = "len(list_intersect({0}, list_transform({0}, lambda q: concat(substr(q, 1, length(q) - 1), case when right(q, 1) = 'a' then 'b' else 'a' end)))) > 0"
_W = "access in ('write', 'both')"
_R = "access in ('read', 'both')"


@query("g1_pou_sequence", """with f as (select concat('P', cast(k as string)) project, n_nationkey program, n_nationkey * 3 + k file_order from nation join projects on true where (n_nationkey + k) % 4 > 0)
select concat('P', cast(o_orderkey % 4 as string)) project, concat('L', cast(o_orderkey as string)) pou, coalesce(cast(file_order as int), 0) * 100000 + o_custkey sequence, case when file_order is null then 'fallback' else 'exec' end confidence
from orders left join f on f.project = concat('P', cast(o_orderkey % 4 as string)) and o_orderkey % 25 = f.program""", ("projects",))
def _(v):
    pous = v("orders").select(F.concat(F.lit("P"), (F.col("o_orderkey") % 4).cast("string")).alias("project"), F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("pou"), (F.col("o_orderkey") % 25).alias("program"), F.col("o_custkey").alias("link_index"))
    files = v("nation").join(v("projects"), (F.col("n_nationkey") + F.col("k")) % 4 > 0)
    return od.pou_sequence(pous, files.select("project", F.col("n_nationkey").cast("long").alias("program"), (F.col("n_nationkey") * 3 + F.col("k")).alias("file_order")))


_BITS = ["X", "Y", "M", "L"]


@query("g2_scan_order_pairs", f"""with {M1}, p as (select project, member_device, device_type, pou, pos, bool_or({_W}) w, bool_or({_R}) r from m group by 1, 2, 3, 4, 5), q as (select p.*, seq from p left join pou_order o on p.project = o.project and p.pou = o.pou),
t as (select project, member_device, bool_or({_W} and device_type in ('X', 'Y', 'M', 'L') and opcode = 'SET') a, bool_or(device_type in ('X', 'Y', 'M', 'L') and regexp_matches(concat_ws(' ', comment, case when {_W} then concat_ws(' ', title, opcode) end), 'gizmo')) b, bool_or({_W} and opcode = 'BMOV') c from m group by 1, 2),
own as (select project, member_device, bool_or(w and r) d from p group by 1, 2),
z as (select r.project, r.member_device, r.device_type, r.pou, r.pos, w.pou wp, w.pos wq, w.seq ws,
    case when w.pou = r.pou then case when w.pos < r.pos then 'fresh' when w.pos > r.pos then 'stale' else 'same' end when w.seq < r.seq then 'fresh' when w.seq > r.seq then 'stale' else 'unknown' end seen
  from q r join q w on r.project = w.project and r.member_device = w.member_device where r.r and w.w),
n as (select project, member_device, device_type, pou, pos, max(case when seen = 'fresh' then {{'a': case when wp = pou then 1 else 0 end, 'b': ws, 'c': wq, 'd': wp}} end) f, min(case when seen = 'stale' then {{'a': case when wp = pou then 0 else 1 end, 'b': ws, 'c': wq, 'd': wp}} end) s,
    count(*) filter (where seen = 'fresh') fresh, count(*) filter (where seen = 'stale') stale, count(*) filter (where seen = 'same') same_row, count(*) filter (where seen = 'unknown') as unknown from z group by 1, 2, 3, 4, 5)
select n.project, n.member_device, pou, pos, f.d before_pou, f.c before_pos, s.d after_pou, s.c after_pos, fresh, stale, same_row, unknown, case when a or b or c or d then concat_ws(',', case when a then 'one-scan-pulse-bit' end, case when b then 'pulse-comment-bit' end, case when c then 'edge-executed-holding-write' end, case when d then 'self-row' end) else 'non-pulse' end traits,
  case when stale > 0 then case when a or b then 'HIGH' when c then 'LOW' when device_type in ('X', 'Y', 'M', 'L') then 'MEDIUM' else 'LOW' end when unknown > 0 then 'UNKNOWN' else 'OK' end severity
from n join t using (project, member_device) join own using (project, member_device)""", ("occ", "pou_order"))
def _(v):
    m = fa.expand_members(v("occ"))
    return od.scan_order_readers(od.trait_marks(m, _BITS, ["SET"], ["BMOV"], "gizmo"), v("pou_order"), None, _BITS)


_DEV = f"""dv as (select project, member_device device, device_type, max_by(comment, concat(lpad(cast(pos as string), 12, '0'), occ_id)) filter (where coalesce(comment, '') <> '') comment, bool_or({_R}) has_read, bool_or({_W}) has_write, string_agg(distinct title, ',' order by title) titles from m group by 1, 2, 3)"""
_LINK = """lk as (select a.project project_a, a.device device_a, b.project project_b, b.device device_b, 'exact' link_type,
  case when a.has_write and b.has_read and b.has_write and a.has_read then 'both' when a.has_write and b.has_read then 'A_to_B' else 'B_to_A' end direction, a.comment as role
  from dv a join dv b on a.device = b.device and a.project < b.project where a.device_type = 'W' and ((a.has_write and b.has_read) or (b.has_write and a.has_read)))"""


def _links(v):
    return li.exact_links(li.project_devices(fa.expand_members(v("occ"))), ["W"])


@query("h1_project_devices", f"with {M1}, {_DEV} select * from dv", ("occ",))
def _(v):
    return li.project_devices(fa.expand_members(v("occ")))


@query("h2_exact_links", f"with {M1}, {_DEV}, {_LINK} select * from lk", ("occ",))
def _(v):
    return _links(v)


_ROLE = """rd as (select project, lower(comment) as role, min(device) writer from dv where has_write and comment <> '' group by 1, 2),
rl as (select a.project project_a, a.writer device_a, b.project project_b, b.device device_b, 'role' link_type, 'A_to_B' direction, a.role as role from rd a join dv b on a.role = lower(b.comment) and a.project <> b.project where not b.has_write)"""


@query("h3_role_links", f"with {M1}, {_DEV}, {_ROLE} select * from rl", ("occ",))
def _(v):
    d = li.project_devices(fa.expand_members(v("occ")))
    p = d.select("project").distinct()
    adjacency = p.select(F.col("project").alias("project_a")).join(p.select(F.col("project").alias("project_b")), F.col("project_a") != F.col("project_b"))
    return li.role_links(d, adjacency, F.lower("comment"))


# role links of all pairs of projects, those from a later project turned round; what is known of each follows from its names
_CANDIDATES = f"""{_ROLE}, nm as (select distinct member_device device, member_number number from m),
ca as (select project_a, device_a, project_b, device_b, link_type, direction, role from rl where project_a < project_b union all select project_b, device_b, project_a, device_a, link_type, 'B_to_A', role from rl where project_a > project_b
  union all select project_a, device_a, project_b, device_b, link_type, direction, role from lk),
cb as (select ca.*, case length(device_a) % 2 when 0 then 'high' else 'medium' end confidence, concat(role, case when length(device_b) % 2 = 0 then concat(' to ', project_b) else '' end) evidence from ca),
oc as (select cb.*, case direction when 'A_to_B' then project_b when 'B_to_A' then project_a end rp, case direction when 'A_to_B' then device_b when 'B_to_A' then device_a end rdev, case direction when 'A_to_B' then x.number - y.number when 'B_to_A' then y.number - x.number end o from cb join nm x on x.device = device_a join nm y on y.device = device_b),
vt as (select project_a, project_b, direction, o, count(*) votes from oc where link_type = 'role' and o is not null group by 1, 2, 3, 4),
dm as (select project_a, project_b, direction, o, votes from (select *, row_number() over (partition by project_a, project_b, direction order by votes desc, abs(o), o) rn from vt) q where rn = 1 and votes > 1)"""


def _candidates(v):
    d = li.project_devices(fa.expand_members(v("occ")))
    p = d.select("project").distinct()
    adjacency = p.select(F.col("project").alias("project_a")).join(p.select(F.col("project").alias("project_b")), F.col("project_a") != F.col("project_b"))
    r = li.role_links(d, adjacency, F.lower("comment"))
    turned = r.where("project_a > project_b").select(F.col("project_b").alias("project_a"), F.col("device_b").alias("device_a"), F.col("project_a").alias("project_b"), F.col("device_a").alias("device_b"), "link_type", F.lit("B_to_A").alias("direction"), "role")
    both = r.where("project_a < project_b").unionByName(turned).unionByName(li.exact_links(d, ["W"]))
    return both.withColumn("confidence", F.when(F.length("device_a") % 2 == 0, "high").otherwise("medium")).withColumn("evidence", F.concat("role", F.when(F.length("device_b") % 2 == 0, F.concat(F.lit(" to "), "project_b")).otherwise("")))


@query("h4_dominant_offsets", f'with {M1}, {_DEV}, {_LINK}, {_CANDIDATES} select project_a, project_b, direction, o as "offset", votes from dm', ("occ",))
def _(v):
    return li.dominant_offsets(_candidates(v))


@query("h4_dedupe_links", f"""with {M1}, {_DEV}, {_LINK}, {_CANDIDATES}, k as (select oc.*, dm.o is not null in_band from oc left join dm on dm.project_a = oc.project_a and dm.project_b = oc.project_b and dm.direction = oc.direction and dm.o = oc.o),
r as (select *, row_number() over (partition by role, direction, rp, rdev order by case confidence when 'high' then 1 when 'medium' then 2 else 3 end, in_band desc, contains(lower(evidence), lower(rp)) desc, project_a, device_a, project_b, device_b) rk from k where link_type = 'role' and rdev is not null)
select project_a, device_a, project_b, device_b, link_type, direction, role, confidence, evidence, in_band from r where rk = 1 union all select project_a, device_a, project_b, device_b, link_type, direction, role, confidence, evidence, in_band from k where not (link_type = 'role' and rdev is not null)""", ("occ",))
def _(v):
    return li.dedupe_links(_candidates(v))


@query("h5_missing_pairs", f"with {M1}, {_DEV}, {_LINK} select distinct a.project project_a, b.project project_b from occ a, occ b where a.project <> b.project and not exists (select 1 from lk where lk.project_a = a.project and lk.project_b = b.project)".replace("from occ a, occ b", "from (select distinct project from occ) a, (select distinct project from occ) b"), ("occ",))
def _(v):
    p = v("occ").select("project").distinct()
    required = p.select(F.col("project").alias("project_a")).join(p.select(F.col("project").alias("project_b")), F.col("project_a") != F.col("project_b"))
    return li.missing_pairs(_links(v), required)


@query("h6_handshake_signals", f"""with {M1}, {_DEV}, {_LINK}, w as (select project, member_device, count(distinct concat(lddb, '/', cast(pos as string))) send_rungs, min(pos) first_send from m where {_W} group by 1, 2), r as (select project, member_device, count(distinct concat(lddb, '/', cast(pos as string))) receive_rungs from m where {_R} group by 1, 2)
select project_a, device_a, project_b, device_b, send_rungs, first_send, receive_rungs from lk join w on project_a = w.project and device_a = w.member_device join r on project_b = r.project and device_b = r.member_device where direction <> 'B_to_A'""", ("occ",))
def _(v):
    return li.handshake_signals(_links(v), fa.expand_members(v("occ")))


@query("h7_data_groups", f"""with {M1}, {_DEV}, {_LINK}, i as (select distinct project_b project, device_b device from lk where direction <> 'B_to_A'),
g as (select project, lddb, pos, count(distinct device) n, string_agg(distinct device, ',' order by device) devices from occ join i using (project, device) where opcode in ('MOV', 'DMOV', 'BMOV') and {_R} group by 1, 2, 3)
select * from (select *, row_number() over (partition by project order by n desc, lddb, pos) rank from g) x where rank <= 20""", ("occ",))
def _(v):
    return li.data_groups(_links(v), v("occ"), 20)


@query("d11_cross_where_used", f"""with {M1}, {_DEV}, {_LINK}, t as (select project_a from_project, device_a from_device, project_b project, device_b member_device from lk union select project_b, device_b, project_a, device_a from lk)
select t.*, u.uses, u.writes from t join (select project, member_device, count(*) uses, count(*) filter (where {_W}) writes from m group by 1, 2) u using (project, member_device)""", ("occ",))
def _(v):
    return li.cross_where_used(fa.expand_members(v("occ")), _links(v))


@query("f7_link_range", f"""with {M1}, {_DEV}, {_LINK} select project, 'link-range' check_name, 'high' severity, member_device device, count(*) n, 'written on the receiving side' detail from m where {_W} and exists (select 1 from lk where direction = 'A_to_B' and project_b = m.project and device_b = m.member_device) group by project, member_device""", ("occ",))
def _(v):
    return ch.link_range(_links(v), fa.expand_members(v("occ")))


_EDGES = f"""e as (select distinct c.project, c.device source, d.device target from occ c join occ d on c.project = d.project and c.lddb = d.lddb and c.pos = d.pos where c.role in ('a', 'b') and d.{_W} and c.device <> d.device)"""


def _recursive(sql: str) -> str:
    return "with recursive" + with_views(sql, "occ")[4:]


def _walk(frm: str, to: str, depth: int, seeds: str) -> str:
    return f"""r(seed, project, device, depth) as (select seed, project, device, 0 from ({seeds}) s union select r.seed, r.project, e.{to}, r.depth + 1 from r join e on e.project = r.project and e.{frm} = r.device where r.depth < {depth}),
w as (select seed, project, device, min(depth) depth from r group by 1, 2, 3)"""


_SEEDS = "select distinct device seed, project, device from occ where number in (8, 10, 11) and role in ('a', 'b')"
_MEMBER_EDGES = f"""e as (select distinct c.project, c.member_device source, d.member_device target from m c join m d on c.project = d.project and c.lddb = d.lddb and c.pos = d.pos where c.role in ('a', 'b') and d.{_W} and c.member_device <> d.member_device
union select c.project, c.member_device, d.member_device from m c join m d on c.project = d.project and c.lddb = d.lddb and c.pos = d.pos and c.op_index = d.op_index where c.{_R} and d.{_W} and c.member_device <> d.member_device)"""


def _seeds(v):
    return v("occ").where("number in (8, 10, 11) and role in ('a', 'b')").select(F.col("device").alias("seed"), "project", "device").distinct()


@query("d8_reach", _recursive(f"with {MEMBERS}, {_MEMBER_EDGES}, {_walk('source', 'target', 3, _SEEDS)} select seed, project, device, depth, coalesce((select min(p.device) from w p join e on e.project = p.project and e.source = p.device where p.seed = w.seed and p.project = w.project and e.target = w.device and p.depth = w.depth - 1), '') parent from w"))
def _(v):
    return gr.reach(gr.device_edges(fa.expand_members(v("occ"))), _seeds(v), 3)[0]


# what reaches itself, and the smallest device that it reaches and that reaches it
_RING = """t(project, a, b) as (select project, source, target from e union select t.project, t.a, e.target from t join e on e.project = t.project and e.source = t.b),
ring as (select x.project, x.a device, min(least(x.a, x.b)) ring from t x join t y on x.project = y.project and x.a = y.b and x.b = y.a group by 1, 2)"""
_UP = "select distinct device seed, project, device from occ where number in (9, 17, 25)"


@query("d9_trace_upstream", _recursive(f"""with {_EDGES}, {_walk('target', 'source', 2, _UP)}, {_RING}, own as (select distinct project, device from (select project, lddb, pos, device from occ group by 1, 2, 3, 4 having bool_or(role in ('a', 'b')) and bool_or({_W})) x), s as (select project, device, count(distinct case when {_W} then concat(lddb, '/', cast(pos as string)) end) drivers, count(*) filter (where role = 'c') coils, count(*) filter (where role in ('SET', 'RST')) latches from occ group by 1, 2)
select seed, w.project, w.device, depth, coalesce((select min(p.device) from w p join e on e.project = p.project and e.target = p.device where p.seed = w.seed and p.project = w.project and e.source = w.device and p.depth = w.depth - 1), '') parent, drivers = 0 terminal, exists (select 1 from own where own.project = w.project and own.device = w.device) self_reference, coils > 1 multi_coil, coils > 0 and latches > 0 mixed, ring is not null as cycle, coalesce(ring, '') ring from w left join ring using (project, device) join s on w.project = s.project and w.device = s.device"""))
def _(v):
    o = v("occ")
    return gr.trace_upstream(o, o.where("number in (9, 17, 25)").select(F.col("device").alias("seed"), "project", "device").distinct(), 2)


@query("d9_top_conditions", _recursive(f"""with {_EDGES}, {_walk('target', 'source', 2, _UP)}, dr as (select distinct w.seed, o.project, o.lddb, o.pos from w join occ o on o.project = w.project and o.device = w.device where o.{_W}),
u as (select seed, dr.project, device, count(*) rungs from dr join (select distinct project, lddb, pos, device from occ where role in ('a', 'b')) c on c.project = dr.project and c.lddb = dr.lddb and c.pos = dr.pos group by 1, 2, 3)
select * from (select *, row_number() over (partition by seed, project order by rungs desc, device) rank from u) x where rank <= 5"""))
def _(v):
    o = v("occ")
    seeds = o.where("number in (9, 17, 25)").select(F.col("device").alias("seed"), "project", "device").distinct()
    return gr.top_conditions(gr.reach(gr.rung_edges(o), seeds, 2, forward=False)[0], o, 5)


_FLOW = f"""e as (select distinct s.project, s.device source, d.device target from occ s join occ d on s.project = d.project and s.lddb = d.lddb and s.pos = d.pos and s.op_index = d.op_index where s.{_R} and d.{_W} and s.device <> d.device)"""


@query("d10_value_sources", _recursive(f"with {_FLOW}, {_walk('target', 'source', 2, _UP)} select seed, project, device, depth, not exists (select 1 from e where e.project = w.project and e.target = w.device) terminal from w"))
def _(v):
    o = v("occ")
    return gr.value_sources(fa.flow_edges(o), o.where("number in (9, 17, 25)").select(F.col("device").alias("seed"), "project", "device").distinct(), 2)


#: Rounds of the check's SQL; the operator goes on until none adds a fact.
_ROUNDS = 16
_HEAD = f"""loose as (select project, device_type, coalesce(bool_or(access <> 'read') filter (where access = 'ref' or range_len <= 0), false) lw, coalesce(bool_or(access <> 'write') filter (where access = 'ref' or range_len <= 0), false) lr from chain_occ group by 1, 2),
sg as (select project, device, min(role) role, min(lddb) lddb, min(pos) pos, min(device_type) device_type, min(number) number from chain_occ where {_W} group by 1, 2 having count(*) = 1 and min(role) = 'c' and min(range_len) = 1),
rd as (select project, device, min(lddb) l1, max(lddb) l2, min(pos) p from chain_occ where {_R} group by 1, 2),
ca as (select s.project, s.device, s.lddb, s.pos from sg s join loose using (project, device_type) left join rd using (project, device)
  where s.device_type in ('X', 'Y', 'M', 'L') and not lw and not lr and (l1 is null or (l1 = s.lddb and l2 = s.lddb and p > s.pos))
    and not exists (select 1 from chain_occ o where o.project = s.project and o.lddb = s.lddb and o.pos = s.pos and o.parse_status <> 'exact')
    and not exists (select 1 from areas a where a.project = s.project and a.device_type = s.device_type and s.number between a.start_value and a.end_value)),
cc as (select q.* from chain_cond q join ca on ca.project = q.project and ca.device = q.out_device),
k0 as (select distinct project, device, number as value, 0 as round, 0 as depth, [device] roots, cast([] as varchar[]) chain from chain_occ where device_type = 'SM')"""


def _round(n: int) -> str:
    """One more round after ``k{n - 1}``."""
    return f"""l{n} as (select cc.*, case required when 'a' then value else 1 - value end t, k.depth, k.roots, k.chain from cc left join k{n - 1} k on k.project = cc.project and k.device = cc.device),
b{n} as (select project, out_device, branch, min(t) t0, count(*) filter (where t is null) o, min(case when t = 0 then {{'depth': depth, 'device': device, 'required': required, 'roots': roots, 'chain': chain}} end) f, max(depth) deep, list_sort(list_distinct(flatten(list(roots)))) roots, list_sort(list_distinct(flatten(list(chain)))) chain from l{n} group by 1, 2, 3),
c{n} as (select project, out_device, branch, case when t0 = 0 then 0 when o = 0 then 1 end b, case when t0 = 0 then f.depth when o = 0 then deep end depth, case when t0 = 0 then f.roots when o = 0 then roots end roots, case when t0 = 0 then f.chain when o = 0 then chain end chain from b{n}),
d{n} as (select project, out_device, max(b) hi, count(*) filter (where b is null) o, min(case when b = 1 then {{'depth': depth, 'branch': branch, 'roots': roots, 'chain': chain}} end) y, max(depth) deep, list_sort(list_distinct(flatten(list(roots) filter (where roots is not null)))) roots, list_sort(list_distinct(flatten(list(chain) filter (where chain is not null)))) chain from c{n} group by 1, 2),
k{n} as (select * from k{n - 1} union all select project, out_device, case when hi = 1 then 1 else 0 end, {n}, 1 + case when hi = 1 then y.depth else deep end, case when hi = 1 then y.roots else roots end, list_sort(list_distinct(list_append(case when hi = 1 then y.chain else chain end, out_device)))
  from d{n} d where (hi = 1 or (o = 0 and hi = 0)) and not exists (select 1 from k{n - 1} k where k.project = d.project and k.device = d.out_device))"""


_CONSTANTS = f"with {_HEAD}, " + ", ".join(_round(n) for n in range(1, _ROUNDS + 1))


def _constants(v):
    o = v("chain_occ")
    facts = o.where("device_type = 'SM'").select("project", "device", F.col("number").alias("value")).distinct()
    return gr.propagate_constants(v("chain_cond"), facts, gr.constant_candidates(o, _BITS, v("areas")))


@query("f17_constants", f"{_CONSTANTS} select project, device, value, round, depth, array_to_string(roots, ',') roots, array_to_string(chain, ',') chain from k{_ROUNDS}", ("chain_occ", "chain_cond", "areas"))
def _(v):
    return _constants(v).withColumn("roots", F.array_join("roots", ",")).withColumn("chain", F.array_join("chain", ","))


@query("f17_constant_findings", f"""{_CONSTANTS}, x as (select * from k{_ROUNDS} where round > 0), ty as (select distinct project, device, device_type from chain_occ)
select project, case when device_type = 'Y' then 'constant-output' else 'constant-device' end category, device, case when value = 1 then 'ON' else 'OFF' end state, cast(null as varchar) lddb, cast(null as bigint) pos, depth, array_to_string(roots, ',') roots from x left join ty using (project, device)
union all select project, case when (role = 'a') = (value = 1) then 'redundant-contact' else 'dead-contact' end, device, case when (role = 'a') = (value = 1) then 'ALWAYS_TRUE' else 'ALWAYS_FALSE' end, c.lddb, c.pos, depth, array_to_string(roots, ',') from (select distinct project, device, role, lddb, pos from chain_occ where role in ('a', 'b')) c join x using (project, device)""", ("chain_occ", "chain_cond", "areas"))
def _(v):
    return gr.constant_findings(_constants(v), v("chain_occ"), ["Y"]).withColumn("roots", F.array_join("roots", ","))


@query("g8_change_impact", f"""with {MEMBERS}, {_MEMBER_EDGES}, ch as (select concat_ws('/', project, lddb, guid) seed, project, lddb, guid from ({_G4}) g where change in ('logic', 'removed', 'added')),
wr as (select distinct project, lddb, concat('g', cast(cast(floor(pos / 4) as bigint) as string)) guid, member_device device from m where {_W}), w as (select distinct seed, wr.project, device from wr join ch on ch.project = wr.project and ch.lddb = wr.lddb and ch.guid = wr.guid),
r as (select distinct w.seed, w.project, e.target device from w join e on e.project = w.project and e.source = w.device), f as (select *, 0 depth from w union all select r.*, 1 from r where not exists (select 1 from w where w.seed = r.seed and w.project = r.project and w.device = r.device)),
nx as (select distinct f.seed, f.project, e.target device from f join e on e.project = f.project and e.source = f.device where depth = 1), mo as (select distinct seed from nx where not exists (select 1 from f where f.seed = nx.seed and f.project = nx.project and f.device = nx.device)),
oy as (select distinct project, member_device device from m where device_type = 'Y'), al as (select distinct project, device from occ where regexp_matches(comment, 'red') and device_type in ('M', 'L', 'Y') and {_W})
select f.seed, count(*) filter (where depth = 0) written, count(*) filter (where depth > 0) reached, max(depth) deepest, count(oy.device) outputs, count(al.device) alarms, case when any_value(mo.seed) is not null then 'truncated' else 'checked' end state
from f left join oy using (project, device) left join al using (project, device) left join mo on mo.seed = f.seed group by 1""", ("occ", "rungs_new"))
def _(v):
    from ..operators.diff import diff_rungs

    changed = diff_rungs(v("rungs_old"), v("rungs_new")).where("change in ('logic', 'removed', 'added')").withColumn("change_id", F.concat_ws("/", "project", "lddb", "guid"))
    # occurrences are dealt by rung before they are expanded, and read once
    alarm = F.col("comment").rlike("red") & F.col("device_type").isin("M", "L", "Y") & fa.writes(F.col("access"))
    o = v("occ").select(*fa.RUNG, "op_index", "device", "device_type", "number", "range_len", "access", F.when(F.col("role").isin("a", "b"), F.col("role")).alias("role"), F.when(alarm, True).alias("alarm")).repartition(*fa.RUNG)
    links = gr.stored(gr.rung_links(fa.expand_members(o), output=F.col("device_type") == "Y", alarm=F.col("alarm") & (F.col("run_offset") == 0)))
    w = links.select("project", "lddb", F.concat(F.lit("g"), F.floor(F.col("pos") / 4).cast("string")).alias("guid"), F.col("writes").alias("devices"))
    kind = lambda c: links.select("project", F.explode(c).alias("device"), F.lit(c).alias("kind"))
    return gr.change_impact(changed.select("change_id", "project", "lddb", "guid"), w, w, gr.fans(links), 1, kind("output").union(kind("alarm")))


# each output with the outputs of the next rung of its program that drives a bit
@query("k1_interlock_pairs", f"""with {COND}, rg as (select project, lddb, pos, lead(pos) over (partition by project, lddb order by pos) pos_b from (select distinct project, lddb, pos from cond) x),
br as (select project, lddb, pos, out_device, lits from (select project, lddb, pos, out_device, branch, list_sort(list(distinct concat(device, ' ', required))) lits from cond group by 1, 2, 3, 4, 5) x where not ({_CLASH.format('lits')})), bd as (select distinct * from br),
p as (select distinct r.project, r.lddb, r.pos pos_a, a.out_device out_a, r.pos_b, b.out_device out_b from rg r join bd a on a.project = r.project and a.lddb = r.lddb and a.pos = r.pos join bd b on b.project = r.project and b.lddb = r.lddb and b.pos = r.pos_b),
x as (select p.*, list_sort(list_distinct(list_concat(a.lits, b.lits))) lits from p join bd a on a.project = p.project and a.lddb = p.lddb and a.pos = pos_a and a.out_device = out_a join bd b on b.project = p.project and b.lddb = p.lddb and b.pos = p.pos_b and b.out_device = out_b),
y as (select project, lddb, pos_a, out_a, pos_b, out_b, count(*) pairs, min(lits) filter (where not ({_CLASH.format('lits')})) w from x group by 1, 2, 3, 4, 5, 6)
select project, lddb, pos_a, out_a, pos_b, out_b, case when pairs <= 12 then w is null end exclusive, pairs, case when pairs <= 12 and w is not null then replace(array_to_string(w, ','), ' ', '=') else '' end witness from y""", ("occ",))
def _(v):
    from pyspark.sql import Window

    from ..operators.conditions import interlock_pairs

    c = cond(v)
    outs = c.select("project", "lddb", "pos", "out_device").distinct()
    rungs = outs.select("project", "lddb", "pos").distinct().withColumn("pos_b", F.lead("pos").over(Window.partitionBy("project", "lddb").orderBy("pos")))
    a = outs.join(rungs, ["project", "lddb", "pos"]).select("project", "lddb", F.col("pos").alias("pos_a"), F.col("out_device").alias("out_a"), "pos_b")
    pairs = a.join(outs.select("project", "lddb", F.col("pos").alias("pos_b"), F.col("out_device").alias("out_b")), ["project", "lddb", "pos_b"])
    return interlock_pairs(c, pairs, ["project", "lddb", "pos", "out_device"], 12)
