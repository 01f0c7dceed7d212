"""Fleet-shaped views over a star schema of order tables: four projects, whose
programs have the same names and whose devices have comments, areas and log
records of their own. Programs have some hundreds of rungs, so their number
grows with the tables.

Each view is one SELECT that Spark and other engines read alike, so a query and
its check in another engine start from the same rows. ``{name}`` stands for a
table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: Views in order of use: occurrences of devices in rungs, device comments, areas, and so on.
VIEWS = {
    "occ": """
select concat('P', cast(l_orderkey % 4 as string)) project,
  concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) occ_id,
  concat('L', cast(cast(floor(l_orderkey / 200) as int) as string)) lddb, l_orderkey pos, cast(floor(l_linenumber / 3) as int) op_index, l_linenumber % 3 arg_index,
  concat(dt, case when dt in ('X', 'Y', 'W') then hex(l_partkey) else cast(l_partkey as string) end) device, dt device_type, l_partkey number,
  case when dt in ('D', 'W') then 1 + q % 4 else 1 end range_len, acc access,
  case when dt in ('D', 'W') then wop when acc = 'read' then case when l_linestatus = 'O' then 'a' else 'b' end when q % 5 = 0 then 'SET' when q % 5 = 1 then 'RST' else 'c' end role,
  case when dt in ('D', 'W') then wop when acc = 'read' then 'LD' when q % 5 = 0 then 'SET' when q % 5 = 1 then 'RST' else 'OUT' end opcode,
  concat('K', cast(q as string)) const_args, concat('L', cast(cast(floor(l_orderkey / 200) as int) as string)) pou, l_linenumber step, o_orderpriority title, p_name comment,
  case when l_tax > 0.07 then 'partial' else 'exact' end parse_status
from (select l.*, o_orderpriority, p_name, cast(l_quantity as int) q,
    case l_partkey % 8 when 0 then 'X' when 1 then 'Y' when 2 then 'M' when 3 then 'M' when 4 then 'L' when 5 then 'D' when 6 then 'D' else 'W' end dt,
    case l_returnflag when 'A' then 'read' when 'R' then 'write' else 'both' end acc,
    case l_linenumber % 3 when 0 then 'MOV' when 1 then 'DMOV' else 'BMOV' end wop
  from {lineitem} l join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey) base""",
    # a rung for each order: one coil, and contacts of the rungs before it or of two special devices
    "chain_occ": """
select project, concat(cast(pos as string), '-', cast(step as string), '-', cast(number as string), role) occ_id, concat('L', cast(cast(floor(pos / 200) as int) as string)) lddb, pos, concat(device_type, cast(number as string)) device, device_type, number, 1 range_len, access, role, step, case when pos % 37 = 0 then 'partial' else 'exact' end parse_status
from (select concat('P', cast(o_orderkey % 4 as string)) project, o_orderkey pos, case when o_orderkey % 29 = 0 then 'Y' else 'M' end device_type, o_orderkey number, 'write' access, case when o_orderkey % 23 = 0 then 'SET' else 'c' end role, 0 step from {orders}
  union all select concat('P', cast(l_orderkey % 4 as string)), l_orderkey, case when l_partkey % 5 < 2 then 'SM' when n % 29 = 0 then 'Y' else 'M' end, case when l_partkey % 5 < 2 then l_partkey % 5 else n end, 'read', case when l_linestatus = 'O' then 'a' else 'b' end, l_linenumber
    from (select *, case when l_suppkey % 3 = 0 then l_orderkey - 32 when l_orderkey % 8 >= 4 then l_orderkey - 4 else l_orderkey - 28 end n from {lineitem}) l) base""",
    "chain_cond": "select distinct o.project, o.lddb, o.pos, o.device out_device, c.step % 2 branch, c.device, c.role as required from {chain_occ} o join {chain_occ} c on o.project = c.project and o.pos = c.pos where o.access = 'write' and c.access = 'read'",
    "operand_rows": """
select project, lddb, pos, op_index, case opcode when 'MOV' then 'LD<' when 'DMOV' then 'D/' when 'BMOV' then 'LDD>' else opcode end opcode, case when opcode = 'DMOV' then 3 else 2 end argc, 0 arg_index, device, device_type, number, cast(null as bigint) value, comment from {occ}
union all select project, lddb, pos, op_index, case opcode when 'MOV' then 'LD<' when 'DMOV' then 'D/' when 'BMOV' then 'LDD>' else opcode end opcode, case when opcode = 'DMOV' then 3 else 2 end argc, 1 arg_index, case when q % 2 = 1 then device end device, case when q % 2 = 1 then device_type end device_type, case when q % 2 = 1 then number end number,
  case when q % 2 = 0 and opcode = 'DMOV' then q % 5 when q % 2 = 0 then q * 2000 end value, comment
from (select *, cast(substr(const_args, 2) as bigint) q from {occ}) base""",
    "projects": "select r_regionkey k, concat('P', cast(r_regionkey as string)) project from {region} where r_regionkey < 4",
    "comments": """
select project, concat(dt, case when dt in ('X', 'Y', 'W') then hex(p_partkey) else cast(p_partkey as string) end) device, dt device_type, p_partkey number,
  case when (p_partkey + k) % 5 = 0 then '' when (p_partkey + k) % 7 = 0 then concat(p_name, ' of ', project) else p_name end all_text, case when (p_partkey + k) % 3 = 0 then p_name else '' end english
from (select p_partkey, p_name, k, project, case p_partkey % 8 when 0 then 'X' when 1 then 'Y' when 2 then 'M' when 3 then 'M' when 4 then 'L' when 5 then 'D' when 6 then 'D' else 'W' end dt from {part} join {projects} on true where (p_partkey + 3 * k) % 11 > 0) base""",
    "areas": "select concat('P', cast(s_suppkey % 4 as string)) project, s_suppkey area_no, case when s_suppkey % 2 = 0 then 'refresh' else 'unit' end kind, case when s_suppkey % 3 = 0 then 'X' else 'W' end device_type, s_suppkey * 20 start_value, s_suppkey * 20 + 4 end_value, s_name unit_name from {supplier}",
    "pou_order": "select distinct concat('P', cast(o_orderkey % 4 as string)) project, concat('L', cast(cast(floor(o_orderkey / 200) as int) as string)) pou, nullif((cast(floor(o_orderkey / 200) as int) * 7 + o_orderkey % 4) % 20, 5) seq from {orders}",
    # pointers and calls of six subroutines a program, nested and in rings, and a RET behind each
    "call_marks": """
select project, lddb, case when k = 2 then pos + 1 else pos end pos, case k when 0 then 'P' when 1 then 'CALL' else 'RET' end opcode,
  case when k = 1 then 1 + (cast(floor(pos / 32) as bigint) * 5 + cast(floor(pos / 200) as bigint) * 3) % 6 else g end pointer
from (select project, lddb, pos, cast(floor((pos % 200) / 32) as bigint) g, pos % 8 < 4 early from {rungs_old}) r join (select r_regionkey k from {region} where r_regionkey < 3) m
  on (early and k = 0 and g > 0) or (not early and k = 1) or (not early and k = 2 and g > 0)""",
    "device_log": "select concat('P', cast(event_id % 4 as string)) project, concat('M', cast(user_id as string)) device, date_trunc('hour', ts) ts, event_id seq, value value_num, event_type value_type, concat('S', cast(user_id % 5 as string)) source, concat('C', cast(user_id % 42 as string)) capture, case when user_id % 3 = 1 then concat('F', cast(user_id % 2 as string)) end fingerprint from {events}",
    "rungs_old": "select concat('P', cast(o_orderkey % 4 as string)) project, concat('L', cast(cast(floor(o_orderkey / 200) as int) as string)) lddb, concat('g', cast(cast(floor(o_orderkey / 4) as int) as string)) guid, o_orderkey pos, concat(':cb[fg=fg[dim=', cast(o_custkey % 9 as string), 'x4:', o_orderpriority, ':', o_orderstatus) data, o_orderpriority title from {orders}",
    "rungs_new": """
select project, lddb, guid, case when pos % 11 = 0 then pos - 45 else pos end pos,
  case when pos % 7 = 0 then concat(data, ':edited') when pos % 13 = 0 then replace(data, 'x4:', 'x8:') else data end data, title
from {rungs_old} where pos % 10 <> 0
union all select project, lddb, concat('n', guid), pos + 1, data, title from {rungs_old} where pos % 17 = 0""",
    "steps_old": "select project, lddb, concat('g', cast(pos as string)) guid, pos, op_index, opcode, case when number % 16 > 0 then device end argument from {occ}",
    # some operations with another opcode or argument, some rungs and programs gone or renamed
    "steps_new": """
select project, case when cast(floor(pos / 200) as int) % 19 = 3 then concat(lddb, 'B') else lddb end lddb, guid, pos, op_index, case when pos % 7 = 0 and opcode = 'MOV' then 'DMOV' else opcode end opcode,
  case when pos % 11 = 0 and op_index = 1 and argument is not null then concat(argument, 'Z0') else argument end argument
from {steps_old} where pos % 10 <> 0""",
    "comments_new": "select project, device, device_type, number, case when number % 9 = 0 then concat(all_text, ' rev') else all_text end all_text from {comments} where number % 14 <> 0 union all select project, concat('N', device), device_type, number, all_text from {comments} where number % 21 = 0",
}

# every device with a row, for queries that look for no missing ones
VIEWS["whole_comments"] = VIEWS["comments"].replace(" where (p_partkey + 3 * k) % 11 > 0", "")
VIEWS["whole_comments_new"] = VIEWS["comments_new"].replace("{comments}", "{whole_comments}")


#: Rows of the largest table for each partition of a shuffle, and the bytes of one that Spark joins small ones up to.
ROWS_A_PARTITION, PARTITION_BYTES = 200_000, "8m"


def deal(spark: SparkSession, sf_dir: str) -> int:
    """Has the session deal rows over partitions whose number follows the rows of the
    tables in ``sf_dir``, so that what a task sorts or counts does not grow with them.
    A session with more partitions keeps its own number. Rows are counted from the
    footers of the files."""
    own = spark.conf.get("rungfleet.partitions", None) or spark.conf.get("spark.sql.shuffle.partitions")
    rows = max(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "events"))
    n = max(int(own), -(-rows // ROWS_A_PARTITION))
    for key, value in (("rungfleet.partitions", own), ("spark.sql.shuffle.partitions", n), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)):
        spark.conf.set(key, value)
    return n


def needs(name: str, seen: list[str] | None = None) -> list[str]:
    """The views that a view is made from, itself last."""
    seen = [] if seen is None else seen
    for inner in re.findall(r"\{(\w+)\}", VIEWS[name]):
        if inner in VIEWS and inner not in seen:
            needs(inner, seen)
    if name not in seen:
        seen.append(name)
    return seen


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or table as a DataFrame over the Parquet files in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))})


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views, and what they need, as its first CTEs."""
    order: list[str] = []
    for n in names:
        needs(n, order)
    ctes = ",\n".join(f"{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order)
    sql = sql.strip()
    return f"with {ctes},\n{sql[4:]}" if sql[:5].lower() == "with " else f"with {ctes}\n{sql}"
