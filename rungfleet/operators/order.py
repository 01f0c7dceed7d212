"""Program order, and what a reader sees of a writer in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import reads, writes
from .graph import stored

DEVICE = ["project", "member_device"]


def pou_sequence(pous: DataFrame, program_files: DataFrame) -> DataFrame:
    """Sequence of each unit of a project: file order times 100,000 plus its index;
    units whose file has no order come by index alone, marked as a fallback."""
    key = [c for c in ("project", "program") if c in pous.columns and c in program_files.columns]
    joined = pous.join(program_files, key, "left")
    named = [c for c in ("project", "pou") if c in pous.columns]
    return joined.select(*named, (F.coalesce("file_order", F.lit(0)) * 100000 + F.col("link_index")).alias("sequence"), F.when(F.col("file_order").isNull(), "fallback").otherwise("exec").alias("confidence"))


#: The marks of a row from which traits are named, and their names.
TRAITS = {"one_scan": "one-scan-pulse-bit", "said": "pulse-comment-bit", "edge": "edge-executed-holding-write", "own": "self-row"}
#: Parts that devices are counted in to find those with too many rows for one task, and the rows a part may have, or as many times the mean.
PARTS, PART_ROWS, PART_TIMES = 1 << 14, 200_000, 8


def trait_marks(members: DataFrame, bit_types: list[str], pulse_ops: list[str], edge_ops: list[str], pulse_text: str) -> DataFrame:
    """``members`` with ``one_scan``, ``said`` and ``edge``: see ``write_traits``."""
    bit, w = F.col("device_type").isin(*bit_types), writes(F.col("access"))
    text = F.concat_ws(" ", "comment", F.when(w, F.concat_ws(" ", "title", "opcode")))
    return members.withColumns({"one_scan": w & bit & F.col("opcode").isin(*pulse_ops), "said": bit & text.rlike(pulse_text), "edge": w & F.col("opcode").isin(*edge_ops)})


def _traits() -> Column:
    named = F.concat_ws(",", *[F.when(F.col(c), text) for c, text in TRAITS.items()])
    return F.when(named == "", "non-pulse").otherwise(named)


def write_traits(members: DataFrame, bit_types: list[str], pulse_ops: list[str], edge_ops: list[str], pulse_text: str) -> DataFrame:
    """How each written device is written: ``project, member_device, traits`` of a bit
    that is on for one scan (by its writers' opcodes), a bit whose comment, title or
    opcode says so, a write that an edge executes, and a rung that reads and writes
    the device; joined by commas, ``non-pulse`` without any."""
    w, marks = writes(F.col("access")), ("one_scan", "said", "edge")
    marked = trait_marks(members, bit_types, pulse_ops, edge_ops, pulse_text)
    rung = marked.groupBy("project", "member_device", "lddb", "pos").agg(*[F.max(c).alias(c) for c in marks], (F.max(w) & F.max(reads(F.col("access")))).alias("own"), F.max(w).alias("written"))
    d = rung.groupBy("project", "member_device").agg(*[F.max(c).alias(c) for c in (*TRAITS, "written")]).where("written")
    return d.select("project", "member_device", _traits().alias("traits"))


def _places(rows: DataFrame, marks: list[str]) -> DataFrame:
    """One row for each place of a device: a position in a unit."""
    own = F.max("w") & F.max("r")
    return rows.groupBy(*DEVICE, "device_type", "pou", "pos", "seq").agg(F.max("w").alias("w"), F.max("r").alias("r"), *[own.alias(m) if m == "own" else F.max(m).alias(m) for m in marks])


def _in_unit(places: DataFrame) -> DataFrame:
    """``places`` with the nearest writing positions of their own unit, and how
    many writing rungs come before, after and in the same place."""
    unit = Window.partitionBy(*DEVICE, "pou")
    # rows of one position run together: RANGE leaves them out of before and after
    up, down = unit.orderBy("pos"), unit.orderBy(F.desc("pos"))
    before, ahead = up.rangeBetween(Window.unboundedPreceding, -1), down.rangeBetween(Window.unboundedPreceding, -1)
    at, one = F.when(F.col("w"), F.col("pos")), F.col("w").cast("long")
    near = places.select("*", F.max(at).over(before).alias("near_before"), F.coalesce(F.sum(one).over(before), F.lit(0)).alias("n_before"), F.sum(one).over(up.rangeBetween(0, 0)).alias("n_same"))
    return near.select("*", F.min(at).over(ahead).alias("near_after"), F.coalesce(F.sum(one).over(ahead), F.lit(0)).alias("n_after"))


def _seen_together(rows: DataFrame, marks: list[str]) -> DataFrame:
    """Places with what their device has in all, in their unit and in the units before
    and after: all rows of a device are dealt to one task once, and every step after
    that finds them there."""
    places = _places(rows.repartition(*DEVICE), marks)
    whole = Window.partitionBy(*DEVICE)
    counts = {"all_w": F.count_if(F.col("w")).over(whole), "all_r": F.count_if(F.col("r")).over(whole)} | {m: F.max(m).over(whole) for m in marks}
    places = _in_unit(places.withColumns(counts).where("all_w > 0 and all_r > 0"))
    known = F.col("seq").isNotNull()
    one, at = (F.col("w") & known).cast("long"), F.when(F.col("w") & known, F.struct("seq", "pos", "pou"))
    past, ahead = (whole.orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.asc("seq"), F.desc("seq")))
    # units without a sequence have no order to others
    out = places.select("*", F.when(known, F.max(at).over(past)).alias("far_before"), F.when(known, F.sum(one).over(past)).alias("seq_before"))
    return out.select("*", F.when(known, F.min(at).over(ahead)).alias("far_after"), F.when(known, F.sum(one).over(ahead)).alias("seq_after")).where("r")


def _seen_apart(rows: DataFrame, marks: list[str]) -> DataFrame:
    """As ``_seen_together``, for devices that very many units use: one window over a
    device's rungs in one unit, and one over one row for each sequence number of a
    device, so that no task sorts all rows of a device."""
    places = _places(rows, marks)
    both = places.groupBy(*DEVICE).agg(F.count_if(F.col("w")).alias("all_w"), F.count_if(F.col("r")).alias("all_r"), *[F.max(m).alias(m) for m in marks]).where("all_w > 0 and all_r > 0")
    places = places.drop(*marks).join(both, DEVICE)
    by_seq = places.where("seq is not null").groupBy(*DEVICE, "seq").agg(F.count_if(F.col("w")).alias("n"), F.max(F.when(F.col("w"), F.struct("seq", "pos", "pou"))).alias("last"), F.min(F.when(F.col("w"), F.struct("seq", "pos", "pou"))).alias("first"))
    up, down = (Window.partitionBy(*DEVICE).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("seq"), F.desc("seq")))
    others = by_seq.select(*DEVICE, "seq", F.max("last").over(up).alias("far_before"), F.sum("n").over(up).alias("seq_before"), F.min("first").over(down).alias("far_after"), F.sum("n").over(down).alias("seq_after"))
    return _in_unit(places).where("r").join(others, [*DEVICE, "seq"], "left")


def _crowded(rows: DataFrame) -> Column | None:
    """Whether a row's device lies in a part with more rows than a task should have,
    or None if there is no such part. A part is some devices by hash, so what is
    counted has a fixed size."""
    part = F.pmod(F.xxhash64(*DEVICE), F.lit(PARTS)).cast("int")
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(PART_ROWS, PART_TIMES * sum(counts.values()) // PARTS)
    full = [p for p, n in counts.items() if n > most]
    return part.isin(full) if full else None


def scan_order_readers(members: DataFrame, pou_order: DataFrame, traits: DataFrame | None, bit_types: list[str]) -> DataFrame:
    """For each reading rung of a device, the nearest writer that runs before it and the
    nearest that runs after it in a scan, how many writing rungs come before
    (``fresh``), after (``stale``) or in its own rung, how many have no known order, and
    a severity.

    Within a unit rungs run by position; units by ``pou_order(project, pou, seq)``. Units
    without a sequence, or of the same one, have no order between them. A stale
    read is high for pulses, else low if an edge executes the write, else medium
    for bits and low for words. Without ``traits``, ``members`` carry ``trait_marks``
    and the traits of a device go along with its rows; a rung is then a position of
    a unit.

    Members are stored once. Windows find the nearest, so no writer meets a reader.
    A device's rows are dealt to one task, once for all windows; only of devices with
    very many rows, which are looked for first, the windows are smaller and dealt
    each by its own key, so that a device that every program uses is never sorted in
    one task.
    """
    marks = list(TRAITS) if traits is None else []
    w, r = writes(F.col("access")), reads(F.col("access"))
    placed = members.join(pou_order.select("project", "pou", "seq"), ["project", "pou"], "left")
    rows = stored(placed.select(*DEVICE, "device_type", "pou", "pos", "seq", w.alias("w"), r.alias("r"), *[m for m in marks if m != "own"]))
    crowded = _crowded(rows)
    if crowded is None:
        j = _seen_together(rows, marks)
    else:
        j = _seen_together(rows.where(~crowded), marks).unionByName(_seen_apart(rows.where(crowded), marks))
    j = j.withColumn("traits", _traits()) if traits is None else j.join(traits, DEVICE, "left")

    fresh = F.col("n_before") + F.coalesce("seq_before", F.lit(0))
    stale = F.col("n_after") + F.coalesce("seq_after", F.lit(0))
    near = lambda c, far: (F.when(F.col(c).isNotNull(), F.col("pou")).otherwise(far["pou"]), F.coalesce(F.col(c), far["pos"]))
    (before_pou, before_pos), (after_pou, after_pos) = near("near_before", F.col("far_before")), near("near_after", F.col("far_after"))
    pulse = F.col("traits").contains("pulse-bit") | F.col("traits").contains("pulse-comment-bit")
    grade = F.when(pulse, "HIGH").when(F.col("traits").contains("edge-executed"), "LOW").when(F.col("device_type").isin(*bit_types), "MEDIUM").otherwise("LOW")
    out = j.select(*DEVICE, "pou", "pos", before_pou.alias("before_pou"), before_pos.alias("before_pos"), after_pou.alias("after_pou"), after_pos.alias("after_pos"), fresh.alias("fresh"), stale.alias("stale"), F.col("n_same").alias("same_row"), (F.col("all_w") - fresh - stale - F.col("n_same")).alias("unknown"), grade.alias("grade"), "traits")
    return out.withColumn("severity", F.when(F.col("stale") > 0, F.col("grade")).when(F.col("unknown") > 0, "UNKNOWN").otherwise("OK")).drop("grade")
