"""Devices that two projects share: exact links, links by comment role, and what
goes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.devices import split_device
from .facts import reads, writes


def project_devices(members: DataFrame) -> DataFrame:
    """Each project's devices: last comment, whether read, whether written, titles."""
    return members.groupBy("project", F.col("member_device").alias("device"), "device_type").agg(
        F.max_by("comment", F.when(F.coalesce("comment", F.lit("")) != "", F.struct("pos", "occ_id"))).alias("comment"), F.max(reads(F.col("access"))).alias("has_read"), F.max(writes(F.col("access"))).alias("has_write"), F.array_join(F.array_sort(F.collect_set("title")), ",").alias("titles")
    )


def exact_links(devices: DataFrame, network_types: list[str]) -> DataFrame:
    """Pairs of projects with one device of a network type, written by one and read
    by the other. A device meets each project once, so a pair of projects gives
    one row a device."""
    d = devices.where(F.col("device_type").isin(*network_types)).select("project", "device", "has_read", "has_write", "comment")
    a, b = d.alias("a"), d.alias("b")
    j = a.join(b, (F.col("a.device") == F.col("b.device")) & (F.col("a.project") < F.col("b.project")) & ((F.col("a.has_write") & F.col("b.has_read")) | (F.col("b.has_write") & F.col("a.has_read"))))
    forth, back = F.col("a.has_write") & F.col("b.has_read"), F.col("b.has_write") & F.col("a.has_read")
    direction = F.when(forth & back, "both").when(forth, "A_to_B").otherwise("B_to_A")
    return j.select(F.col("a.project").alias("project_a"), F.col("a.device").alias("device_a"), F.col("b.project").alias("project_b"), F.col("b.device").alias("device_b"), F.lit("exact").alias("link_type"), direction.alias("direction"), F.col("a.comment").alias("role"))


def role_links(devices: DataFrame, adjacency: DataFrame, role: Column) -> DataFrame:
    """Devices of adjacent projects whose comments have one role: every device that is
    only read, with the smallest one of that role that the other project drives.
    ``adjacency(project_a, project_b)`` names sender and receiver; a pair that
    works both ways is listed both ways. A project's drivers of a role are one
    row, so a receiver meets each adjacent project once, however frequent the
    role; a hot role is split by Spark."""
    d = devices.withColumn("role", role).where("role <> ''")
    a = d.where("has_write").groupBy(F.col("project").alias("project_a"), "role").agg(F.min("device").alias("device_a")).join(adjacency, "project_a")
    b = d.where("not has_write").select(F.col("project").alias("project_b"), "role", F.col("device").alias("device_b"))
    return a.join(b, ["project_b", "role"]).select("project_a", "device_a", "project_b", "device_b", F.lit("role").alias("link_type"), F.lit("A_to_B").alias("direction"), "role")


def dominant_offsets(links: DataFrame) -> DataFrame:
    """The difference of device numbers, source less receiver, that most role links of
    two projects and a direction share: ``project_a, project_b, direction, offset,
    votes``, where at least two do. Of equal ones the smallest distance wins, then the
    smaller number. Links vote once for an offset, then offsets for a pair."""
    key = ["project_a", "project_b", "direction"]
    votes = _oriented(links).where("link_type = 'role' and offset is not null").groupBy(*key, "offset").agg(F.count("*").alias("votes"))
    best = votes.groupBy(*key).agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("low"))).alias("b"))
    return best.where("b.votes > 1").select(*key, (-F.col("b.low")).alias("offset"), F.col("b.votes").alias("votes"))


def _oriented(links: DataFrame) -> DataFrame:
    """``links`` with the receiver and the offset of numbers by direction; a link that
    goes both ways has neither."""
    number = lambda c: split_device(F.col(c))["number"]
    forth, back = F.col("direction") == "A_to_B", F.col("direction") == "B_to_A"
    return links.withColumns({
        "receiver_project": F.when(forth, F.col("project_b")).when(back, F.col("project_a")),
        "receiver_device": F.when(forth, F.col("device_b")).when(back, F.col("device_a")),
        "offset": F.when(forth, number("device_a") - number("device_b")).when(back, number("device_b") - number("device_a")),
    })


# fixed values: confidences, best first
CONFIDENCE = ("high", "medium", "low")


def dedupe_links(links: DataFrame) -> DataFrame:
    """``links(project_a, device_a, project_b, device_b, link_type, direction, role,
    confidence, evidence)`` without repeats, with ``in_band``.

    Of equal links the one with the longest evidence stays. Of the role links that
    end at one receiver, for a role and direction, the best stays: by confidence,
    then with the dominant offset of its projects (``in_band``), then with a receiver
    that its evidence names, then the smallest source. Other links pass.
    """
    same = ["project_a", "device_a", "project_b", "device_b", "link_type"]
    rest = [c for c in links.columns if c not in same]
    one = links.groupBy(*same).agg(F.max(F.struct(F.length("evidence").alias("n"), F.struct(*rest).alias("r"))).alias("m")).select(*same, *[F.col(f"m.r.{c}").alias(c) for c in rest])
    bands = dominant_offsets(one).drop("votes").withColumn("in_band", F.lit(True))
    marked = _oriented(one).join(bands, ["project_a", "project_b", "direction", "offset"], "left").withColumn("in_band", F.coalesce("in_band", F.lit(False)))
    ranked = (F.col("link_type") == "role") & F.col("receiver_device").isNotNull()
    place = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    names = F.lower("evidence").contains(F.lower("receiver_project"))
    best = F.row_number().over(Window.partitionBy("role", "direction", "receiver_project", "receiver_device").orderBy(F.when(place > 0, place).otherwise(9), F.desc("in_band"), names.desc(), "project_a", "device_a", "project_b", "device_b"))
    columns = [*links.columns, "in_band"]
    return marked.where(ranked).withColumn("rank", best).where("rank = 1").select(*columns).union(marked.where(~ranked).select(*columns))


def missing_pairs(links: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(links.select("project_a", "project_b").distinct(), ["project_a", "project_b"], "left_anti")


def cross_where_used(members: DataFrame, links: DataFrame) -> DataFrame:
    """Uses of linked devices in the project at the other end, either way round."""
    there = links.select(F.col("project_a").alias("from_project"), F.col("device_a").alias("from_device"), F.col("project_b").alias("project"), F.col("device_b").alias("member_device"))
    back = links.select("project_b", "device_b", "project_a", "device_a")
    m = members.groupBy("project", "member_device").agg(F.count("*").alias("uses"), F.count_if(writes(F.col("access"))).alias("writes"))
    return there.union(back).distinct().join(m, ["project", "member_device"])


def handshake_signals(links: DataFrame, members: DataFrame) -> DataFrame:
    """Each link with its sender's and receiver's rungs."""
    w = members.where(writes(F.col("access"))).groupBy("project", "member_device").agg(F.count_distinct("lddb", "pos").alias("send_rungs"), F.min("pos").alias("first_send"))
    r = members.where(reads(F.col("access"))).groupBy("project", "member_device").agg(F.count_distinct("lddb", "pos").alias("receive_rungs"))
    out = links.where("direction <> 'B_to_A'").join(w, (F.col("project_a") == w["project"]) & (F.col("device_a") == w["member_device"])).drop("project", "member_device")
    return out.join(r, (F.col("project_b") == r["project"]) & (F.col("device_b") == r["member_device"])).select("project_a", "device_a", "project_b", "device_b", "send_rungs", "first_send", "receive_rungs")


def data_groups(links: DataFrame, occ: DataFrame, top: int) -> DataFrame:
    """Receiving rungs that move linked words: devices gathered, top ``top`` per project."""
    inbound = links.where("direction <> 'B_to_A'").select(F.col("project_b").alias("project"), F.col("device_b").alias("device")).distinct()
    g = occ.where(F.col("opcode").isin("MOV", "DMOV", "BMOV") & reads(F.col("access"))).join(inbound, ["project", "device"], "left_semi").groupBy("project", "lddb", "pos").agg(F.count_distinct("device").alias("n"), F.array_join(F.array_sort(F.collect_set("device")), ",").alias("devices"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "lddb", "pos"))).where(F.col("rank") <= top)
