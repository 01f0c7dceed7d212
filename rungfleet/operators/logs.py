"""Captured device logs: identity, duplicates, series, changes, snapshots, and
conditions held against a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import writes


def check_capture(log: DataFrame, key: list[str]) -> DataFrame:
    """Captures that mix identities, that is, pairs of source and project fingerprint;
    a missing one is not taken to be the named one, so it counts as one more."""
    part = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    identity = F.struct(part("source").alias("source"), part("fingerprint").alias("fingerprint"))
    # one row an identity first: a capture has few, whatever its length
    each = log.groupBy(*key, identity.alias("identity")).agg(F.count("*").alias("n"))
    per = each.groupBy(*key).agg(F.count("*").alias("identities"), F.count_distinct("identity.source").alias("sources"), F.count_distinct("identity.fingerprint").alias("fingerprints"), F.sum("n").alias("records"))
    return per.where("identities > 1")


def dedupe_log(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The last record (by ``seq``) of each key, and how many it replaced. One
    aggregation with map-side combining, no sort."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r"), (F.count("*") - 1).alias("replaced"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest], "replaced")


def device_series(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of a device together and in time order."""
    key = ["project", "device"]
    by = log.repartition(partitions, *key) if partitions else log.repartition(*key)
    return by.sortWithinPartitions(*key, "ts")


def change_points(log: DataFrame, key: list[str], ts: str, value: str, kind: str) -> DataFrame:
    """Records whose value or type differs from the record before; the first record
    of a key is none."""
    w = Window.partitionBy(*key).orderBy(ts)
    before_v, before_t = F.lag(value).over(w), F.lag(kind).over(w)
    marked = log.withColumn("previous", before_v).withColumn("previous_type", before_t).withColumn("is_first", F.row_number().over(w) == 1)
    return marked.where(~F.col("is_first") & (~F.col(value).eqNullSafe(F.col("previous")) | ~F.col(kind).eqNullSafe(F.col("previous_type")))).drop("is_first")


def snapshot(log: DataFrame, at: str, nearest: bool = True) -> DataFrame:
    """Each device's record at an instant: exactly, or the nearest, the earlier of
    two that are as near; with the distance in seconds."""
    instant = F.lit(at).cast("timestamp")
    away = F.abs(F.unix_micros("ts") - F.unix_micros(instant))
    rows = log if nearest else log.where(F.col("ts") == instant)
    best = rows.groupBy("project", "device").agg(F.min(F.struct(away.alias("away"), "ts", (-F.col("seq")).alias("s"), "value_num", "value_type")).alias("m"))
    return best.select("project", "device", F.col("m.ts").alias("ts"), F.col("m.value_num").alias("value_num"), F.col("m.value_type").alias("value_type"), (F.col("m.away") / 1000000.0).alias("distance_s"))


def literal_state() -> Column:
    """A literal's state from its ``required`` and its device's ``value_num``."""
    on = F.col("value_num") > 0
    return F.when(~F.col("required").isin("a", "b"), "unknown").when(F.col("value_num").isNull(), "missing").when(on == (F.col("required") == "a"), "pass").otherwise("block")


def evaluate(cond: DataFrame, snap: DataFrame) -> DataFrame:
    """The state of each output under a snapshot ``(project, device, value_num)``.

    ``cond`` has branches of literals (``required`` a: on, b: off). A branch is
    blocked by one blocked literal and passes if all pass; else it is unknown if
    one is (edges), else missing. An output passes with one passing branch and is
    blocked if all are; else unknown, else missing.
    """
    key = ["project", "lddb", "pos", "out_device"]
    lit = cond.join(snap.select("project", "device", "value_num"), ["project", "device"], "left").withColumn("state", literal_state())
    count = lambda s: F.count_if(F.col("state") == s)
    branch = lit.groupBy(*key, "branch").agg(F.when(count("block") > 0, "block").when(count("pass") == F.count("*"), "pass").when(count("unknown") > 0, "unknown").otherwise("missing").alias("state"))
    return branch.groupBy(*key).agg(F.when(count("pass") > 0, "pass").when(count("block") == F.count("*"), "block").when(count("unknown") > 0, "unknown").otherwise("missing").alias("state"), F.count("*").alias("branches"))


def explain_outputs(cond: DataFrame, snap: DataFrame, flags: DataFrame, predicates: DataFrame) -> DataFrame:
    """``evaluate`` with what limits it: how many literals pass, block, have no value or
    are unknown, the weakest analysis state, and the constraints behind it.

    ``flags(project, lddb, pos, guarded, partial, too_large)`` marks rungs that may not
    run, were not wholly read, or whose condition was given up: their state is
    unknown. ``predicates`` are those of ``temporal_predicates``: they leave the state
    as it is, as one snapshot can tell it, and add a constraint. Edges are not
    supported, values that are missing are no measurement.
    """
    from .inventory import worst_state

    key = ["project", "lddb", "pos", "out_device"]
    rung = ["project", "lddb", "pos"]
    folded = evaluate(cond, snap)
    lit = cond.join(snap.select("project", "device", "value_num"), ["project", "device"], "left").withColumn("state", literal_state())
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    counts = lit.groupBy(*key).agg(count("pass"), count("block"), count("missing"), count("unknown"))
    f = flags.groupBy(*rung).agg(*[F.max(c).alias(c) for c in ("guarded", "partial", "too_large")])
    t = predicates.groupBy(*rung, "kind").agg(F.count("*").alias("n")).groupBy(*rung).agg(F.array_sort(F.collect_list("kind")).alias("kinds"))
    j = folded.join(counts, key).join(f, rung, "left").join(t, rung, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    limit = lambda state, why: F.struct(F.lit(state).alias("state"), why.alias("reason"))
    found = F.array(
        F.when(F.col("n_unknown") > 0, limit("unsupported", F.lit("edge contact"))),
        F.when(F.col("n_missing") > 0, limit("no_measurement", F.lit("no value"))),
        F.when(yes("guarded"), limit("partial", F.lit("may not run"))),
        F.when(yes("partial"), limit("partial", F.lit("not wholly read"))),
        F.when(yes("too_large"), limit("truncated", F.lit("condition too large"))),
        limit("checked", F.lit("")),
    )
    limits = F.concat(F.filter(found, lambda x: x.isNotNull()), F.transform(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: limit("partial", k)))
    worst = worst_state(j.select(*key, F.explode(limits).alias("l")).select(*key, "l.*"), key).withColumnRenamed("state", "analysis")
    blind = yes("guarded") | yes("partial") | yes("too_large")
    return j.join(worst, key).select(*key, F.when(blind, "unknown").otherwise(F.col("state")).alias("state"), "branches", "n_pass", "n_block", "n_missing", "n_unknown", "analysis", "constraints")


def count_states(explained: DataFrame) -> DataFrame:
    """Outputs of each project by state and analysis state."""
    return explained.groupBy("project", "state", "analysis").agg(F.count("*").alias("outputs"))


def temporal_predicates(occ: DataFrame, cond: DataFrame, timers: list[str], counters: list[str]) -> DataFrame:
    """What a rung's state needs beyond the snapshot: ``project, lddb, pos, kind,
    device``. Latches and edges by the output's role, timers and counters by its
    device type, and contacts that are edges, or of timers or counters.

    ``occ`` are occurrences; ``cond(project, lddb, pos, device, device_type,
    required)`` the rungs' literals.
    """
    role, kind_of = F.col("role"), F.col("device_type")
    driven = F.when(role == "SET", "latch set").when(role == "RST", "latch reset").when(role == "PLS", "rising edge").when(role == "PLF", "falling edge")
    driven = driven.when((role == "c") & kind_of.isin(*timers), "timer done").when((role == "c") & kind_of.isin(*counters), "counter done")
    asked = F.when(F.col("required").isin("p", "f", "pi", "fi"), "edge contact").when(kind_of.isin(*timers), "timer contact").when(kind_of.isin(*counters), "counter contact")
    key = ["project", "lddb", "pos"]
    out = occ.where(writes(F.col("access"))).select(*key, driven.alias("kind"), "device")
    return out.union(cond.select(*key, asked.alias("kind"), "device")).where("kind is not null").distinct()
