"""Secret scans with a ledger of blobs.

Every version of a text is named by the SHA-256 of its bytes. A ledger says which
pairs of blob and rule version have been scanned and what was found, so a run
scans only pairs that it has not seen, once however many paths hold the blob, and
joins findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, scratch, smaller_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if it has ``least`` characters, or, with
    ``group``, that group has. ``mark`` is what every such match holds, as a pattern
    that the JVM and Python read alike: texts without it need no scan. A changed
    rule takes a new ``version``."""

    kind: str
    version: int
    pattern: str
    mark: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three kinds, in the order in which they are listed; what follows adds kinds.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", 8, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    Rule("private_key", 1, r"-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
)
BASE = ("assign", "access", "hex")

FOUND = "array<struct<kind:string,start:int,stop:int>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"
#: Into how many parts the paths of a blob with findings are dealt.
SALTS = 8


def scan(text: str, rules: list[Rule]) -> list[tuple[str, int, int]]:
    """``kind, start, stop`` in code points, leftmost and non-overlapping per kind."""
    out = []
    for r in rules:
        for m in re.compile(r.pattern, (re.I | re.A) if r.any_case else re.A).finditer(text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((r.kind, m.start(), m.end()))
    return out


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan_versions(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``versions`` with ``blob`` and ``found``, the findings of ``rules`` in place of the
    column ``text``, and the pairs that this run has scanned (ledger rows).

    ``ledger`` is a folder of Parquet files in shared storage, made when it is not
    there; without one a new folder below ``spark.checkpoint.dir`` serves one run.
    Null texts count as empty. Rows are independent: repeated rows, null paths and
    columns of any name come out as they went in; an added column whose name is
    taken gets underscores.

    Hashes and marks come from one read of the texts; only texts with a mark are
    stored and go to a scan, one copy a blob, chosen with partial aggregation on
    the map side. Findings are joined back over ``SALTS`` parts, so that the paths
    of one frequent blob do not meet in one task.
    """
    spark = versions.sparkSession
    blob, found = fresh(versions, "blob"), fresh(versions, "found")
    known = {r.name: r for r in rules}
    body = F.coalesce(F.col(text), F.lit(""))
    marks = F.filter(F.array(*[F.when(body.rlike(r.mark), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    others = [c for c in versions.columns if c != text]
    flat = versions.select(F.struct(*others).alias("row"), body.alias("text"), blob_of(body).alias("blob"), marks.alias("marks"))
    staged = materialize(flat.withColumn("text", F.when(F.size("marks") > 0, F.col("text"))))

    path = ledger or scratch(spark)
    if not ledger or not _exists(spark, path):
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    seen = spark.read.schema(LEDGER).parquet(path)

    # unseen pairs: the rules that a blob's ledger rows do not name
    done = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
    blobs = staged.groupBy("blob").agg(F.first("marks").alias("marks"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    todo = blobs.join(done, "blob", "left").select("blob", "marks", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    todo = materialize(todo.withColumn("read", F.array_intersect("rules", "marks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [[{"kind": k, "start": s, "stop": e} for k, s, e in scan(t.as_py(), [known[x] for x in names.as_py()])] for t, names in zip(b.column("text"), b.column("read"))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("blob"), b.column("rules"), pa.array(hits, kind)], ["blob", "rules", "found"])

    texts = staged.where("text is not null").groupBy("blob").agg(F.first("text").alias("text"))
    marked = texts.join(todo.where(F.size("read") > 0).select("blob", "rules", "read"), "blob")
    scanned = smaller_batches(marked.select("blob", "text", "rules", "read")).mapInArrow(run, LEDGER)
    plain = todo.where(F.size("read") == 0).select("blob", "rules", F.array().cast(FOUND).alias("found"))
    fresh_rows = materialize(scanned.unionByName(plain))
    fresh_rows.write.mode("append").parquet(path)

    hits = spark.read.schema(LEDGER).parquet(path).where(F.size("found") > 0)
    current = F.array_intersect("rules", wanted)
    hits = hits.where(F.size(current) > 0).select("blob", F.explode("found").alias("f"), current.alias("current")).where(F.exists("current", lambda c: F.substring_index(c, "@", 1) == F.col("f.kind")))
    hits = hits.groupBy("blob").agg(F.collect_set("f").alias("found")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    paths = staged.select("row", "blob", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    out = paths.join(hits, ["blob", "salt"], "left").select(*[F.col(f"row.`{c}`").alias(c) for c in others], F.col("blob").alias(blob), F.coalesce("found", F.array().cast(FOUND)).alias(found))
    return out, fresh_rows


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def span_text(found: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of findings of ``kinds``, by start and then in that order, joined
    by commas."""
    keyed = F.transform(F.filter(found, lambda f: f["kind"].isin(kinds)), lambda f: F.struct(f["start"].alias("a"), F.array_position(F.array(*[F.lit(k) for k in kinds]), f["kind"]).alias("b"), f["stop"].alias("c"), f["kind"].alias("d")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda f: F.concat_ws(":", f["d"], f["a"].cast("string"), f["c"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of
    ``docs(doc_id, text)``: counts and digest of the base kinds, and all findings.

    Null and empty texts have no findings. Repeated rows and null ids come out as
    often as they went in. Other columns are not read.
    """
    out, _ = scan_versions(docs.select("doc_id", "text"), rules, ledger)
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long")
    kinds = [*BASE, *[r.kind for r in rules if r.kind not in BASE]]
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(span_text(F.col("found"), list(BASE)).cast("binary"), 256).alias("base_sha256"), span_text(F.col("found"), kinds).alias("spans"))
