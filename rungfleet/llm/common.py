"""What the text operators share: reading, scratch tables and word handling."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, as the body of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    The setting is the cluster's; only where it is unset and the session runs in
    this one process, as in tests, a local folder is made and set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rungfleet-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage in a way that survives lost executors, and keeps what
    several later steps read from being computed several times.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` has made and nothing reads
    any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize_counted(df: DataFrame, *measures: Column) -> tuple[DataFrame, tuple]:
    """``materialize(df)`` and aggregates over its rows, taken while it is written."""
    seen = Observation()
    named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
    out = materialize(df.observe(seen, *named))
    return out, tuple(seen.get[f"m{i}"] for i in range(len(measures)))


def words(text: Column) -> Column:
    """The runs of non-space characters; an empty array for null or no word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, even where ``body``
    uses it inside a function that runs for each element of an array."""
    return F.transform(F.array(value), body)[0]


def word_runs(ws: Column, n: int) -> Column:
    """The runs of ``n`` words of an array, joined by a space, in order; none with
    fewer words. Words are taken one by one: a slice would copy the whole array
    for each run."""
    at = F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(n)]))
    return F.when(F.size(ws) >= n, at).otherwise(F.array().cast("array<string>"))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


#: Bytes of text that a broadcast table may have.
BROADCAST_BYTES = 64 << 20


def maybe_broadcast(df: DataFrame, rows: int, *texts: str) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and the columns
    ``texts`` at most ``BROADCAST_BYTES``; else as it is, and the join shuffles
    both sides. ``df`` should be a stored table."""
    if not fits(df, rows):
        return df
    sizes = df.agg(*[F.sum(F.octet_length(F.col(c))) for c in texts]).first() if texts else ()
    return F.broadcast(df) if sum(x or 0 for x in sizes) <= BROADCAST_BYTES else df


#: What Python workers keep for themselves of memory that was freed: arrays of 4 MB or more go back to the system at once, others when 32 MB of them lie together. The names are the C library's.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def smaller_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """``df``, in whose session an Arrow batch to a Python worker takes at most so
    many bytes, or one row: whole texts are long, and a worker holds a batch
    several times. The session keeps a smaller bound of its own. Workers that start
    from now on give freed memory back, so that a reused one does not stay as
    large as its largest batch made it; settings that are there already win."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, str(2 * size)).rstrip("b")) > size:
        conf.set(key, str(size))
    for name, value in WORKER_MEMORY.items():
        df.sparkSession.sparkContext.environment.setdefault(name, value)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or if ``df`` has such a column ``name`` with underscores after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
