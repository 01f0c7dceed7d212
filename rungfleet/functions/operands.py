"""Operand texts, spans of block instructions, text programs, addresses, aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .devices import canonical_device
from .texts import first_class


def parse_operand(text: Column) -> Column:
    """Array of ``struct(kind, device, run, bit, access)``: digit-specified bits
    (four a digit), a bit of a word, buffer memory, an indexed device with a read
    of its index register, a constant, or a label that is kept as text."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    none = F.lit(None).cast("string")
    item = lambda kind, device, run=F.lit(1), bit=F.lit(None).cast("int"), access=none: F.struct(F.lit(kind).alias("kind"), device.alias("device"), run.cast("int").alias("run"), bit.alias("bit"), access.alias("access"))
    digits, digit_dev = F.regexp_extract(t, r"^K(\d)([A-Z]+[0-9A-F]+)$", 1), F.regexp_extract(t, r"^K(\d)([A-Z]+[0-9A-F]+)$", 2)
    word, bit = F.regexp_extract(t, r"^([A-Z]+[0-9A-F]+)\.([0-9A-F])$", 1), F.regexp_extract(t, r"^([A-Z]+[0-9A-F]+)\.([0-9A-F])$", 2)
    base, index = F.regexp_extract(t, r"^([A-Z]+\d+)(Z\d+)$", 1), F.regexp_extract(t, r"^([A-Z]+\d+)(Z\d+)$", 2)
    # bound, so that the patterns of devices run once a row
    named = lambda d: F.when(d.isNotNull(), item("device", d)).otherwise(item("label", F.trim(text)))
    return (
        F.when(t == "", F.array().cast("array<struct<kind:string,device:string,run:int,bit:int,access:string>>"))
        .when(digits != "", F.array(item("digits", digit_dev, digits.cast("int") * 4)))
        .when(word != "", F.array(item("bit of word", word, F.lit(1), F.conv(bit, 16, 10).cast("int"))))
        .when(t.rlike(r"^U[0-9A-F]+\\(G|HG)\d+$"), F.array(item("buffer", t)))
        .when(index != "", F.array(item("indexed", base), item("index", index, access=F.lit("read"))))
        .when(t.rlike(r"^(K-?\d+|H[0-9A-F]+|E-?[0-9.]+)(Z\d+)?$"), F.array(item("constant", t)))
        .otherwise(F.transform(F.array(canonical_device(t)), named))
    )


def operand_span(words: Column, count: Column, num: Column, den: Column, indexed: Column) -> Column:
    """Devices that an operand covers: its words times the count, scaled and rounded
    up; 0 if the count is held in a device (null here); 1 if it is indexed."""
    return F.when(indexed, 1).when(count.isNull(), 0).otherwise(F.ceil(words * count * num / den)).cast("int")


def st_references(sources: DataFrame, labels: DataFrame) -> DataFrame:
    """Reads and writes of simple assignments in ``sources(project, source_id, body)``;
    tables of one project may leave ``project`` out.

    Comments go first; statements with control flow, calls or arrays are passed
    over and make their source partial. Symbols of ``labels(symbol, device)`` with
    one device are resolved, others keep a null device.
    """
    body = F.regexp_replace(F.regexp_replace("body", r"(?s)\(\*.*?\*\)", " "), r"//[^\n]*", " ")
    of = ["project"] if "project" in sources.columns else []
    st = sources.select(*of, "source_id", F.posexplode(F.split(body, ";")).alias("statement_index", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    simple = F.col("s").rlike(r"^[\w.]+\s*:=") & ~F.col("s").rlike(r"(?i)\b(if|for|while|case|repeat)\b|[\w.]\s*\(|\[")
    st = st.withColumn("simple", simple)
    partial = st.groupBy(*of, "source_id").agg(F.when(F.min("simple"), "complete").otherwise("partial").alias("coverage"))
    left = F.regexp_extract("s", r"^([\w.]+)\s*:=", 1)
    right = F.array_distinct(F.regexp_extract_all(F.regexp_replace("s", r"^[\w.]+\s*:=", ""), F.lit(r"\b([A-Za-z_][\w.]*)\b"), 1))
    words = ("AND", "OR", "NOT", "XOR", "MOD", "TRUE", "FALSE")
    refs = st.where("simple").select(*of, "source_id", "statement_index", F.explode(F.concat(F.array(F.struct(left.alias("symbol"), F.lit("write").alias("access"))), F.transform(F.filter(right, lambda x: ~F.upper(x).isin(*words)), lambda x: F.struct(x.alias("symbol"), F.lit("read").alias("access"))))).alias("r")).select(*of, "source_id", "statement_index", "r.*")
    one = labels.groupBy(*of, "symbol").agg(F.count_distinct("device").alias("n"), F.min("device").alias("device")).where("n = 1").drop("n")
    direct = canonical_device(F.col("symbol"))
    return refs.join(one, [*of, "symbol"], "left").join(partial, [*of, "source_id"]).select(*of, "source_id", "statement_index", "symbol", "access", F.coalesce("device", direct).alias("device"), "coverage")


def ip_map(params: DataFrame, units: DataFrame, roles: Sequence[tuple[str, str]]) -> DataFrame:
    """Addresses in parameter texts ``(project, unit, name, text)`` with the unit's name
    from ``units(project, unit, unit_name)``, if it has one; tables of one project may
    leave ``project`` out. What an address is for stands in the
    parameter's name: the first of ``roles(role, pattern)`` found in it, else
    ``address``."""
    key = ["project", "unit"] if "project" in params.columns else ["unit"]
    found = params.select(*key, "name", F.explode(F.regexp_extract_all("text", F.lit(r"(\d{1,3}(?:\.\d{1,3}){3})"), 1)).alias("ip"))
    return found.join(units.select(*key, "unit_name"), key, "left").select(*key, "unit_name", "ip", first_class(F.lower("name"), roles, "address").alias("role"))


def pseudonymize(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with an alias ``KIND_n`` in place of each distinct value, and the
    mapping. Values are numbered by their MD5, range by range, so no single task
    numbers them all, and a rerun gives the same aliases."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("h", F.md5("value")).withColumn("part", F.col("h").substr(1, 2))
    sizes = v.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("part", "before")
    number = F.row_number().over(Window.partitionBy("part").orderBy("h", "value")) + F.col("before")
    mapping = v.join(before, "part").select("value", F.concat(F.lit(f"{kind}_"), F.lpad(number.cast("string"), 4, "0")).alias("alias"))
    out = df.join(mapping, F.col(column) == F.col("value"), "left").withColumn(column, F.col("alias")).drop("value", "alias")
    return out, mapping
