"""Reading instruction lists, areas, logs; assembling comments, labels, units."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, SparkSession
from pyspark.sql import functions as F

#: Header names of the columns of an instruction list, in lower case; callers may pass their own.
HEADERS = {
    "step": ("step", "step no.", "step no"),
    "title": ("line statement", "statement", "title"),
    "opcode": ("instruction", "opcode", "command"),
    "operand": ("i/o (device)", "i/o(device)", "operand", "device", "device name"),
    "program": ("program", "pou", "program name"),
}


def decode_text(body: bytes) -> str:
    """UTF-16 or UTF-8 by their marks, else UTF-8, else code page 932."""
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return body.decode("utf-16")
    try:
        return body.decode("utf-8-sig")
    except UnicodeDecodeError:
        return body.decode("cp932", "replace")


def parse_instructions(text: str, headers: dict[str, Sequence[str]] = HEADERS) -> list[dict]:
    """Rows of one instruction list. What stands before the header is skipped; a
    row without an instruction adds its operand to the one before, or, with text
    alone, is a title for what follows."""
    first = next((x for x in text.splitlines() if "\t" in x or "," in x), "")
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if "\t" in first else ","))
    names = {alias: k for k, aliases in headers.items() for alias in aliases}
    at, head = next(((i, [names.get(c.strip().lower()) for c in r]) for i, r in enumerate(rows) if "opcode" in [names.get(c.strip().lower()) for c in r]), (len(rows), []))
    out: list[dict] = []
    title = program = ""
    for r in rows[at + 1 :]:
        cell = {k: v.strip() for k, v in zip(head, r, strict=False) if k}
        operands = [v.strip() for k, v in zip(head, r, strict=False) if k == "operand" and v.strip()]
        program = cell.get("program") or program
        if cell.get("opcode"):
            out.append({"program": program, "step": int(cell["step"]) if cell.get("step", "").isdigit() else None, "title": title, "opcode": cell["opcode"], "operands": operands})
        elif operands and out:
            out[-1]["operands"] += operands
        elif cell.get("title"):
            title = cell["title"]
    return out


def read_instruction_csv(spark: SparkSession, paths: str | list[str], project: str = "") -> DataFrame:
    """``project, path, program, step, title, opcode, operands`` of instruction lists,
    one task per file or more: a file is the unit, since its rows depend on those
    before."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # one file at a time, as a batch may hold many
            for p, c in zip(b["path"], b["content"], strict=True):
                rows = parse_instructions(decode_text(bytes(c)))
                columns = {k: [x[k] for x in rows] for k in ("program", "step", "title", "opcode", "operands")}
                yield pd.DataFrame({"path": p, "row": range(len(rows)), **columns})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    parsed = files.mapInPandas(parse, "path string, row int, program string, step double, title string, opcode string, operands array<string>")
    return parsed.select(F.lit(project).alias("project"), "path", "row", "program", F.col("step").cast("long").alias("step"), "title", "opcode", "operands")


def clean_areas(areas: DataFrame, split) -> tuple[DataFrame, DataFrame]:
    """Areas with a verified record whose two ends have one type and are in order,
    and counts of the rejected by reason. ``split`` is the device splitter."""
    a = areas.withColumn("s", split(F.col("device_start"))).withColumn("e", split(F.col("device_end")))
    reason = F.when(F.coalesce("record_state", F.lit("verified")) != "verified", "unverified").when(F.col("s").isNull() | F.col("e").isNull(), "no device").when(F.col("s.device_type") != F.col("e.device_type"), "types differ").when(F.col("s.number") > F.col("e.number"), "reversed")
    judged = a.withColumn("reason", reason)
    good = judged.where("reason is null").select(*[c for c in areas.columns], F.col("s.device_type").alias("device_type"), F.col("s.number").alias("start_value"), F.col("e.number").alias("end_value"))
    return good, judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("rejected"))


def read_areas(spark: SparkSession, path: str, split) -> tuple[DataFrame, DataFrame]:
    """Area CSVs with a header; see ``clean_areas``."""
    return clean_areas(spark.read.option("header", True).csv(path), split)


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Captured logs: ``csv`` with a header, or ``json`` as a list of records or an
    object with them under ``records``, ``log`` or ``rows``; the object's source and
    project fingerprint are those of records without one. A ``json`` file is one
    capture; ``json lines`` has a capture a line, so that a long log is read in
    parts."""
    record = "struct<timestamp:string,device:string,value:string,value_type:string,source:string,project_fingerprint:string>"
    if kind == "csv":
        flat = spark.read.option("header", True).csv(path)
        for c in ("value_type", "source", "project_fingerprint"):
            if c not in flat.columns:
                flat = flat.withColumn(c, F.lit(None).cast("string"))
        return flat.select("timestamp", "device", "value", "value_type", "source", "project_fingerprint")
    text = spark.read.option("wholetext", kind == "json").text(path)
    as_list = F.from_json("value", f"array<{record}>")
    as_object = F.from_json("value", f"struct<source:string,project_fingerprint:string,records:array<{record}>,log:array<{record}>,rows:array<{record}>>")
    both = text.select(F.when(F.ltrim("value").startswith("["), as_list).alias("l"), F.when(~F.ltrim("value").startswith("["), as_object).alias("o"))
    rows = both.select(F.col("o.source").alias("file_source"), F.col("o.project_fingerprint").alias("file_print"), F.explode(F.coalesce("l", "o.records", "o.log", "o.rows")).alias("r"))
    return rows.select("r.timestamp", "r.device", "r.value", "r.value_type", F.coalesce("r.source", "file_source").alias("source"), F.coalesce("r.project_fingerprint", "file_print").alias("project_fingerprint"))


def assemble_comments(device_data: DataFrame, comment_data: DataFrame, high: int | None = 1 << 20) -> DataFrame:
    """Device rows with their comments in two languages (5 and 6), all distinct
    texts, and the preferred one. Local addresses, those from ``high`` on (None: no
    such bound) and deleted comments are left out."""
    d = device_data.where(~F.coalesce("is_local", F.lit(False)))
    if high is not None:
        d = d.where(F.col("number") < high)
    c = comment_data.where(~F.coalesce("deleted", F.lit(False)))
    j = d.join(c.select("project", "seq", "language", "text"), ["project", "seq"], "left")
    pick = lambda n: F.coalesce(F.max(F.when(F.col("language") == n, F.col("text"))), F.lit(""))
    out = j.groupBy("project", "device", "device_type", "number").agg(pick(5).alias("japanese"), pick(6).alias("english"), F.array_join(F.array_sort(F.collect_set("text")), " / ").alias("all_text"))
    return out.withColumn("preferred", F.coalesce(F.nullif("japanese", F.lit("")), F.nullif("english", F.lit("")), "all_text"))


def assemble_labels(column_data: DataFrame, assigns: DataFrame) -> DataFrame:
    """Labels of a project from entity-attribute rows ``(project, scope, row_id,
    column_no, text)``: name, type, comment and constant (columns 1, 2, 3, 15) and
    their devices; a name that several scopes of a project have carries its scope.
    Tables of one project may leave ``project`` out."""
    of = ["project"] if "project" in column_data.columns else []
    pick = lambda n: F.coalesce(F.max(F.when(F.col("column_no") == n, F.col("text"))), F.lit(""))
    rows = column_data.groupBy(*of, "scope", "row_id").agg(pick(1).alias("name"), pick(2).alias("data_type"), pick(3).alias("comment"), pick(15).alias("constant"))
    shared = rows.groupBy(*of, "name").agg(F.count_distinct("scope").alias("scopes"))
    dev = assigns.groupBy(*of, "scope", "row_id").agg(F.array_join(F.array_sort(F.collect_set("device")), ",").alias("devices"))
    j = rows.join(shared, [*of, "name"]).join(dev, [*of, "scope", "row_id"], "left")
    return j.select(*of, "scope", "row_id", F.when(F.col("scopes") > 1, F.concat_ws("@", "name", "scope")).otherwise(F.col("name")).alias("label"), "data_type", "comment", "constant", F.coalesce("devices", F.lit("")).alias("devices"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Labels of each scope: how many, with a comment, with devices."""
    of = ["project"] if "project" in labels.columns else []
    return labels.groupBy(*of, "scope").agg(F.count("*").alias("labels"), F.count_if(F.col("comment") != "").alias("commented"), F.count_if(F.col("devices") != "").alias("assigned"))


def assemble_units(objects: DataFrame, unit: DataFrame, network_unit: DataFrame) -> DataFrame:
    """Objects of a project with their unit and network unit; head I/O in hex, number =
    head / 16. Tables of one project may leave ``project`` out."""
    key = ["project", "object_id"] if "project" in objects.columns else ["object_id"]
    j = objects.join(unit, key, "left").join(network_unit, key, "left")
    return j.select(*key, "unit_name", "network_no", F.hex(F.col("head_io").cast("long")).alias("head_io_hex"), F.floor(F.col("head_io") / 16).alias("unit_number"))


def write_findings(findings: DataFrame, path: str) -> None:
    """One folder per check below ``path``."""
    findings.write.mode("overwrite").partitionBy("check_name").parquet(path)


def export_csv(df: DataFrame, path: str, encoding: str = "UTF-8", sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("sep", sep).csv(path)


def read_memory_blocks(blocks: DataFrame, bit_codes: Sequence[int]) -> DataFrame:
    """Devices set in memory blocks ``(db, dev_code, dev_no, mem_data)``: little-endian
    words, zeros skipped. Bit devices give a row per set bit (word number times
    16), word devices their unsigned and signed value."""
    # a block's hex is cut into words of four digits once, in one pass
    words_of = F.regexp_extract_all(F.hex("mem_data"), F.lit("([0-9A-F]{4})"), 1)
    # dealt before they grow to a row a word: a few files would make a few tasks
    word = blocks.select("db", "dev_code", "dev_no", "mem_data").repartition("db", "dev_code", "dev_no").select("db", "dev_code", "dev_no", F.posexplode(words_of).alias("i", "h"))
    byte = lambda at: F.conv(F.substring("h", at, 2), 16, 10).cast("int")
    word = word.withColumn("value", byte(1) + byte(3) * 256).where("value <> 0")
    is_bit = F.col("dev_code").isin(*bit_codes)
    bits = word.where(is_bit).select("db", "dev_code", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.struct(((F.col("dev_no") + F.col("i")) * 16 + b).alias("number"), F.expr("1").alias("unsigned"), F.call_function("getbit", F.col("value"), b).alias("on"))), lambda x: x["on"] == 1)).alias("b")).select("db", "dev_code", "b.number", F.lit(1).alias("unsigned"), F.lit(1).alias("signed"))
    words = word.where(~is_bit).select("db", "dev_code", (F.col("dev_no") + F.col("i")).alias("number"), F.col("value").alias("unsigned"), F.when(F.col("value") >= 32768, F.col("value") - 65536).otherwise(F.col("value")).alias("signed"))
    return bits.union(words)


def dword_pairs(words: DataFrame) -> DataFrame:
    """Signed 32-bit values of each word and the one behind it, in one block of one
    project. Tables of one project may leave ``project`` out."""
    key = ["project", "db"] if "project" in words.columns else ["db"]
    low = words.select(*key, "number", F.col("unsigned").alias("low"))
    high = words.select(*key, (F.col("number") - 1).alias("number"), F.col("unsigned").alias("high"))
    raw = F.col("low").cast("long") + F.col("high").cast("long") * 65536
    return low.join(high, [*key, "number"]).select(*key, "number", F.when(raw >= 2147483648, raw - 4294967296).otherwise(raw).alias("value"))


def position_table(pairs: DataFrame, axes: DataFrame, positions: int) -> DataFrame:
    """Positions of axes from 32-bit values ``(project, db, number, value)``: the value at
    ``base + position * stride`` of each of ``axes(project, db, axis, base, stride)``, for the
    first ``positions`` positions; null where no word is set. Each axis names its
    numbers, so the join is an equal join."""
    asked = axes.select("project", "db", "axis", F.explode(F.sequence(F.lit(0), F.lit(positions - 1))).alias("position"), "base", "stride").withColumn("number", F.col("base") + F.col("position") * F.col("stride"))
    return asked.join(pairs.select("project", "db", "number", "value"), ["project", "db", "number"], "left").select("project", "db", "axis", "position", "number", "value")


def memory_totals(words: DataFrame, sample: int = 8) -> DataFrame:
    """Unpacked words of each block and device code: how many, first and last number,
    and the first ``sample`` as ``number=value``."""
    key = [c for c in ("project", "db", "dev_code") if c in words.columns]
    shown = words.withColumn("shown", F.struct(F.col("number"), F.concat_ws("=", F.col("number").cast("string"), F.col("unsigned").cast("string")).alias("text")))
    ranked = shown.groupBy(*key).agg(F.count("*").alias("words"), F.min("number").alias("first"), F.max("number").alias("last"))
    w = Window.partitionBy(*key).orderBy("number", "unsigned")
    few = shown.select(*key, "number", "unsigned", "shown.text").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample)
    examples = few.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("sample"))
    return ranked.join(examples, key)
