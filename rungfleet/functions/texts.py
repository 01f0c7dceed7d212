"""Text classes from rule tables, roles of comments, log values, signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def first_class(text: Column, rules: Sequence[tuple[str, str]], otherwise: str = "") -> Column:
    """The name of the first rule ``(name, pattern)`` that is found in the text."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def label_classes(text: Column, rules: Sequence[tuple[str, str, int]]) -> Column:
    """All rules ``(name, pattern, weight)`` found, as an array of structs with the
    matching text as evidence."""
    value = F.coalesce(text, F.lit(""))
    found = [F.when(value.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.regexp_extract(value, f"({p})", 1).alias("evidence"))) for n, p, w in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def max_weight(classes: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(classes, lambda c: c["weight"])), F.lit(0))


def canonical_role(comment: Column, tokens: Sequence[str], synonyms: dict[str, str]) -> Column:
    """The longest part between arrows, in lower case without direction tokens,
    brackets and punctuation, with synonyms replaced word by word."""
    parts = F.split(F.lower(F.coalesce(comment, F.lit(""))), "->|=>|→|<-|←")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p, i: F.struct(-F.length(F.trim(p)), i, p.alias("p")))), 1)["p"]
    text = F.regexp_replace(longest, r"\[[^\]]*\]|\([^)]*\)", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")
    if tokens:
        text = F.regexp_replace(text, rf"\b(?:{'|'.join(tokens)})\b", " ")
    ws = F.array_remove(F.split(text, " +"), "")
    if synonyms:
        table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
        ws = F.transform(ws, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(ws, " ")


def base_opcode(opcode: Column, known: Sequence[str]) -> Column:
    """The opcode without the pulse mark P, if what is left is known and it is not."""
    return F.when(opcode.isin(*known), opcode).when(opcode.endswith("P") & F.regexp_replace(opcode, "P$", "").isin(*known), F.regexp_replace(opcode, "P$", "")).otherwise(opcode)


def logic_signature(data: Column) -> Column:
    """A digest of a rung's body with the outer canvas size blanked (its first
    occurrence only), and everything else kept."""
    at = F.regexp_extract(data, r"(?s)^(.*?:cb[{\[]fg=fg[{\[]dim=)\d+x\d+(:.*)$", 1)
    rest = F.regexp_extract(data, r"(?s)^(.*?:cb[{\[]fg=fg[{\[]dim=)\d+x\d+(:.*)$", 2)
    return F.sha2(F.when(at != "", F.concat(at, F.lit("(any size)"), rest)).otherwise(F.coalesce(data, F.lit(""))), 256)


def timer_seconds(opcode: Column, const: Column) -> Column:
    """A timer's preset in seconds: tenths, or hundredths for fast timers (``H``)."""
    value = F.regexp_extract(const, r"^K(\d+)$", 1)
    return F.when(value != "", value.cast("double") * F.when(opcode.rlike("H"), 0.01).otherwise(0.1))


def utc_timestamp(text: Column) -> Column:
    """ISO 8601 to a timestamp; without a zone it is UTC (the session's zone)."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[Zz]$", "+00:00"))


def parse_value(text: Column) -> Column:
    """``struct(value_text, value_num, value_type)`` of an untyped log value: on/off
    words, integers with an optional 0x, numbers, or text."""
    low = F.lower(F.trim(text))
    true, false = low.isin("true", "on", "yes"), low.isin("false", "off", "no")
    whole, based = low.rlike(r"^[+-]?\d+$"), low.rlike(r"^0x[0-9a-f]+$")
    number = low.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")
    num = F.when(true, 1.0).when(false, 0.0).when(based, F.conv(F.substring(low, 3, 16), 16, 10).cast("double")).when(whole | number, low.try_cast("double"))
    kind = F.when(true | false, "bool").when(whole | based, "int").when(number, "float").otherwise("string")
    return F.struct(text.alias("value_text"), num.alias("value_num"), kind.alias("value_type"))


def expand_terms(term: str, groups: Sequence[Sequence[str]]) -> list[str]:
    """A search term with the other terms of its synonym groups."""
    out = [term]
    for g in groups:
        if term.lower() in (t.lower() for t in g):
            out += [t for t in g if t not in out]
    return out
