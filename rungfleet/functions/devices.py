"""Device names: splitting, formatting, canonical spelling, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device types whose numbers are written in base 16, and in base 10.
HEX_TYPES = ("X", "Y", "B", "W", "SB", "SW", "DX", "DY", "FX", "FY")
DECIMAL_TYPES = (
    "M", "L", "F", "V", "S", "SM", "D", "SD", "R", "ZR", "Z", "LZ", "RD", "FD", "T", "ST", "C", "LT", "LST", "LC",
    "TS", "TC", "TN", "STS", "STC", "STN", "CS", "CC", "CN", "LTS", "LTC", "LTN", "LSTS", "LSTC", "LSTN", "LCS", "LCC", "LCN",
)
#: Types that hold one bit.
BIT_TYPES = (
    "X", "Y", "DX", "DY", "FX", "FY", "M", "L", "B", "SM", "SB", "F", "V", "S", "T", "ST", "C", "LT", "LST", "LC",
    "TS", "TC", "STS", "STC", "CS", "CC", "LTS", "LTC", "LSTS", "LSTC", "LCS", "LCC",
)


def _alternatives(types: tuple[str, ...]) -> str:
    return "|".join(sorted(types, key=len, reverse=True))


def split_device(text: Column) -> Column:
    """``struct(device_type, number)``, or null where the text is no device.

    The longest listed type wins whose rest is a number in that type's base;
    types that are not listed are letters with a decimal number.
    """
    value = F.upper(F.trim(text))
    hex_type = F.regexp_extract(value, f"^({_alternatives(HEX_TYPES)})[0-9A-F]+$", 1)
    dec_type = F.regexp_extract(value, f"^({_alternatives(DECIMAL_TYPES)})[0-9]+$", 1)
    other = F.regexp_extract(value, "^([A-Z]+)[0-9]+$", 1)
    # bound one after another, so that each pattern runs once a row
    seen = F.struct(value.alias("value"), hex_type.alias("hex"), dec_type.alias("dec"), other.alias("other"))

    def choose(s: Column) -> Column:
        kind = F.when((s["hex"] != "") & (F.length(s["hex"]) >= F.length(s["dec"])), s["hex"]).when(s["dec"] != "", s["dec"]).otherwise(s["other"])
        return F.struct(s["value"].alias("value"), kind.alias("kind"))

    def read(s: Column) -> Column:
        digits = F.substring(s["value"], F.length(s["kind"]) + 1, F.length(s["value"]))
        number = F.when(s["kind"].isin(*HEX_TYPES), F.conv(digits, 16, 10)).otherwise(digits).cast("decimal(20,0)").cast("long")
        return F.when(s["kind"] != "", F.struct(s["kind"].alias("device_type"), number.alias("number")))

    chosen = F.transform(F.array(seen), choose)
    return F.transform(chosen, read)[0]


def format_device(device_type: Column, number: Column) -> Column:
    kind = F.upper(device_type)
    return F.concat(kind, F.when(kind.isin(*HEX_TYPES), F.hex(number.cast("long"))).otherwise(number.cast("string")))


def canonical_device(text: Column) -> Column:
    # bound, so that the text is split once a row
    return F.transform(F.array(split_device(text)), lambda s: format_device(s["device_type"], s["number"]))[0]


def is_bit(device_type: Column) -> Column:
    return F.upper(device_type).isin(*BIT_TYPES)
