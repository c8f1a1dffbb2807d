"""Keys: byte order, bounds, checks, and rows kept under a table's prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Upper end of the default ranges.
TOP = b"\xff"


def check_key(key: bytes) -> bytes:
    """Keys are bytes without a zero byte."""
    if not isinstance(key, (bytes, bytearray, memoryview)):
        raise TypeError(f"a key must be bytes, not {type(key).__name__}")
    key = bytes(key)
    if b"\x00" in key:
        raise ValueError("a key must not hold a zero byte")
    return key


def checked(key: Column) -> Column:
    """The key column, with an error for keys that hold a zero byte."""
    hexed = F.hex(key)
    bad = F.exists(F.sequence(F.lit(1), F.greatest(F.octet_length(key), F.lit(1))), lambda i: F.substring(hexed, 2 * i - 1, F.lit(2)) == "00")
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a key must not hold a zero byte")).cast("binary")).otherwise(key)


def successor(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with this prefix; None, where there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def in_range(key: Column, start: bytes | str | None, end: bytes | str | None) -> Column:
    """start <= key < end; None is unbounded. Plain comparisons, so both bounds reach the scan."""
    found = F.lit(True)
    if start:
        found = key >= F.lit(start)
    if end is not None:
        found = (key < F.lit(end)) if not start else found & (key < F.lit(end))
    return found


def clip(start, end, low, high):
    """The part of [start, end) inside [low, high); None is unbounded."""
    first = max(start or b"", low or b"")
    ends = [e for e in (end, high) if e is not None]
    return first, min(ends) if ends else None


def remaining_ttl(lock_time: Column, now: Column, ttl: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(float(ttl)) - (now - lock_time))


def row_id(key: Column) -> Column:
    """What follows the first colon of a key."""
    text = key.cast("string")
    return F.when(F.instr(text, ":") > 0, F.substring(text, F.instr(text, ":") + 1, F.length(text))).otherwise(text)


def time_bytes(ts: Column) -> Column:
    """A timestamp as eight bytes that sort as it does (it must not be negative)."""
    return F.unhex(F.lpad(F.hex(ts.cast("long")), 16, "0"))


def version_key(key: Column, ts: Column) -> Column:
    """Key and timestamp as one key: versions of a key follow each other in time, and no key's versions
    lie between another's."""
    return F.concat(key.cast("binary"), F.lit(b"\x00"), time_bytes(ts))


def split_version_key(versioned: Column) -> tuple[Column, Column]:
    """Key and timestamp of a version key."""
    size = F.octet_length(versioned)
    return F.substring(versioned, F.lit(1), size - 9), F.conv(F.hex(F.substring(versioned, size - 7, F.lit(8))), 16, 10).cast("long")


def versions_range(key: bytes) -> tuple[bytes, bytes]:
    """[start, end) of the version keys of one key."""
    return check_key(key) + b"\x00", check_key(key) + b"\x01"


def row_fields(df: DataFrame, value_col: str, names: list[str]) -> DataFrame:
    """df with fields of its row values, each parsed once: of a JSON object its fields; of any other text
    id is the text itself."""
    text = F.decode(value_col, "UTF-8")
    parsed = df.withColumn("_text", text).withColumn("_row", F.when(F.ltrim("_text").startswith("{"), F.try_parse_json("_text")))
    whole = F.when(F.col("_row").isNull(), F.col("_text"))
    return parsed.select(*df.columns, *[F.coalesce(F.try_variant_get("_row", f"$.{n}", "string"), whole if n == "id" else F.lit(None).cast("string")).alias(n) for n in dict.fromkeys(names)])


def row_field(value: Column, name: str) -> Column:
    """A field of a row value: of its JSON object; of any other text, id is the text itself."""
    text = F.decode(value, "UTF-8")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    field = F.variant_get(F.try_parse_json(text), f"$.{name}", "string")
    return F.when(is_object, field).otherwise(text if name == "id" else F.lit(None).cast("string"))
