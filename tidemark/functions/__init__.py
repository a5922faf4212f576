"""Column functions with the event log's exact rules; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import OPERATION_CODES

LSN_PATTERN = "^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"
U64 = "decimal(20,0)"
#: Unix milliseconds of 2000-01-01, where the source's clock starts. Fixed value.
EPOCH_2000_MS = 946684800000
#: Upper bounds of the commit latency histogram in seconds. Fixed values.
LATENCY_BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf"))
MARKER_PREFIX = "tx-v1"


def parse_lsn(lsn: Column) -> Column:
    """HI/LO in hex as an unsigned number; null where the text is none."""
    half = lambda i: F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast(U64)
    return F.when(lsn.rlike(LSN_PATTERN), (half(1) * F.lit(4294967296).cast("decimal(10,0)") + half(2)).cast(U64))


def format_lsn(number: Column) -> Column:
    """The text of an unsigned position that fits a long."""
    return F.concat(F.upper(F.hex(F.shiftrightunsigned(number, 32))), F.lit("/"), F.upper(F.hex(number.bitwiseAND(F.lit(0xFFFFFFFF)))))


def lsn_is_at_or_before(candidate: Column, durable: Column) -> Column:
    """By number if both are positions, else only equal texts."""
    a, b = parse_lsn(candidate), parse_lsn(durable)
    return F.when(a.isNotNull() & b.isNotNull(), a <= b).otherwise(candidate == durable)


def pg_time_to_unix_ms(micros: Column) -> Column:
    """The source's microseconds; the division truncates toward zero."""
    ms = F.when(micros >= 0, F.floor(micros / F.lit(1000).cast("decimal(5,0)"))).otherwise(F.ceil(micros / F.lit(1000).cast("decimal(5,0)")))
    return F.lit(EPOCH_2000_MS) + ms.cast("long")


def source_event_id(database: Column, slot: Column, xid: Column, wal_start: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", F.lit("postgres"), database, slot, F.coalesce(xid, F.lit(0)).cast("string"), wal_start, ordinal.cast("string"))


def marker(source: Column, end_lsn: Column) -> Column:
    """Names a transaction; the length keeps names apart that hold colons."""
    return F.concat_ws(":", F.lit(MARKER_PREFIX), F.octet_length(source).cast("string"), source, end_lsn)


def payload_bytes(*images: Column) -> Column:
    """Bytes of the row images, none for a missing one: what limits and accounts of the log count."""
    out = F.lit(0).cast("long")
    for image in images:
        out = out + F.coalesce(F.octet_length(image), F.lit(0))
    return out


def event_size(*texts: Column) -> Column:
    return payload_bytes(*texts)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def human_bytes(n: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """Bytes in the largest unit that they reach, the last of units at most."""
    size, out = n.cast("double"), F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units, 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", size / float(1024**i))).otherwise(out)
    return out


def shorten(text: Column, width: int) -> Column:
    """At most width characters, the last three of a cut text dots."""
    cut = F.lit("." * width) if width <= 3 else F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def operation_code(operation: Column) -> Column:
    out = F.lit(0)
    for name, code in OPERATION_CODES.items():
        out = F.when(operation == name, F.lit(code)).otherwise(out)
    return out


def staging_directory(source: Column) -> Column:
    return F.concat(F.lit("source-"), F.lower(F.hex(F.encode(source, "UTF-8"))))


def sqlstate(message: Column) -> Column:
    """The state in a "(SQLSTATE xxxxx)" at the end of a message, or null."""
    found = F.regexp_extract(message, r"\(SQLSTATE ([0-9A-Z]{5})\)$", 1)
    return F.when(found != "", found)


def retryable_sqlstate(state: Column) -> Column:
    listed = state.isin("55006", "57P01", "57P02", "57P03")
    return F.coalesce(state.startswith("08") | state.startswith("53") | listed, F.lit(False))


def reconnect_delay_ms(attempt: Column, base: int = 250, cap: int = 15000) -> Column:
    """Doubling from base, capped, before jitter."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(16))).cast("long"))


def contains_unchanged(image: Column) -> Column:
    """Whether a value of a row image is the sign for an unchanged large value."""
    values = F.map_values(F.from_json(image, "map<string,string>"))
    return F.coalesce(F.exists(values, lambda v: F.coalesce(F.regexp_replace(v, r"\s", "") == '{"__unchanged_toast":true}', F.lit(False))), F.lit(False))


def is_object(image: Column) -> Column:
    """Whether a text is a JSON object; null for null."""
    kind = F.schema_of_variant(F.try_parse_json(image))
    return F.when(image.isNotNull(), F.coalesce(kind.startswith("OBJECT"), F.lit(False)))


def compile_template(template: str) -> list[tuple[bool, str]]:
    """A key template as parts (is a field, text). Raises where no row could be rendered."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        field, closed, rest = rest.partition("}")
        if not closed or not field or "{" in field:
            raise ValueError(f"bad placeholder in {template!r}")
        out += [(False, before)] if before else []
        out.append((True, field))
    if "}" in rest:
        raise ValueError(f"stray brace in {template!r}")
    return out + ([(False, rest)] if rest else [])


def parsed_object(image: Column) -> Column:
    """The fields of a JSON object as variants by name; null where a text is no object, or null."""
    return F.try_variant_get(F.try_parse_json(image), "$", "map<string,variant>")


def render_parsed(template: str, fields: Column) -> Column:
    """The key of a parsed row image, or null where a field is missing, null or no scalar."""
    parts = []
    for is_field, text in compile_template(template):
        if not is_field:
            parts.append(F.lit(text))
            continue
        value = F.try_element_at(fields, F.lit(text))
        string = F.try_variant_get(value, "$", "string")
        # Objects and arrays have texts too, which begin with their bracket; a text value may as well, so only those are looked at again.
        nested = string.rlike("^[\\[{]") & F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
        parts.append(F.when(~nested, string))
    return F.concat(*parts) if parts else F.lit("")


def render_key(template: str, image: Column) -> Column:
    """The key of a row image, or null where it is no object or a field is missing, null or no scalar."""
    return render_parsed(template, parsed_object(image))
