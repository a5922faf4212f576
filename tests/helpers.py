"""Hand-built frames and rows."""

import struct

from tidemark.model import CAPTURED


def cstr(s):
    return s.encode() + b"\0"


def relation(number, schema, table, columns, identity="f"):
    cols = b"".join(struct.pack(">B", 0) + cstr(c) + struct.pack(">Ii", 25, -1) for c in columns)
    return b"R" + struct.pack(">I", number) + cstr(schema) + cstr(table) + identity.encode() + struct.pack(">H", len(columns)) + cols


def row(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        if v is None:
            out += b"n"
        elif v is ...:
            out += b"u"
        elif isinstance(v, bytes):
            out += b"b" + struct.pack(">i", len(v)) + v
        else:
            out += b"t" + struct.pack(">i", len(v.encode())) + v.encode()
    return out


def insert(number, *v):
    return b"I" + struct.pack(">I", number) + b"N" + row(*v)


def update(number, new, old=None, key=None):
    before = b"O" + row(*old) if old else b"K" + row(*key) if key else b""
    return b"U" + struct.pack(">I", number) + before + b"N" + row(*new)


def delete(number, old=None, key=None):
    return b"D" + struct.pack(">I", number) + (b"O" + row(*old) if old else b"K" + row(*key))


def truncate(*numbers):
    return b"T" + struct.pack(">IB", len(numbers), 0) + b"".join(struct.pack(">I", n) for n in numbers)


def frames(*transactions, source="primary", start=0):
    """Each transaction is a list of payloads; positions and transaction numbers count up."""
    out, pos = [], start
    for i, payloads in enumerate(transactions):
        at = 1000 * (start + i + 1)
        out.append((source, pos, "begin", at, None, 700 + start + i, at + 900, None, 1_000_000 * (start + i), None))
        pos += 1
        for p in payloads:
            event = "message" if isinstance(p, str) else "data"
            out.append((source, pos, event, at + 1, None if isinstance(p, str) else bytearray(p), None, None, None, None, p if isinstance(p, str) else None))
            pos += 1
        out.append((source, pos, "commit", at + 900, None, None, None, at + 950, None, None))
        pos += 1
    return out


def captured(spark, transactions, first=1, table="orders", payload='{"id":"%d"}', ms=1_784_862_080_000):
    """Rows of transactions, given as numbers of events; transaction i ends at position i."""
    rows, pos, n = [], first * 1000, first * 100
    for i, size in enumerate(transactions, first):
        for _ in range(size):
            rows.append(("primary", pos, f"0/{i * 16:X}", i, f"0/{i * 16 + 8:X}", f"0/{i * 16 + 8:X}", "public", table, "insert", None, None, payload % n, ms + n))
            pos, n = pos + 1, n + 1
        if not size:
            rows.append(("primary", pos, f"0/{i * 16:X}", None, None, f"0/{i * 16 + 8:X}", None, None, None, None, None, None, None))
            pos += 1
    return spark.createDataFrame(rows, CAPTURED)
