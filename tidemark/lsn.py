"""Log positions on the driver; functions.parse_lsn is the same as a column."""

from __future__ import annotations

import re

_PATTERN = re.compile(r"([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})\Z")


def position(text: str) -> int | None:
    m = _PATTERN.match(text)
    return (int(m[1], 16) << 32) + int(m[2], 16) if m else None


def text(number: int) -> str:
    return f"{number >> 32:X}/{number & 0xFFFFFFFF:X}"


def at_or_before(candidate: str, durable: str) -> bool:
    a, b = position(candidate), position(durable)
    return candidate == durable if a is None or b is None else a <= b
