"""Durations and instants of the query language, as milliseconds."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime

#: The duration units of the query language, in milliseconds.
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_INT64 = 2**63 - 1
_ZONED = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", re.ASCII)
_DAY = re.compile(r"\d{4}-\d\d-\d\d", re.ASCII)


def duration_ms(text: str) -> int:
    """``30m`` -> milliseconds. No blanks, one unit of s, m, h, d; a sign is allowed."""
    m = re.fullmatch(r"([+-]?\d+)([a-zA-Z])", text, re.ASCII)
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    ms = int(m[1]) * UNITS[m[2]]
    if abs(ms) * 1_000_000 > _INT64:
        raise ValueError(f"duration out of range: {text!r}")
    return ms


def zoned_ms(text: str) -> int | None:
    """Milliseconds of an RFC 3339 instant with zone, truncated; None if ``text`` is not one."""
    if not _ZONED.fullmatch(text):
        return None
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    whole = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (whole.days * 86_400 + whole.seconds) * 1000 + whole.microseconds // 1000


def instant_ms(text: str) -> int:
    """An instant of a range: RFC 3339, a UTC day, or an integer (above 1e12 milliseconds, else seconds)."""
    text = text.strip()
    if (at := zoned_ms(text)) is not None:
        return at
    if _DAY.fullmatch(text):
        try:
            return (date.fromisoformat(text) - date(1970, 1, 1)).days * UNITS["d"]
        except ValueError as e:
            raise ValueError(f"not an instant: {text!r}") from e
    if re.fullmatch(r"[+-]?\d+", text, re.ASCII) and abs(n := int(text)) <= _INT64:
        return n if n > 10**12 else n * 1000
    raise ValueError(f"not an instant: {text!r}")


def parameter_ms(text: str) -> int:
    """A time parameter of the HTTP interface: seconds as a float, or RFC 3339."""
    try:
        return int(float(text) * 1000)
    except (ValueError, OverflowError):
        if (at := zoned_ms(text)) is None:
            raise ValueError(f"not a time: {text!r}") from None
        return at
