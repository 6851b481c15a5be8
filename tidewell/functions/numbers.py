"""Number text of query results: shortest digits that read back to the same double."""

from __future__ import annotations

import math
from decimal import Decimal


def general_text(x: float, plain_below: int = 21) -> str:
    """Shortest round-trip digits; exponent form iff the decimal exponent is < -4 or >= ``plain_below``."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, digits, exp = Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    power = exp + len(text) - 1
    head = "-" if sign else ""
    if power < -4 or power >= plain_below:
        frac = "." + text[1:] if len(text) > 1 else ""
        return f"{head}{text[0]}{frac}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return f"{head}0.{'0' * (-power - 1)}{text}"
    if len(text) <= power + 1:
        return head + text + "0" * (power + 1 - len(text))
    return f"{head}{text[: power + 1]}.{text[power + 1 :]}"
