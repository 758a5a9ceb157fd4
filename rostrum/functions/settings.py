"""Settings of the hybrid pipeline, read from text values; what is missing, no number or out of range is the default."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Hybrid:
    """Words under ``threshold`` are re-heard; gaps and padding are seconds."""

    threshold: float = 0.85
    gap_tolerance: float = 0.5
    padding: float = 0.25
    max_calls_per_model: int = 15


#: Least and greatest value of each setting.
RANGES = {"threshold": (0.0, 1.0), "gap_tolerance": (0.0, math.inf), "padding": (0.0, math.inf), "max_calls_per_model": (1, math.inf)}
_LEADING = re.compile(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def hybrid(values: Mapping[str, str], warn: Callable[[str], None] = print) -> Hybrid:
    """``values`` by names like HYBRID_CONFIDENCE_THRESHOLD; whatever is wrong is reported and left at its default.

    A decimal number may be followed by other text; a whole one may not.
    """
    made = {}
    for f in fields(Hybrid):
        name = "HYBRID_" + {"threshold": "CONFIDENCE_THRESHOLD"}.get(f.name, f.name.upper())
        raw, lo_hi = values.get(name), RANGES[f.name]
        if raw is None or raw == "":
            continue
        whole = isinstance(f.default, int)
        found = _LEADING.match(raw)
        number = float(found[0]) if found and (not whole or not raw[found.end() :].strip()) else None
        if number is None or not lo_hi[0] <= number <= lo_hi[1] or math.isinf(number) or whole and number % 1:
            warn(f"{name}={raw!r} is not valid: {f.default} is used")
        else:
            made[f.name] = int(number) if whole else number
    return Hybrid(**made)
